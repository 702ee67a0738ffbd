"""Removal of long repeated passages by level-wise doubling.

A start of a window (35 words by default) is a candidate. At each level a candidate is stood for by
one gram inside its window, of a quarter of the window's length at first, then twice that, and at
last the window itself: the gram with the least hash, so that equal windows choose equal grams.
Windows whose gram occurs once drop out; the repeated ones alone are extended to twice the length,
until no candidates survive.

Neighbouring candidates with the same gram form a run, and a run is one row: (gram hash, hash of the
run's whole extent, place). A run whose whole extent repeats is settled at once, all its windows
repeat. Only runs whose gram repeats while their extent doesn't go on to the next level, together
with one settled run of each extent under that gram, as a witness.

Scale: the first level sends one row for about 14 words; each task first merges equal runs of its
slice, so a passage in a third of all documents is a few rows a task, not one a document. The gram
hash is the only shuffle key; grams of very many runs are hot and are aggregated instead of gathered in a window.
What shuffles later are the survivors. Verdicts come back to the
texts by a 64-bit text key: broadcast while they have at most ``BROADCAST`` bytes, else by a
shuffled join. Levels are written to the shared folder, so lost executors cost no recomputation.

Defined cases: null or empty texts have no words; equal texts are copies of each other, whatever
their ids (null ids are kept); texts of fewer words than a window lose nothing; a passage repeated
within one document counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import HOT_SHARE, batch, bounded, lists, look_up, saved, text_rows
from tessera.llm.words import NON_SPACE, U64, Words, gram_hashes, gram_starts, mix, ragged, text_slices

WINDOW = 35
#: Bytes of verdicts that are broadcast, and the runs from which a gram is hot.
BROADCAST, HOT_RUNS = 64 << 20, 1_000

RUNS = "h long, hs long, n int, key long, first int, size int, more binary"
_RUNS = pa.schema([("h", pa.int64()), ("hs", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("first", pa.int32()), ("size", pa.int32()), ("more", pa.binary())])
_PLACE = np.dtype([("key", "<i8"), ("first", "<i4"), ("size", "<i4")])


def level_lengths(window: int) -> list[int]:
    """A quarter of the window, doubled up to the window: 9, 18, 35 for 35."""
    out = [max(1, -(-window // 4))]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    both = []
    for r in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, r, dtype=U64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def least(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` consecutive hashes (the leftmost of equals)."""
    at, size = np.arange(len(grams)), 1
    while size * 2 <= width:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(grams[a] <= grams[b], a, b)
        size *= 2
    count = len(grams) - width + 1
    a, b = at[:count], at[width - size : width - size + count]
    return np.where(grams[a] <= grams[b], a, b)


def runs_of(hashes: np.ndarray, weight: np.ndarray, length: int, window: int):
    """The runs among the candidates (weight over 0) of a slice: first start, starts, gram hash, hash of the extent."""
    count = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    starts = np.flatnonzero(weight[: max(count, 0)])
    if not len(starts):
        return none, none, none.view(U64), none.view(U64)
    grams = gram_hashes(hashes, length)
    chosen = least(grams, window - length + 1)[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (starts[1:] != starts[:-1] + 1) | (chosen[1:] != chosen[:-1]) | (weight[starts[1:]] != weight[starts[:-1]])
    heads = np.flatnonzero(head)
    first, size = starts[heads], np.diff(np.append(heads, len(starts)))
    size_of_powers = 1 << max(12, (len(hashes) + 1).bit_length())
    power, inverse = _powers(size_of_powers)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    extent = (sums[first + size - 1 + window] - sums[first]) * inverse[first]
    extent ^= size.astype(U64) * U64(0xA24BAED4963EE407)
    return first, size, grams[chosen[heads]], mix(extent)


def _candidates(rows: pa.RecordBatch, words: Words, window: int) -> np.ndarray:
    """The weight of every start of a slice: 1 for all where the rows name no candidates."""
    weight = np.zeros(len(words), np.int32)
    at = rows.schema.get_field_index("starts")
    if at < 0:
        weight[gram_starts(words.bounds, window, len(words))] = 1
        return weight
    col = rows.column(at)
    packed = np.asarray(col.flatten())
    doc = np.repeat(np.arange(len(col)), np.asarray(col.value_lengths().fill_null(0)))
    first, size, w = packed >> 32, (packed >> 2) & 0x3FFFFFFF, packed & 3
    places = ragged(words.bounds[doc] + first, size)
    weight[places] = np.repeat(w, size)
    return weight


def level(length: int, window: int):
    """The runs of one level; equal runs of a slice are one row, whose further places are packed in ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, data, offsets in text_slices(whole):
                words = Words(data, offsets, NON_SPACE)
                weight = _candidates(rows, words, window)
                first, size, gram, extent = runs_of(words.hashes(), weight, length, window)
                if not len(first):
                    continue
                doc = np.searchsorted(words.bounds, first, "right") - 1
                key, at = np.asarray(rows.column(rows.schema.get_field_index("key")))[doc], first - words.bounds[doc]
                by = np.lexsort((at, key, extent, gram))
                gram, extent = gram[by], extent[by]
                place = np.empty(len(by), _PLACE)
                place["key"], place["first"], place["size"] = key[by], at[by], size[by]
                head = np.ones(len(by), bool)
                head[1:] = (gram[1:] != gram[:-1]) | (extent[1:] != extent[:-1])
                heads = np.flatnonzero(head)
                n = np.add.reduceat(weight[first[by]], heads)
                other = ~head  # further places; equal texts have the same key and places, which one row stands for
                other[1:] &= (place["key"][1:] != place["key"][:-1]) | (place["first"][1:] != place["first"][:-1])
                ends = np.zeros(len(heads) + 1, np.int32)
                np.cumsum(np.add.reduceat(other.astype(np.int64), heads) * _PLACE.itemsize, out=ends[1:])
                more = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(place[other].tobytes())])
                lead = place[heads]
                yield batch(_RUNS, gram[heads].view(np.int64), extent[heads].view(np.int64), n, np.ascontiguousarray(lead["key"]), np.ascontiguousarray(lead["first"]), np.ascontiguousarray(lead["size"]), more)

    return run


_SETTLED = pa.schema([("key", pa.int64()), ("run", pa.int64())])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first << 32 | starts) for every place of the runs."""
    for rows in batches:
        key, first, size = (np.asarray(rows.column(k)).astype(np.int64) for k in range(3))
        raw = b"".join(x for x in rows.column(3).to_pylist() if x)
        more = np.frombuffer(raw, _PLACE)
        keys = np.concatenate([key, more["key"]])
        yield batch(_SETTLED, keys, np.concatenate([first, more["first"].astype(np.int64)]) << 32 | np.concatenate([size, more["size"].astype(np.int64)]))


def covered(window: int):
    """An Arrow UDF: the word ranges (start << 32 | end) that a document's repeated windows cover."""

    @F.arrow_udf("array<long>")
    def cover(runs: pa.Array) -> pa.Array:
        out, sizes = [], []
        for one in runs:
            packed = np.sort(np.asarray(one.values))
            start, end = packed >> 32, (packed >> 32) + (packed & 0xFFFFFFFF) + window - 1
            far = np.maximum.accumulate(end)
            head = np.ones(len(start), bool)
            head[1:] = start[1:] > far[:-1]
            heads = np.flatnonzero(head)
            out.append(start[heads] << 32 | far[np.append(heads[1:], len(start)) - 1])
            sizes.append(len(heads))
        return lists(np.concatenate(out) if out else np.zeros(0, np.int64), np.array(sizes, np.int64), pa.int64())

    return cover


def by_key(texts: DataFrame, found: DataFrame, column: str, how: str) -> DataFrame:
    """Joins what was found for text keys to the texts: a broadcast up to BROADCAST bytes, else a shuffled join."""
    size = found.agg(F.sum(32 + 8 * F.size(column))).first()[0] or 0
    return texts.join(F.broadcast(found) if size <= BROADCAST else found, "key", how)


def weighed(runs: DataFrame) -> DataFrame:
    """Runs whose gram repeats, with: same, the windows of the run's extent; least, the fewest of an extent of the gram;
    lead, whether the run stands for its extent. Hot grams are aggregated, the others meet in windows."""
    total = runs.count()
    hot = saved(runs.groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") > max(HOT_RUNS, total // HOT_SHARE)).select("h"), "hot-grams")
    gram, extent = Window.partitionBy("h"), Window.partitionBy("h", "hs")
    cold = runs.join(F.broadcast(hot), "h", "left_anti")
    cold = cold.withColumn("total", F.sum("n").over(gram)).where("total > 1").drop("total")
    cold = cold.withColumn("same", F.sum("n").over(extent)).withColumn("first_of", F.min(F.struct("key", "first")).over(extent))
    cold = cold.withColumn("least", F.min("same").over(gram))
    if not hot.isEmpty():
        often = runs.join(F.broadcast(hot), "h", "left_semi")
        extents = often.groupBy("h", "hs").agg(F.sum("n").alias("same"), F.min(F.struct("key", "first")).alias("first_of"), F.count("*").alias("rows"))
        extents = saved(extents, "hot-extents")
        least_ = extents.groupBy("h").agg(F.min("same").alias("least"))
        cold = cold.unionByName(look_up(often, extents, ["h", "hs"], "rows").drop("rows").join(F.broadcast(least_), "h"))
    return cold.withColumn("lead", F.col("first_of") == F.struct("key", "first"))


def repeated_ranges(documents: DataFrame, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, ranges): for every text with repeated windows, its key (xxhash64 of the text) and the word
    ranges that they cover."""
    texts = bounded(documents).select(F.col(f"`{text_column}`").cast("string").alias("text")).where("text is not null")
    texts = texts.withColumn("key", F.xxhash64("text"))
    settled, rows = None, texts
    for length in level_lengths(window):
        alive = weighed(saved(rows.mapInArrow(level(length, window), RUNS), f"runs-{length}"))
        alive = saved(alive.select("key", "first", "size", "more", "same", "least", "lead"), f"alive-{length}")
        done = alive.where("same > 1").select("key", "first", "size", "more").mapInArrow(unpacked, "key long, run long")
        settled = done if settled is None else settled.unionByName(done)
        if length == window:
            break
        open_ = alive.where("same = 1 or (least = 1 and lead)")
        packed = F.shiftleft(F.col("first").cast("long"), 32) + F.col("size") * 4 + F.when(F.col("same") == 1, 1).otherwise(2)
        open_ = saved(open_.select("key", packed.alias("start")).groupBy("key").agg(F.collect_set("start").alias("starts")), "candidates")
        if open_.isEmpty():
            break
        rows = by_key(texts, open_, "starts", "inner")
    ranges = settled.groupBy("key").agg(F.collect_set("run").alias("runs")).select("key", covered(window)("runs").alias("ranges"))
    return saved(ranges, "ranges")


_KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for rows, data, offsets in text_slices(whole):
            raw, at = data.tobytes(), offsets.tolist()
            total, gone, kept = [], [], []
            for k, ranges in enumerate(rows.column(2).to_pylist()):
                words = raw[at[k] : at[k + 1]].split()  # bytes split at 0x20 and 0x09-0x0D
                total.append(len(words))
                if ranges:
                    keep = np.ones(len(words), bool)
                    for r in ranges:
                        keep[r >> 32 : r & 0xFFFFFFFF] = False
                    words = list(compress(words, keep.tolist()))
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield batch(_KEPT, rows.column(0), total, gone, pa.array(kept, pa.binary()).cast(pa.string()))


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): every document's words that no repeated window covers, joined by one space."""
    ranges = repeated_ranges(documents, text_column, window)
    rows = text_rows(documents, id_column, text_column).withColumn("key", F.xxhash64("text"))
    rows = by_key(rows, ranges, "ranges", "left").select("id", "text", "ranges")
    return rows.mapInArrow(_keep, "id long, n_words long, n_removed long, kept string")
