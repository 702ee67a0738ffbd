"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its components.

A document's set is its distinct 4-word shingles. Two documents link when
100 * |A and B| >= 85 * |A or B|. Equal sets are collapsed first, by a 128-bit key.

Light sets (at most ``boundary`` shingles): sets of sizes n and m link exactly when they share
o(n, m) = ceil(85 (n + m) / 185) shingles. Each light set enumerates its subsets of every size o(n, m)
that a partner could need; who shares a subset's key is checked on the sets. Within a subset's
list everybody links to the smallest member where anybody links at all, so a list gives as many
links as it has members.

Heavy sets: inverted lists of each set's prefix (the first n - ceil(0.85 n) + 1 shingles in one global
order; two linked sets share one). The order puts shingles that many documents hold last; it is taken
from a bounded summary of frequent shingles, and any order gives the same links. A list is scanned in
two rounds. First every member meets only the list's pivot; what links is a component. Then the
members of different components that pass the size and position filters meet each other, which leaves
no link between components unseen. Pairs inside a component are never built.

The boundary is chosen by cost: subsets to enumerate against postings to scan and check.

Scale: one pass over the texts for sets and summary, one for postings, and one, restricted to
candidates, for each round of checks. Equal postings of a task's slice are one row, so a group of
copies with a third of all rows is a few rows a task. Skewed lists are joined, not gathered.

Defined cases: null and empty texts have no shingles, and link with nothing; fewer words than a
shingle are one shingle; rows with the same id are one document; a null id links with nothing and has
a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import batch, lists, look_up, saved, small, text_rows
from tessera.llm.components import components
from tessera.llm.words import NON_SPACE, U64, Words, gram_hashes, join_hashes, mix, text_slices

SHINGLE = 4
PERCENT = 85
#: Shingles in the summary of frequent ones: for each task, and over all.
FREQUENT_TASK, FREQUENT = 8192, 65536
#: Candidate ids that are broadcast to filter the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Largest set that may be light, and the cost of a posting (scan, join and its share of checks) in subsets.
LIGHT_MOST, POSTING_COST = 24, 12


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Shared shingles from which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """The subset sizes that a light set of n shingles enumerates, for partners of any size."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for m in partners if (c := needed(n, m, percent)) <= n})


def subsets(n: int, percent: int = PERCENT) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


class Sets:
    """The shingle sets of a slice, flat: values sorted in each set, and the bounds of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        words = Words(data, offsets, NON_SPACE, lower=True)
        hashes = words.hashes()
        grams = gram_hashes(hashes, k)
        out = []
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1])
                keep = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out.append(own[keep])
            elif b > a:
                whole = hashes[a : a + 1]
                for w in range(a + 1, b):
                    whole = join_hashes(whole, hashes[w : w + 1])
                out.append(mix(whole ^ U64(b - a)))
            else:
                out.append(hashes[:0])
        self.sets = out
        self.sizes = np.array([len(x) for x in out], np.int64)
        self.values = np.concatenate(out) if out else np.zeros(0, U64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit keys of each set, independent of the order."""
        both = []
        for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
            sums = np.concatenate([[U64(0)], np.cumsum(mix(self.values * U64(salt) + U64(salt >> 7)))])
            both.append((sums[self.bounds[1:]] - sums[self.bounds[:-1]]).view(np.int64))
        return both[0], both[1]


_BASE = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.binary())])
BASE = "kind int, id long, n long, k1 long, k2 long, sketch binary"


def sketch(values: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each bit, on n to 2n bits: every shingle that only one of
    two sets holds flips one bit, so two sketches differ in no more bits than their sets in shingles."""
    bits = 1 << max(6, (len(values) - 1).bit_length())
    slots = np.bincount((values * U64(0x9FB21C651E98DF25) >> U64(40)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((slots & 1).astype(np.uint8), bitorder="little").tobytes()


def plausible(percent: int):
    """An Arrow UDF: whether two sketches differ in few enough bits for a link. It never drops a link."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for x, y, i, j in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), m.to_pylist(), strict=True):
            small_, large = sorted((x, y), key=len)
            p, q, size = int.from_bytes(small_, "little"), int.from_bytes(large, "little"), len(large)
            while size > len(small_):  # fold the longer sketch
                size //= 2
                q = (q >> 8 * size) ^ (q & (1 << 8 * size) - 1)
            out.append((p ^ q).bit_count() <= i + j - 2 * needed(i, j, percent))
        return pa.array(out, pa.bool_())

    return near


def summarise(k: int):
    """Kind 0: id, size and key of every set. Kind 1: a frequent shingle (k1) of this task and in how many
    sets (n), by lossy counting: memory stays bounded, an entry seen rarely is dropped in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, round_ = np.zeros(0, U64), np.zeros(0, np.int64), 0
        for whole in batches:
            for rows, data, offsets in text_slices(whole):
                sets = Sets(data, offsets, k)
                k1, k2 = sets.keys()
                yield batch(_BASE, np.zeros(len(k1), np.int32), rows.column(0), sets.sizes, k1, k2, [sketch(x) for x in sets.sets])
                seen = np.sort(sets.values)
                heads = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])) if len(seen) else np.zeros(0, np.int64)
                times = np.diff(np.append(heads, len(seen)))
                often = times > 1
                values = np.concatenate([held, seen[heads[often]]])
                weights = np.concatenate([counts, times[often]])
                held, at = np.unique(values, return_inverse=True)
                counts = np.bincount(at, weights, minlength=len(held)).astype(np.int64)
                round_ += 1
                keep = counts > round_ // 2
                held, counts = held[keep], counts[keep]
        if len(held) > FREQUENT_TASK:
            top = np.argpartition(-counts, FREQUENT_TASK)[:FREQUENT_TASK]
            held, counts = held[top], counts[top]
        if len(held):
            yield batch(_BASE, np.ones(len(held), np.int32), pa.nulls(len(held), pa.int64()), counts, held.view(np.int64), np.zeros(len(held), np.int64), pa.nulls(len(held), pa.binary()))

    return run


_POSTINGS = pa.schema([("token", pa.int64()), ("c", pa.int32()), ("members", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("more", pa.binary())])
POSTINGS = "token long, c int, members int, id long, n int, pos int, more binary"
_MEMBER = np.dtype([("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def postings(k: int, percent: int, boundary: int, frequent: np.ndarray):
    """The lists of a slice. c = 0: a shingle of a heavy prefix; c > 0: a subset of c shingles of a light set.
    Members of the same list are one row, the further ones packed in ``more``; equal sets count once a slice."""
    order = np.argsort(frequent)
    known, rank = frequent[order], order.astype(U64)
    top = U64(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, data, offsets in text_slices(whole):
                sets = Sets(data, offsets, k)
                ids = rows.column(0).fill_null(0).to_numpy()
                usable = np.asarray(rows.column(0).is_valid()) & (sets.sizes > 0)
                k1, k2 = sets.keys()
                first: dict[tuple, int] = {}
                for d in np.flatnonzero(usable).tolist():
                    was = first.setdefault((k1[d], k2[d]), d)
                    if ids[d] < ids[was]:
                        first[k1[d], k2[d]] = d
                place = mix(sets.values.copy()) >> U64(1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, sets.values), len(known) - 1)
                    hot = known[at] == sets.values
                    place[hot] = top + rank[at[hot]]
                tokens, kinds, owners, spots = [], [], [], []
                for d in first.values():
                    own, n = sets.sets[d], int(sets.sizes[d])
                    if n <= boundary:
                        for c in subset_sizes(n, percent):
                            scrambled = mix(own ^ U64(0x5851F42D4C957F2D))
                            gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
                            keys = scrambled.sum(keepdims=True) - scrambled[gone].sum(axis=1)
                            tokens.append(mix(keys))
                            kinds.append(np.full(len(keys), c, np.int32))
                            owners.append(np.full(len(keys), d))
                            spots.append(np.zeros(len(keys), np.int32))
                    if 100 * n >= percent * (boundary + 1):
                        p = prefix(n, percent)
                        own_place = place[sets.bounds[d] : sets.bounds[d + 1]]
                        lead = np.argpartition(own_place, p - 1)[:p] if p < n else np.arange(n)
                        lead = lead[np.argsort(own_place[lead])]
                        tokens.append(own[lead])
                        kinds.append(np.zeros(p, np.int32))
                        owners.append(np.full(p, d))
                        spots.append(np.arange(p, dtype=np.int32))
                if not tokens:
                    continue
                token, kind, owner, spot = (np.concatenate(x) for x in (tokens, kinds, owners, spots))
                by = np.lexsort((ids[owner], kind, token))
                token, kind, owner, spot = token[by], kind[by], owner[by], spot[by]
                head = np.ones(len(token), bool)
                head[1:] = (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])
                heads = np.flatnonzero(head)
                count = np.diff(np.append(heads, len(token)))
                member = np.empty(len(token), _MEMBER)
                member["id"], member["n"], member["pos"] = ids[owner], sets.sizes[owner], spot
                ends = np.zeros(len(heads) + 1, np.int32)
                np.cumsum((count - 1) * _MEMBER.itemsize, out=ends[1:])
                more = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(member[~head].tobytes())])
                lead = member[heads]
                yield batch(_POSTINGS, token[heads].view(np.int64), kind[heads], count, *(np.ascontiguousarray(lead[x]) for x in ("id", "n", "pos")), more)

    return run


_MEMBERS = pa.schema([("token", pa.int64()), ("c", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        token, c, _, id_, n, pos = (np.asarray(rows.column(j)) for j in range(6))
        more = [x or b"" for x in rows.column(6).to_pylist()]
        times = np.array([len(x) // _MEMBER.itemsize for x in more])
        rest = np.frombuffer(b"".join(more), _MEMBER)
        yield batch(_MEMBERS, *(np.concatenate(x) for x in ((token, np.repeat(token, times)), (c, np.repeat(c, times)), (id_, rest["id"]), (n, rest["n"]), (pos, rest["pos"]))))


def light_boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The size up to which enumerating subsets is cheaper than scanning lists, all sets considered."""
    sizes = range(1, LIGHT_MOST + 1)
    cost = {b: sum(histogram.get(n, 0) * (subsets(n, percent) if n <= b else POSTING_COST * prefix(n, percent)) for n in sizes) for b in range(LIGHT_MOST + 1)}
    return min(cost, key=lambda b: (cost[b], -b))


_SET = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, data, offsets in text_slices(whole):
                sets = Sets(data, offsets, k)
                yield batch(_SET, rows.column(0), lists(sets.values.view(np.int64), sets.sizes, pa.int64()))

    return run


def linked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link: first by their sketches, which are 1/50 of the sets, then
    checked on the whole sets. The texts are cut down to the left pairs' documents first."""
    side = lambda id_, n, s: sketches.select(F.col("id").alias(id_), F.col("n").alias(n), F.col("sketch").alias(s))
    pairs = pairs.select("a", "b").join(side("a", "n", "s"), "a").join(side("b", "m", "t"), "b").where(plausible(percent)("s", "t", "n", "m"))
    pairs = saved(pairs.select("a", "b").distinct(), "plausible")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = F.broadcast(ids) if small(ids, BROADCAST_IDS) else ids
    sets = texts.join(ids, "id", "left_semi").mapInArrow(shingle_sets(k), "id long, shingles array<long>")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    checked = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common.alias("common"))
    return checked.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def jaccard_join(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, representative, component): every document with the size of its set, the least id
    with an equal set, and the least id that its links reach."""
    texts = text_rows(documents, id_column, text_column)
    base = saved(texts.mapInArrow(summarise(k), BASE), "sets")
    frequent = base.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k1").limit(FREQUENT)
    frequent = np.array([r["k1"] for r in frequent.collect()][::-1], dtype=np.int64).view(U64)
    sizes = base.where(f"kind = 0 and n between 1 and {LIGHT_MOST}").groupBy("n").count().collect()
    boundary = light_boundary({r["n"]: r["count"] for r in sizes}, percent)

    sets = base.where("kind = 0").select("id", "n", "k1", "k2")
    first = sets.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("representative"), F.count("*").alias("equal"))
    members = look_up(sets, saved(first, "equal-sets"), ["k1", "k2", "n"], "equal", "left").select("id", "n", F.coalesce("representative", "id").alias("representative"))
    members = saved(members, "members")
    sketches = base.join(members.where("id = representative").select("id").distinct(), "id", "left_semi").where("kind = 0").select("id", "n", "sketch")
    of = members.where("n > 0 and id is not null").select("id", "representative").distinct()

    lists_ = texts.mapInArrow(postings(k, percent, boundary, frequent), POSTINGS)
    list_ = Window.partitionBy("token", "c")
    shared = lists_.withColumn("all", F.sum("members").over(list_)).where("all > 1").drop("all")
    shared = shared.mapInArrow(_unpacked, "token long, c int, id long, n int, pos int").join(of, "id")
    shared = shared.groupBy("representative", "token", "c", "n").agg(F.min("pos").alias("pos")).withColumnRenamed("representative", "id")
    shared = shared.withColumn("spread", F.count("*").over(Window.partitionBy("id")))
    shared = saved(shared, "lists")

    # Light sets: the smallest member of a subset's list with all that share the subset's key. Keys have 64 bits, so
    # that these pairs too are checked on the sets: one false link would join two components.
    light = shared.where("c > 0")
    pivot = light.groupBy("token", "c").agg(F.min(F.struct("n", "id")).alias("p"), F.count("*").alias("k")).where("k > 1")
    light = light.join(pivot.select("token", "c", "p"), ["token", "c"]).where(f"id <> p.id and c * {100 + percent} >= {percent} * (n + p.n)")
    light = light.select(F.col("id").alias("a"), F.col("p.id").alias("b")).distinct()

    # Heavy sets, first round: every member with its list's pivot, the set with most shared shingles.
    heavy = shared.where("c = 0").drop("c")
    pivot = heavy.groupBy("token").agg(F.max(F.struct("spread", F.xxhash64("id").alias("r"), "id", "n")).alias("p"), F.count("*").alias("k")).where("k > 1")
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    pairs = heavy.join(pivot.select("token", F.col("p.id").alias("b"), F.col("p.n").alias("m")), "token").where(f"id <> b and {fits}")
    pairs = saved(pairs.select(F.col("id").alias("a"), "b").unionByName(light).distinct(), "pairs")
    links = saved(linked(pairs, sketches, texts, k, percent), "links")

    # Second round: members of different components.
    label = components(links)
    named = heavy.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    named = saved(named.join(mixed, "token", "left_semi"), "mixed")
    other = named.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("theirs"))
    need = f"ceil({percent} * (n + m) / {100 + percent}.0)"
    rest = named.join(other, "token").where(f"id < b and component <> theirs and {fits} and least(n - pos, m - at) >= {need}")
    rest = rest.select(F.col("id").alias("a"), "b").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = saved(rest.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        label = components(links.unionByName(linked(rest, sketches, texts, k, percent)))

    out = members.join(label.select(F.col("id").alias("representative"), "component"), "representative", "left")
    return out.select("id", F.col("n").alias("n_shingles"), "representative", F.coalesce("component", "representative").alias("component"))
