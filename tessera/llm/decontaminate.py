"""Benchmark decontamination with suffix arrays of the training words.

Every task sorts the suffixes of its shard of training documents (about 2 MB of text at a time) and
binary-searches every suffix of the test items in that array, all at once. What comes out are the
longest verbatim matches with their places; a document word is hit when it lies in a whole window
(13 words by default; an item with fewer words is one window) that occurs in the document.

No shuffle of documents. The test items lie in the shared store in blocks of bounded size (``block_words``). Workers
read them there and hold one block at a time, the driver none; each block is a UDF of the same pass, and the
matched spans of a document's blocks are joined in its row.

Defined cases: null or empty texts have no words (n_words 0, clean); null ids are kept; repeated
items give one match per item id; repeated documents are judged each on its own; an empty benchmark
leaves everything clean; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import bounded, inner_name, lists, shared_dir, text_rows
from tessera.llm.words import ALNUM, Words, ragged, text_slices

WINDOW = 13
BLOCK_WORDS = 2_000_000

_SPANS = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
SPANS = "struct<n_words: long, starts: array<int>, lengths: array<int>, items: array<string>>"


class TestItems:
    """One block of test items: word hashes in sequence, and the suffixes that start a window."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int):
        col = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        hashes, owner, left = [], [], []
        for at, (rows, data, offsets) in enumerate(text_slices(col, most=1 << 40)):
            assert at == 0
            words = Words(data, offsets, ALNUM, lower=True)
            hashes, owner = words.hashes(), words.docs()
            left = np.repeat(words.bounds[1:], words.counts) - np.arange(len(words))
        self.ids, self.window = ids, window
        self.hashes, self.owner, self.left = (np.asarray(x) for x in (hashes, owner, left))
        self.vocabulary = np.unique(self.hashes) if len(self.hashes) else np.zeros(0, np.uint64)
        self.codes = np.searchsorted(self.vocabulary, self.hashes).astype(np.int64) + 1
        self.need = np.minimum(window, np.bincount(self.owner, minlength=len(ids))[self.owner]) if len(self.codes) else self.left
        self.suffixes = np.flatnonzero(self.left >= self.need) if len(self.codes) else np.zeros(0, np.int64)


def suffix_array(codes: np.ndarray, depth: int, alphabet: int) -> np.ndarray:
    """Positions with a known word, sorted by the ``depth`` words that start there.

    Word codes are packed several to a 64-bit key; after each key only the runs that are still equal
    are sorted again, by the next. Code 0 (a word of no test item, or a document's end) sorts first.
    """
    bits = max(1, int(alphabet).bit_length())
    pack = max(1, 63 // bits)
    padded = np.concatenate([codes, np.zeros(depth + 2 * pack, np.int64)])
    keys = np.zeros(len(codes) + depth + pack, np.int64)
    for k in range(pack):
        keys |= padded[k : k + len(keys)] << np.int64(bits * (pack - 1 - k))
    order = np.flatnonzero(codes)
    live, group = np.arange(len(order)), np.zeros(len(order), np.int64)
    for at in range(0, depth, pack):
        key = keys[order[live] + at]
        by = np.lexsort((key, group[live])) if at else np.argsort(key)
        order[live], key, own = order[live][by], key[by], group[live]
        same = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (key[1:] & ((1 << bits) - 1) > 0)
        if not same.any():
            break
        group[live[1:]] = np.cumsum(~same)
        group[live[:1]] = 0
        touched = np.zeros(len(live), bool)
        touched[1:] |= same
        touched[:-1] |= same
        live = live[touched]
    return order


def bisect(words: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Where ``want`` falls among the depth-th words of the suffixes in [low, high), for all at once."""
    low, high = low.copy(), high.copy()
    while (wide := np.flatnonzero(low < high)).size:
        mid = (low[wide] + high[wide]) >> 1
        seen = words[order[mid] + depth]
        right = seen <= want[wide] if after else seen < want[wide]
        low[wide[right]] = mid[right] + 1
        high[wide[~right]] = mid[~right]
    return low


def search(codes: np.ndarray, order: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of the items that starts a window, the range of the suffix array that agrees
    with it in the whole window (empty where none does). The range narrows word by word."""
    low, high = np.zeros(len(items.suffixes), np.int64), np.full(len(items.suffixes), len(order), np.int64)
    padded = np.concatenate([codes, np.zeros(items.window + 1, np.int64)])
    need = items.need[items.suffixes]
    live = np.arange(len(items.suffixes))
    for depth in range(items.window):
        live = live[(need[live] > depth) & (low[live] < high[live])]
        if not len(live):
            break
        want = items.codes[items.suffixes[live] + depth]
        a = bisect(padded, order, depth, low[live], high[live], want, False)
        b = bisect(padded, order, depth, a, high[live], want, True)
        low[live], high[live] = a, b
    return low, high


def slice_matches(data: np.ndarray, offsets: np.ndarray, items: TestItems):
    """Words per document, and the matched spans of one slice: (counts, document, first word, words, item)."""
    words = Words(data, offsets, ALNUM, lower=True)
    none = np.zeros(0, np.int64)
    if not len(words) or not len(items.suffixes):
        return words.counts, none, none, none, none
    hashes = words.hashes()
    at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    codes = np.zeros(len(words) + len(words.counts), np.int64)  # a zero ends every document
    codes[np.arange(len(words)) + words.docs()] = np.where(items.vocabulary[at] == hashes, at + 1, 0)
    order = suffix_array(codes, items.window, len(items.vocabulary))
    low, high = search(codes, order, items)
    runs = high - low
    places = order[ragged(low, runs)]
    suffix = np.repeat(items.suffixes, runs)
    heads = words.bounds[:-1] + np.arange(len(words.counts))
    doc = np.searchsorted(heads, places, "right") - 1
    first = places - heads[doc]
    by = np.lexsort((first, suffix - first, doc))
    doc, first, suffix = doc[by], first[by], suffix[by]
    owner, length = items.owner[suffix], items.need[suffix]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1) | (suffix[1:] != suffix[:-1] + 1)
    heads = np.flatnonzero(head)  # ... are one longer match
    sizes = np.diff(np.append(heads, len(doc)))
    return words.counts, doc[heads], first[heads], length[heads] + sizes - 1, owner[heads]


@lru_cache(maxsize=1)
def loaded(store: str, block: int, window: int) -> TestItems:
    """A block of test items from the shared store; a worker holds one at a time."""
    from pyarrow import dataset, fs

    files, root = fs.FileSystem.from_uri(f"{store}/block={block}")
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return TestItems([], [], window)
    rows = dataset.dataset(root, filesystem=files, format="parquet").to_table(["item", "text"])
    return TestItems(rows["item"].to_pylist(), rows["text"].to_pylist(), window)


def spans_of(store: str, block: int, window: int):
    """An Arrow UDF: the words and the matched spans of each text, for a block of test items."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        items = loaded(store, block, window)
        counts, per_doc, firsts, lengths, owners = [], [], [], [], []
        for _, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            own, doc, first, length, owner = slice_matches(data, offsets, items)
            counts.append(own)
            per_doc.append(np.bincount(doc, minlength=len(own)))
            for into, x in ((firsts, first), (lengths, length), (owners, owner)):
                into.append(x)
        if not counts:
            return pa.array([], type=_SPANS)
        sizes = np.concatenate(per_doc)
        names = np.array([*items.ids, None], dtype=object)[np.concatenate(owners)]
        columns = [pa.array(np.concatenate(counts), pa.int64()), lists(np.concatenate(firsts), sizes, pa.int32()), lists(np.concatenate(lengths), sizes, pa.int32()), lists(names, sizes, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(_SPANS))

    return spans


def item_blocks(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> tuple[str, int]:
    """Writes the test items to the shared store in blocks of about ``block_words`` words; (folder, how many).
    Items without an id are left out: nothing could name them."""
    rows = benchmark.select(F.col(f"`{item_column}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.where("item is not null")
    words = rows.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    n, store = max(1, math.ceil(words / block_words)), shared_dir(benchmark.sparkSession, "items")
    rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(store)
    return store, n


def judge(n_words: int, starts, lengths, items, share: int = 20) -> tuple[int, int, str, bool]:
    """Hit words (the union of the spans), items, their digest, and the verdict of the rule."""
    hit, end = 0, 0
    for a, n in sorted(zip(starts, lengths, strict=True)):
        hit += max(0, a + n - max(a, end))
        end = max(end, a + n)
    names = sorted(set(items))
    return hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and share * hit >= n_words


VERDICT = "struct<n_hit: long, n_items: long, items_sha256: string, contaminated: boolean>"
_VERDICT = pa.struct([("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def verdicts():
    """An Arrow UDF: the rule's verdict from a document's words and matched spans."""

    @F.arrow_udf(VERDICT)
    def verdict(matches: pa.Array) -> pa.Array:
        clean, names = judge(0, (), (), ()), [f.name for f in _VERDICT]
        rows = [judge(n, s, w, i) if s else clean for n, s, w, i in zip(*(matches.field(k).to_pylist() for k in ("n_words", "starts", "lengths", "items")), strict=True)]
        return pa.array([dict(zip(names, r, strict=True)) for r in rows], type=_VERDICT)

    return verdict


def verbatim_matches(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", into: str = "matches", window: int = WINDOW, **options) -> DataFrame:
    """The documents with a column ``into``: n_words, and for every longest verbatim match of at least
    a window its first word, its length in words and the item. Blocks of items are searched one
    beside the other, in the same pass."""
    text = F.col(f"`{text_column}`").cast("string")
    store, n = item_blocks(benchmark, **options)
    found = bounded(documents).withColumns({f"{into}_{k}": spans_of(store, k, window)(text) for k in range(n)})
    if n == 1:
        return found.withColumn(into, F.col(f"{into}_0")).drop(f"{into}_0")
    joined = {c: F.concat(*[F.col(f"{into}_{k}.{c}") for k in range(n)]).alias(c) for c in ("starts", "lengths", "items")}
    return found.withColumn(into, F.struct(F.col(f"{into}_0.n_words").alias("n_words"), *joined.values())).drop(*[f"{into}_{k}" for k in range(n)])


def contamination(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    found = verbatim_matches(text_rows(documents, id_column, text_column), benchmark, **options)
    found = found.select("id", "matches").withColumn("v", verdicts()("matches"))
    return found.select(F.col("id").alias("doc_id"), F.col("matches.n_words").alias("n_words"), "v.n_hit", "v.n_items", "v.items_sha256", "v.contaminated")


def decontaminated(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The documents, all their columns, without the contaminated ones; every column name may occur."""
    own = inner_name(documents, "matches")
    found = verbatim_matches(documents, benchmark, text_column, own, **options)
    return found.where(~verdicts()(own)["contaminated"]).select(*[F.col(f"`{c}`") for c in documents.columns])
