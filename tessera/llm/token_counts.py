"""Token counts by rank-synchronous array merging.

The pre-tokens of a slice of texts lie in one ragged array of symbols. In each round every sequence
finds the lowest-ranked pair of its neighbours, and all sequences apply theirs at once; a sequence
without a ranked pair is done, and its surviving symbols are its tokens. Distinct pre-tokens are
merged once a slice, and a bounded table in each worker remembers them for the next slices.

The vocabulary is a ``tokenizers`` BPE file with an end-of-word suffix, NFC and lower-case
normalisation and a letter / digit / other split (word_bpe_49k.json); its path is a parameter.
No shuffle, nothing broadcast but the path.

Defined cases: null texts count as empty, 0 tokens; the strings of special tokens inside a text are
one token each, as the library has it by default; no token is added; null ids are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import batch, text_rows
from tessera.llm.words import ragged, span_hashes, trim

LIMIT = 2048
REMEMBERED = 1 << 20
SLICE_CHARS = 1 << 19

#: Code points with the White_Space property (fixed values).
WHITE_SPACE = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, digit, white space, other."""
    kinds = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kinds[cp] = LETTER
        elif c == "N":
            kinds[cp] = DIGIT
    kinds[list(WHITE_SPACE)] = SPACE
    return kinds


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The merges of a vocabulary file as sorted arrays, and the symbols that bytes start as."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], byte_letters()
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([ids.get(c, -1) for c in letters], np.int64)
        self.last = np.array([ids.get(c + suffix, -1) for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[by], by, made
        self.none = len(keys)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.seen, self.seen_sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged(symbols: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Applies the merges to ragged sequences: the surviving symbols, and how many each sequence has."""
    done_symbols, done_sizes, done_of = [], [], []
    live = np.flatnonzero(sizes > 0)
    sizes = sizes[live]
    while len(live):
        starts = np.cumsum(sizes) - sizes
        ranks = np.full(len(symbols), vocab.none, np.int64)
        ranks[:-1] = vocab.rank(symbols[:-1], symbols[1:])
        ranks[starts + sizes - 1] = vocab.none  # no pair across the end of a sequence
        lowest = np.minimum.reduceat(ranks, starts)
        over = lowest == vocab.none
        if over.any():
            mask = np.repeat(over, sizes)
            done_symbols.append(symbols[mask])
            done_sizes.append(sizes[over])
            done_of.append(live[over])
            symbols, ranks = symbols[~mask], ranks[~mask]
            live, sizes, lowest = live[~over], sizes[~over], lowest[~over]
            if not len(live):
                break
        hit = ranks == np.repeat(lowest, sizes)
        at = np.flatnonzero(hit)
        if len(at) > 1:  # of overlapping pairs (a a a) every second one merges, from the left
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1] + 1
            run = np.flatnonzero(head)
            step = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[step % 2 == 0]
        symbols[at] = vocab.made[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        gone = np.add.reduceat((~keep).astype(np.int64), np.cumsum(sizes) - sizes)
        symbols, sizes = symbols[keep], sizes - gone
    if not done_of:
        return symbols[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_symbols), np.concatenate(done_sizes), np.concatenate(done_of)


def pre_tokens(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pre-tokens among the code points of normalised texts (bounds: of the texts).

    Runs of letters, single digits, runs of others; an apostrophe that starts a run and is followed by
    s, t, m, d, re, ve or ll makes a pre-token with it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = _classes()[codes]
    before = np.empty(n, np.uint8)
    before[0] = SPACE
    before[1:] = kinds[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = SPACE
    start = (kinds != SPACE) & ((kinds != before) | (kinds == DIGIT))
    quote = np.flatnonzero((codes == 0x27) & start)
    if len(quote):
        limit = bounds[np.searchsorted(bounds, quote, "right")]
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        one = np.where(quote + 1 < limit, padded[quote + 1], 0)
        two = np.where(quote + 2 < limit, padded[quote + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size in ((quote[short], 2), (quote[long_], 3)):
            start[at + 1] = False
            after = at + size
            inside = after < n
            after = after[inside]
            after = after[before[after] != SPACE] if len(after) else after
            after = after[kinds[after] != SPACE]
            start[after] = True
    starts = np.flatnonzero(start)
    edge = np.zeros(n + 1, bool)
    edge[:n] = start | (kinds == SPACE)
    edge[bounds] = True
    edge[n] = True
    return starts, np.flatnonzero(edge)[np.cumsum(edge)[starts]]


class Pieces:
    """The pre-tokens of a slice: of each its distinct form (``which``), of each form its symbols."""

    def __init__(self, texts: list[str], vocab: Vocabulary):
        normal = [unicodedata.normalize("NFC", t) for t in texts]
        normal = [t.replace("Σ", "σ").lower() for t in normal]
        whole = "".join(normal)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in normal])]).astype(np.int64)
        starts, ends = pre_tokens(codes, bounds)
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        wide = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))])
        self.bounds = np.searchsorted(starts, bounds)
        self.data, self.starts, self.sizes = data, wide[starts], wide[ends] - wide[starts]
        hashes = span_hashes(data, self.starts, self.sizes)
        self.hashes, self.first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.vocab = vocab

    def symbols(self, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the named forms as start symbols, flat, and the size of each."""
        at, sizes = self.starts[self.first[forms]], self.sizes[self.first[forms]]
        raw = self.data[ragged(at, sizes)]
        symbols = self.vocab.inner[raw]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.vocab.last[raw[last]]
        return symbols, sizes

    def counts(self) -> np.ndarray:
        """Tokens of each form; forms met before come from the worker's table."""
        v = self.vocab
        out = np.zeros(len(self.hashes), np.int64)
        at = np.minimum(np.searchsorted(v.seen, self.hashes), max(len(v.seen) - 1, 0))
        known = v.seen[at] == self.hashes if len(v.seen) else np.zeros(len(self.hashes), bool)
        out[known] = v.seen_sizes[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            symbols, sizes = self.symbols(new)
            _, left, of = merged(symbols, sizes, v)
            out[new[of]] = left
            if len(v.seen) + len(new) > REMEMBERED:
                v.seen, v.seen_sizes = v.seen[:0], v.seen_sizes[:0]
            keys, sizes = np.concatenate([v.seen, self.hashes[new]]), np.concatenate([v.seen_sizes, out[new]])
            by = np.argsort(keys)
            v.seen, v.seen_sizes = keys[by], sizes[by]
        return out


def parts(texts: list[str], vocab: Vocabulary) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
    """The texts cut at the strings of special tokens: the parts, the text of each part, and for each
    special token met (part it follows, id)."""
    if vocab.special_pattern is None or not any(s in t for t in texts for s in vocab.special):
        return texts, np.arange(len(texts)), []
    out, of, special = [], [], []
    for k, t in enumerate(texts):
        for j, x in enumerate(vocab.special_pattern.split(t)):
            if j % 2:
                special.append((len(out) - 1, vocab.special[x]))
            else:
                out.append(x)
                of.append(k)
    return out, np.array(of), special


def text_tokens(texts: list[str], vocab: Vocabulary) -> np.ndarray:
    """The number of tokens of each text."""
    cut, of, special = parts(texts, vocab)
    pieces = Pieces(cut, vocab)
    per_piece = pieces.counts()[pieces.which]
    sums = np.concatenate([[0], np.cumsum(per_piece)])
    per_part = sums[pieces.bounds[1:]] - sums[pieces.bounds[:-1]]
    out = np.bincount(of, per_part, minlength=len(texts)).astype(np.int64)
    for part, _ in special:
        out[of[part]] += 1
    return out


def char_slices(column: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``most`` characters each; null is empty."""
    texts, size, first = [], 0, 0
    for k, t in enumerate(column.to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size >= most:
            yield first, texts
            texts, size, first = [], 0, k + 1
    if texts:
        yield first, texts
    trim()


_COUNTED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows in batches:
            for first, texts in char_slices(rows.column(1)):
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield batch(_COUNTED, rows.column(0).slice(first, len(texts)), sizes, text_tokens(texts, vocab))

    return run


def token_counts(documents: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text. ``path``: the vocabulary file, the same on all machines."""
    counted = text_rows(documents, id_column, text_column).mapInArrow(counter(path or default_path()), "id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
