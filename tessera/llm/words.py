"""Vectorised word and n-gram hashing over Arrow string batches.

The functions here run inside tasks, on a slice of one Arrow batch at a time (a few MB), so their
memory does not depend on the size of a partition. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words that white space (0x20, 0x09-0x0D) ends.
NON_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words made of letters, digits and anything outside ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(29)
    return h


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on between tasks."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)
    pa.default_memory_pool().release_unused()


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a batch with about ``most`` text bytes each: (rows, bytes, offsets)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null takes no bytes in Spark's batches; make sure of it
        null = np.asarray(col.is_null())
        if (np.diff(offsets)[null] > 0).any():
            yield from text_slices(batch.set_column(batch.schema.get_field_index(column), column, col.fill_null("")), column, most)
            return
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(col))
        own = offsets[at : to + 1]
        yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
        at = to
    trim()


class Words:
    """The words of a slice: start and end bytes of each, and for each document the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            before[edge[:n]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = before
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
            after[edge[1:]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def docs(self) -> np.ndarray:
        """The document (row of the slice) of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes, eight bytes a step."""
        return span_hashes(self.data, self.starts, self.ends - self.starts)


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)
    h = lengths.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D)
    live, at, left = None, starts, lengths
    while len(at):
        chunk = eights[at] & masks[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ chunk)
        else:
            h[live] = mix(h[live] ^ chunk)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of sequences from the hashes of their two parts (order matters)."""
    h = left * U64(0xFF51AFD7ED558CCD)
    h += right
    h += U64(0x632BE59BD9B4E019)
    return mix(h)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive values from each position on; the last n - 1 positions have none.

    Sequences double: the hash of 2k values joins the hashes of two neighbouring runs of k.
    """
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    done, have, level, size = None, 0, words, 1
    while True:
        if n & size:
            done, have = (level, size) if done is None else (join_hashes(done[: len(words) - have - size + 1], level[have : have + len(words) - have - size + 1]), have + size)
        if size * 2 > n:
            return done
        level = join_hashes(level[: len(level) - size], level[size:])
        size *= 2


def gram_starts(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which positions start n words of one document (a mask over ``total`` words)."""
    ok = np.zeros(total, dtype=bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            ok[a : b - n + 1] = True
    return ok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift
