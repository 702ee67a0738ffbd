"""Cost-balanced packing of documents into token sequences.

A task tokenises its documents and packs them in groups of about ``GROUP_TOKENS`` tokens, in one pass
without a shuffle. In a group, documents of a whole sequence or more give full sequences; the rest
are taken by descending estimated cost, linear in their tokens plus quadratic (attention within the
document), and each goes to the sequence of least cost that has room for it. A document that fits
nowhere whole is cut: the least costly sequence with room takes what fits, the rest waits its turn by
its new size.

The sequences of a group hold exactly its tokens: full ones, and for what is left, sequences of
powers of two, which need no padding.

Memory is bounded by a group (a document is held whole). Sequence ids are made of the task's
partition number and a running number, so a task that is run again makes the same rows.

Defined cases: a null or empty text is a document of the end token alone; null ids and repeated rows
are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.arrow import batch, text_rows
from tessera.llm.token_counts import Pieces, Vocabulary, char_slices, default_path, merged, parts, vocabulary
from tessera.llm.words import ragged

LENGTH = 4096
END = 2
GROUP_TOKENS = 1 << 21
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def text_ids(texts: list[str], vocab: Vocabulary, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of the texts, each closed by ``end``: flat (unsigned 32 bit), and the bounds."""
    cut, of, special = parts(texts, vocab)
    pieces = Pieces(cut, vocab)
    symbols, sizes = pieces.symbols(np.arange(len(pieces.hashes)))
    flat, left, of_form = merged(symbols, sizes, vocab)
    form_size = np.zeros(len(pieces.hashes), np.int64)
    form_start = np.zeros(len(pieces.hashes), np.int64)
    form_size[of_form] = left
    form_start[of_form] = np.cumsum(left) - left
    size = form_size[pieces.which]
    sums = np.concatenate([[0], np.cumsum(size)])
    part_size = sums[pieces.bounds[1:]] - sums[pieces.bounds[:-1]]
    ids = flat[ragged(form_start[pieces.which], size)]
    # what follows each part: the special token there, and the end after a text's last part
    after = np.zeros(len(cut), np.int64)
    last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    after[last] += 1
    value = np.full(len(cut), end, np.int64)
    for part, token in special:
        after[part] += 1
        value[part] = token
    places = np.cumsum(part_size) + np.cumsum(after) - after
    out = np.empty(len(ids) + int(after.sum()), "<u4")
    filled = np.zeros(len(out), bool)
    out[places[after > 0]] = value[after > 0]
    filled[places[after > 0]] = True
    out[~filled] = ids
    doc_size = np.bincount(of, part_size + after, minlength=len(texts)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(doc_size)])


def capacities(tokens: int, length: int = LENGTH) -> list[int]:
    """Full sequences, and for the rest sequences of powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) of a group of documents, by the rule above."""
    import heapq

    out, sequence, rest = [], 0, []
    for k, n in enumerate(sizes):
        whole = n // length
        for j in range(whole):
            out.append((k, j * length, length, sequence, 0))
            sequence += 1
        if n % length:
            rest.append((-(n % length), k, whole * length))  # the cost rises with the size, so sizes give its order
    room = np.array(capacities(-sum(x[0] for x in rest), length), np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    heapq.heapify(rest)
    while rest:
        n, k, start = heapq.heappop(rest)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
        at = int(np.where(fits, cost, np.inf).argmin())
        put = min(n, int(room[at]))
        out.append((k, start, put, sequence + at, int(used[at])))
        used[at] += put
        room[at] -= put
        cost[at] += linear * put + quadratic * put * put
        if put < n:
            heapq.heappush(rest, (put - n, k, start + put))
    return out


_PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packer(path: str, length: int, end: int, group_tokens: int):
    def close(held: list, sequence: int) -> tuple[Iterator[pa.RecordBatch], int]:
        ids = [x for x, _ in held]
        docs = [x for _, x in held]
        pieces = assign([len(x) for x in docs], length)
        pieces.sort(key=lambda p: (p[3], p[4]))
        rows = []
        for a in range(0, len(pieces), 1024):
            some = pieces[a : a + 1024]
            rows.append(batch(_PIECES, [ids[k] for k, *_ in some], [s for _, s, *_ in some], [n for _, _, n, *_ in some], [docs[k][s : s + n].tobytes() for k, s, n, *_ in some], [len(docs[k]) for k, *_ in some], [sequence + q for *_, q, _ in some], [o for *_, o in some]))
        return iter(rows), sequence + (pieces[-1][3] + 1 if pieces else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        sequence = TaskContext.get().partitionId() << 40
        held, size = [], 0
        for rows in batches:
            names = rows.column(0).to_pylist()
            for first, texts in char_slices(rows.column(1)):
                ids, bounds = text_ids(texts, vocab, end)
                for k in range(len(texts)):
                    held.append((names[first + k], ids[bounds[k] : bounds[k + 1]]))
                    size += len(held[-1][1])
                    if size >= group_tokens:
                        out, sequence = close(held, sequence)
                        yield from out
                        held, size = [], 0
        if held:
            yield from close(held, sequence)[0]

    return run


def packed(documents: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, end: int = END, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row a piece: (id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are the piece's
    token ids as little-endian unsigned 32-bit integers."""
    return text_rows(documents, id_column, text_column).mapInArrow(packer(path or default_path(), length, end, group_tokens), PIECES)
