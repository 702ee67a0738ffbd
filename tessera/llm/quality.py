"""Document quality by a linear-chain conditional random field over lines.

Every line of words gets features of its own (repeats, symbols, case, shape) and the means of its
neighbours'. The field labels lines good or bad; forward-backward marginals, weighted by the lines'
bytes, give a document's share of good text, and a logistic curve fitted on a held-back part of the
sample turns that into the probability of label 1.

Fitting takes a bounded sample of labelled rows (``SAMPLE``; those with the least hash of their id);
its lines' features come to the driver, its texts don't. Each line of a sample document carries the
document's label. Scoring is an Arrow UDF in one pass over all texts, without a shuffle.

Neither labels nor id, language or source are features. Defined cases: a text without words, or null,
has the smoothed share of label 1 as its score; without usable labels every score is that share (0.5
for none at all); null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import as_long, batch, bounded, inner_name
from tessera.llm.words import NON_SPACE, Words, span_hashes, text_slices

SAMPLE = 4000
THRESHOLD = 0.7
ROUNDS = 150


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], dtype=bool)


UPPER = _class(lambda b: 0x41 <= b <= 0x5A)
LETTER = _class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0)
DIGIT = _class(lambda b: 0x30 <= b <= 0x39)
MARKS = _class(lambda b: chr(b) in "#$%&*+=@^_~<>{}[]\\/")
BAR = _class(lambda b: b == 0x7C)
SHOUT = _class(lambda b: b in (0x21, 0x3F))
STOP = _class(lambda b: chr(b) in ".,;:")
HIGH = _class(lambda b: b >= 0x80)
FEATURES = 16


class Lines:
    """The lines with words of a slice: features, bytes, and the range of each document's lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, NON_SPACE)
        n = len(words)
        docs = len(offsets) - 1
        if not n:
            self.x, self.size, self.bounds = np.zeros((0, 2 * FEATURES), np.float32), np.zeros(0), np.zeros(docs + 1, np.int64)
            return
        doc = words.docs()
        feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
        line = feeds[words.starts] + doc
        head = np.ones(n, bool)
        head[1:] = line[1:] != line[:-1]
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        start, end = words.starts[first], words.ends[last]
        self.size = (end - start).astype(np.float64)
        count = (last - first + 1).astype(np.float64)
        hashes = words.hashes()
        line_of = np.cumsum(head) - 1
        own = doc[first]
        self.bounds = np.searchsorted(own, np.arange(docs + 1))

        def share(table: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            return sums[end] - sums[start]

        same = np.zeros(n)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        short = (words.ends - words.starts) <= 3
        letters = share(LETTER)
        whole = span_hashes(data, start, end - start)
        by = np.lexsort((whole, own))
        again = np.zeros(len(first))
        twin = (whole[by][1:] == whole[by][:-1]) & (own[by][1:] == own[by][:-1])
        again[by[1:]] = twin
        again[by[:-1]] = np.maximum(again[by[:-1]], twin)
        closing = data[end - 1]
        x = np.column_stack(
            [
                np.bincount(line_of, same) / count,
                np.minimum(share(MARKS) / count, 3),
                np.minimum(share(BAR) / count, 2),
                np.minimum(share(SHOUT) / count, 2),
                share(UPPER) / np.maximum(letters, 1),
                share(DIGIT) / self.size,
                share(STOP) / count,
                share(HIGH) / self.size,
                letters / self.size,
                np.log1p(count),
                np.minimum(self.size / count, 30) / 10,
                np.bincount(line_of, short) / count,
                again,
                STOP[closing] | SHOUT[closing],
                UPPER[data[start]] | HIGH[data[start]],
                np.bincount(line_of, same) > 3,
            ]
        ).astype(np.float32)
        around, sides = np.zeros_like(x), np.zeros((len(x), 1), np.float32)
        joined = np.flatnonzero(own[1:] == own[:-1])
        around[joined + 1] += x[joined]
        around[joined] += x[joined + 1]
        sides[joined + 1] += 1
        sides[joined] += 1
        self.x = np.concatenate([x, around / np.maximum(sides, 1)], axis=1)


def marginals(score: np.ndarray, move: np.ndarray, bounds: np.ndarray):
    """Forward-backward over all documents of a slice at once, longest first.

    ``score``: each line's log odds of good; ``move``: 2 x 2 weights of neighbouring labels. Returns each
    line's probability of good, and each neighbouring pair's probabilities (from, to), by the second line.
    """
    n, sizes = len(score), np.diff(bounds)
    node = np.exp(np.clip(np.stack([-score, score], axis=1) / 2, -30, 30))
    edge = np.exp(move)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # documents that reach line t
    ahead, back = np.ones((n, 2)), np.ones((n, 2))
    for t, k in enumerate(live.tolist()):
        at = starts[:k] + t
        a = node[at] * (ahead[at - 1] @ edge if t else 1.0)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        b = (node[at + 1] * back[at + 1]) @ edge.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    second = np.ones(n, bool)
    second[bounds[:-1][np.diff(bounds) > 0]] = False
    at = np.flatnonzero(second)
    pair = ahead[at - 1][:, :, None] * edge[None] * (node[at] * back[at])[:, None, :]
    return good, pair / pair.sum(axis=(1, 2), keepdims=True), at


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    move: np.ndarray
    slope: float
    shift: float
    prior: float

    def share_good(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the lines' marginals (nan without lines)."""
        score = ((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1]
        good = marginals(score, self.move, bounds)[0]
        sums = np.concatenate([[0], np.cumsum(good * size)]), np.concatenate([[0], np.cumsum(size)])
        top, all_ = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        return np.where(all_ > 0, top / np.maximum(all_, 1), np.nan)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lines = Lines(data, offsets)
        if not len(lines.size) or not self.slope:
            return np.full(len(offsets) - 1, self.prior)
        share = self.share_good(lines.x, lines.size, lines.bounds)
        score = 1 / (1 + np.exp(-np.clip(self.slope * _logit(share) + self.shift, -30, 30)))
        return np.where(np.isnan(share), self.prior, score)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = ROUNDS, decay: float = 1e-3) -> Model:
    """Fits the field by its likelihood (Adam on the whole sample, every document of equal weight), and
    the curve on every third document, which the field doesn't see. docs: (label, features, bytes)."""
    labels = np.array([y for y, *_ in docs], np.float64)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    zero = Model(np.zeros(2 * FEATURES), np.ones(2 * FEATURES), np.zeros(2 * FEATURES + 1), np.zeros((2, 2)), 0.0, 0.0, prior)
    docs = [d for d in docs if len(d[2])]
    train, rest = [d for k, d in enumerate(docs) if k % 3], [d for k, d in enumerate(docs) if not k % 3]
    if len({y for y, *_ in train}) < 2 or len({y for y, *_ in rest}) < 2:
        return zero

    def joined(some):
        bounds = np.concatenate([[0], np.cumsum([len(s) for *_, s in some])])
        return np.concatenate([x for _, x, _ in some]).astype(np.float64), np.concatenate([s for *_, s in some]), bounds, np.array([y for y, *_ in some], np.float64)

    x, _, bounds, y = joined(train)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels weigh the same
    line_weight = (share / sizes)[doc]
    target = y[doc]
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    first, second = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    for k in range(1, rounds + 1):
        good, pair, at = marginals(x @ w, move, bounds)
        seen = np.zeros_like(pair)
        label = target[at].astype(int)
        seen[np.arange(len(at)), label, label] = 1
        grads = [x.T @ (line_weight * (target - good)) - decay * w, ((seen - pair) * line_weight[at][:, None, None]).sum(axis=0) - 10 * decay * move]
        for j, (p, g) in enumerate(zip((w, move), grads, strict=True)):
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
            p += 0.1 * (first[j] / (1 - 0.9**k)) / (np.sqrt(second[j] / (1 - 0.999**k)) + 1e-8)
    model = Model(mean, scale, w, move, 1.0, 0.0, prior)
    x, size, bounds, y = joined(rest)
    z = _logit(model.share_good(x, size, bounds))
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Newton steps, with a little decay so that separable samples stay finite
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([((y - p) * z).mean() - 0.01 * (slope - 1), (y - p).mean() - 0.01 * shift])
        v = p * (1 - p)
        h = np.array([[(v * z * z).mean() + 0.01, (v * z).mean()], [(v * z).mean(), v.mean() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, shift = slope + float(step[0]), shift + float(step[1])
        if abs(step).max() < 1e-6:
            break
    model.slope, model.shift = max(slope, 1e-3), shift
    return model


def sampled(documents: DataFrame, labels: DataFrame, label: str, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, y, text) of at most so many labelled documents: those whose id has the least hash."""
    known = labels.select(as_long(labels, id_column).alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = bounded(documents).select(as_long(documents, id_column).alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "id").select("id", "y", "text")


_FITTED = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("x", pa.binary()), ("size", pa.binary())])


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for rows, data, offsets in text_slices(whole):
            lines = Lines(data, offsets)
            cut = list(zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist(), strict=True))
            yield batch(_FITTED, rows.column(0), rows.column(1), [lines.x[a:b].tobytes() for a, b in cut], [lines.size[a:b].tobytes() for a, b in cut])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **columns) -> Model:
    """A model from a bounded sample of the labelled documents."""
    rows = sampled(documents, labels, label, sample, **columns).mapInArrow(_line_features, "id long, y int, x binary, size binary").collect()
    docs = [(r["y"], np.frombuffer(r["x"], np.float32).reshape(-1, 2 * FEATURES), np.frombuffer(r["size"], np.float64)) for r in sorted(rows, key=lambda r: r["id"])]
    return fit(docs)


def scorer(model: Model):
    """An Arrow UDF: the score of each text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [model.scores(data, offsets) for _, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def trainable(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The label rows to learn from: those whose crc32 of the id as text isn't 2 modulo 4."""
    return labels.where(~held_out(F.col(f"`{id_column}`")))


def held_out(id_):
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(documents: DataFrame, labels: DataFrame, into: str = "score", text_column: str = "text", **options) -> DataFrame:
    """The documents with the quality of their text (0 to 1)."""
    model = train(documents, trainable(labels), text_column=text_column, **options)
    return bounded(documents).withColumn(into, scorer(model)(F.col(f"`{text_column}`").cast("string")))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents, all their columns, whose score reaches the threshold; every column name may occur."""
    own = inner_name(documents, "score")
    return scored(documents, labels, own, **options).where(F.col(own) >= threshold).drop(own)
