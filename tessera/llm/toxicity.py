"""Toxicity categories by a classifier chain of linear models over hashed words and word beginnings.

The chain has one logistic model for each category, in order. A model sees which words a text has, how
large a share of its words begins with certain bytes (4 to 8), and the log odds of all earlier
categories. For training, the earlier categories' probabilities are out of fold: each document's come
from models that did not see it, so a later model learns from what an earlier one can tell of a new
text. Folds go by the hash of the id.

Fitting takes a bounded sample of labelled rows (``SAMPLE``, those with the least hash of their id), near
copies once (of texts with the same least hashes of long words one stays). The features are chosen on
Spark: those of at least ``LEAST`` sample texts whose share differs between the two values of a category
by ``DEVIATIONS`` standard deviations, at most ``MOST`` by that measure. Only their values in the sample
come to the driver. Scoring is one pass over all texts, without a shuffle.

Categories are Boolean expressions over the label columns. The labels here hold one toxicity flag and
a quality flag; the default chain is junk text, toxic, and toxic in otherwise well-formed text.

Defined cases: null and empty texts have no words, and get the models' base rates; a category with one
value only in the sample has its smoothed share as a constant; null ids are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import as_long, batch, bounded, lists, saved
from tessera.llm.words import ALNUM, U64, Words, span_hashes, text_slices

SAMPLE = 6000
LEAST = 8
DEVIATIONS = 6.0
MOST = 4096
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS = 3
THRESHOLD = 0.5
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1", "toxic_wellformed": "toxic = 1 and quality = 1"}


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of each text, flat: hash, value, how many each text has; and a key that near
    copies share. A word's value is 1; a beginning's is log(1 + 100 share of the words)."""
    words = Words(data, offsets, ALNUM, lower=True)
    doc, sizes = words.docs(), words.ends - words.starts
    whole = words.hashes()
    hashes, docs, kinds = [whole], [doc], [np.zeros(len(whole), np.int8)]
    for n in BEGINNINGS:
        long_ = np.flatnonzero(sizes >= n)
        hashes.append(span_hashes(words.data, words.starts[long_], np.full(len(long_), n)) ^ U64(0x5DEECE66D))
        docs.append(doc[long_])
        kinds.append(np.ones(len(long_), np.int8))
    hashes, docs, kinds = np.concatenate(hashes), np.concatenate(docs), np.concatenate(kinds)
    by = np.lexsort((hashes, docs))
    hashes, docs, kinds = hashes[by], docs[by], kinds[by]
    head = np.ones(len(by), bool)
    head[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    heads = np.flatnonzero(head)
    count = np.diff(np.append(heads, len(by)))
    hashes, docs, kinds = hashes[heads], docs[heads], kinds[heads]
    value = np.where(kinds == 0, 1.0, np.log1p(100 * count / (words.counts[docs] + 20)))
    rows = len(offsets) - 1
    rare = np.unique(np.stack([doc[sizes >= 8].astype(U64), whole[sizes >= 8]], axis=1), axis=0) if (sizes >= 8).any() else np.zeros((0, 2), U64)
    first = np.searchsorted(rare[:, 0], np.arange(rows + 1, dtype=U64))
    key = np.array([hash(tuple(rare[a : min(b, a + 5), 1].tolist()) if b - a >= 5 else (k, int(words.counts[k]), *rare[a:b, 1].tolist())) for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))], np.int64)
    return hashes, value.astype(np.float32), np.bincount(docs, minlength=rows), key


@dataclass
class Linear:
    """A logistic model: a weight for each known word, for each earlier category's log odds, and a bias."""

    weight: np.ndarray
    earlier: np.ndarray
    bias: float

    def odds(self, column: np.ndarray, row: np.ndarray, value: np.ndarray, rows: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.weight[column] * value, minlength=rows) + before @ self.earlier + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(column: np.ndarray, row: np.ndarray, value: np.ndarray, y: np.ndarray, before: np.ndarray, width: int, rounds: int = 200, decay: float = 3e-4) -> Linear:
    """Logistic regression on sparse features, both labels weighing the same, by Adam."""
    rows = len(y)
    if not rows or y.min() == y.max():
        share = (y.sum() + 1) / (rows + 2)
        return Linear(np.zeros(width), np.zeros(before.shape[1]), float(np.log(share / (1 - share))))
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(width + before.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        model = Linear(w[:width], w[width:-1], float(w[-1]))
        error = each * (y - _sigmoid(model.odds(column, row, value, rows, before)))
        g = np.concatenate([np.bincount(column, error[row] * value, minlength=width), before.T @ error, [error.sum()]])
        g[:-1] -= decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Linear(w[:width], w[width:-1], float(w[-1]))


def known_features(chosen: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are among the chosen (sorted) features, and their places there."""
    if not len(chosen):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
    known = chosen[at] == hashes
    return known, at[known]


@dataclass
class Chain:
    names: list[str]
    chosen: np.ndarray
    models: list[Linear]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        hashes, value, sizes, _ = features(data, offsets)
        known, column = known_features(self.chosen, hashes)
        row, value = np.repeat(np.arange(rows), sizes)[known], value[known]
        odds = np.zeros((rows, 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.odds(column, row, value, rows, odds), -15, 15)])
        return _sigmoid(odds)


def fit_chain(names: list[str], chosen: np.ndarray, docs: list[tuple[int, np.ndarray, np.ndarray, list[int]]], folds: int = FOLDS) -> Chain:
    """docs: (fold number, chosen features, values, a 0/1 label for each category)."""
    row = np.repeat(np.arange(len(docs)), [len(h) for _, h, *_ in docs])
    _, column = known_features(chosen, np.concatenate([h for _, h, *_ in docs]) if docs else np.zeros(0, U64))
    value = np.concatenate([v for *_, v, _ in docs]).astype(np.float64) if docs else np.zeros(0)
    y = np.array([x for *_, x in docs], np.float64).reshape(len(docs), len(names))
    fold = np.array([f % folds for f, *_ in docs], np.int64)
    earlier, models = np.zeros((len(docs), 0)), []
    for c in range(len(names)):
        models.append(fit_linear(column, row, value, y[:, c], earlier, len(chosen)))
        if c + 1 == len(names):
            break
        out = np.zeros(len(docs))
        for f in range(folds):
            seen = fold != f
            own = seen[row]
            part = fit_linear(column[own], (np.cumsum(seen) - 1)[row[own]], value[own], y[seen, c], earlier[seen], len(chosen))
            out[~seen] = part.odds(column, row, value, len(docs), earlier)[~seen]
        earlier = np.column_stack([earlier, np.clip(out, -15, 15)])
    return Chain(names, chosen, models)


_SAMPLED = pa.schema([("id", pa.int64()), ("fold", pa.int64()), ("y", pa.list_(pa.int32())), ("key", pa.int64()), ("features", pa.list_(pa.int64())), ("value", pa.list_(pa.float32()))])
SAMPLED = "id long, fold long, y array<int>, key long, features array<long>, value array<float>"


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for rows, data, offsets in text_slices(whole):
            hashes, value, sizes, key = features(data, offsets)
            yield batch(_SAMPLED, *(rows.column(k) for k in range(3)), key, lists(hashes.view(np.int64), sizes, pa.int64()), lists(value, sizes, pa.float32()))


def _only(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hashes, value = (np.asarray(rows.column(k).flatten()) for k in (4, 5))
            known, _ = known_features(chosen, hashes.view(U64))
            row = np.repeat(np.arange(rows.num_rows), np.asarray(rows.column(4).value_lengths()))[known]
            sizes = np.bincount(row, minlength=rows.num_rows)
            yield batch(_SAMPLED, *(rows.column(k) for k in range(4)), lists(hashes[known], sizes, pa.int64()), lists(value[known], sizes, pa.float32()))

    return run


def telling(rows: DataFrame, categories: int, least: int = LEAST, deviations: float = DEVIATIONS, most: int = MOST) -> np.ndarray:
    """The features whose presence differs between the labels of some category, sorted."""
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("y", c)).alias(f"n{c}") for c in range(categories)]).first()
    held = rows.select("y", F.explode("features").alias("feature")).groupBy("feature")
    held = held.agg(F.count("*").alias("k"), *[F.sum(F.get("y", c)).alias(f"k{c}") for c in range(categories)]).where(F.col("k") >= least)
    n = totals["n"] or 0
    measures = []
    for c in range(categories):
        ones = totals[f"n{c}"] or 0
        if 0 < ones < n:
            spread = F.sqrt(F.col("k") / n * (1 - F.col("k") / n) * (1 / ones + 1 / (n - ones)) + 1e-12)
            measures.append(F.abs(F.col(f"k{c}") / ones - (F.col("k") - F.col(f"k{c}")) / (n - ones)) / spread)
    if not measures:
        return np.zeros(0, U64)
    best = held.withColumn("best", F.greatest(*measures, F.lit(0.0))).where(F.col("best") >= deviations)
    chosen = best.orderBy(F.desc("best"), "feature").limit(most).select("feature").collect()
    return np.sort(np.array([r["feature"] for r in chosen], np.int64).view(U64))


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Chain:
    """A chain from a bounded sample of the labelled documents."""
    categories = categories or CATEGORIES
    values = F.array(*[F.expr(f"coalesce(cast(({e}) as int), 0)") for e in categories.values()])
    known = labels.select(as_long(labels, id_column).alias("id"), values.alias("y")).where("id is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = bounded(documents).select(as_long(documents, id_column).alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("id", F.expr("pmod(xxhash64(id, 7), 1000)").alias("fold"), "y", "text")
    rows = saved(rows.mapInArrow(_sample_features, SAMPLED), "sample")
    lead = rows.groupBy("key").agg(F.min("id").alias("id")).select("id")
    rows = saved(rows.join(lead, "id", "left_semi"), "sample")
    chosen = telling(rows, len(categories))
    kept = sorted(rows.mapInArrow(_only(chosen), SAMPLED).collect(), key=lambda r: r["id"])
    docs = [(r["fold"], np.array(r["features"], np.int64).view(U64), np.array(r["value"], np.float32), r["y"]) for r in kept]
    return fit_chain(list(categories), chosen, docs)


def scorer(chain: Chain):
    """An Arrow UDF: the probability of each category, by name."""
    kind = pa.struct([(n, pa.float64()) for n in chain.names])

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in chain.names) + ">")
    def score(texts: pa.Array) -> pa.Array:
        out = [chain.probabilities(data, offsets) for _, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
        all_ = np.concatenate(out) if out else np.zeros((0, len(chain.names)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_[:, k])) for k in range(len(chain.names))], fields=list(kind))

    return score


def scored(documents: DataFrame, labels: DataFrame, into: str = "toxicity", text_column: str = "text", **options) -> DataFrame:
    """The documents with a struct of category probabilities."""
    chain = train(documents, labels, text_column=text_column, **options)
    return bounded(documents).withColumn(into, scorer(chain)(F.col(f"`{text_column}`").cast("string")))
