"""Relevance metrics of ranked results (qid, id, rank) against grades (qid, id, grade)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import wilson


def score_queries(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """One row for each query with a relevant document: hit at 1 and 3, reciprocal rank, recall and nDCG at k."""
    relevant = grades.where("grade > 0")
    hits = relevant.join(ranked, ["qid", "id"], "left")
    gain = F.pow(2.0, F.col("grade").cast("double")) - 1
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "id"))
    rows = hits.withColumn("ideal", ideal_rank)
    found = F.when(F.col("rank") <= k, 1).otherwise(0)
    return rows.groupBy("qid").agg(
        F.coalesce(F.max((F.col("rank") == 1).cast("int")), F.lit(0)).alias("p1"),
        F.coalesce(F.max((F.col("rank") <= 3).cast("int")), F.lit(0)).alias("p3"),
        F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.sum(found) / F.count("*"), 6).alias("recall"),
        F.round(F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)) / F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0)).otherwise(0.0)), 6).alias("ndcg"),
    )


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the query metrics, with the Wilson interval of p1."""
    rows = scored.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum("p1").alias("hits"), *[F.round(F.avg(c), 6).alias(c) for c in ("p1", "p3", "rr", "recall", "ndcg")])
    low, high = wilson(F.col("hits"), F.col("n"))
    return rows.withColumn("p1_low", F.round(low, 6)).withColumn("p1_high", F.round(high, 6))


def findability(scored: DataFrame, group: str) -> DataFrame:
    """Over groups of queries for the same target: how many targets are found by at least one, two, most, all."""
    each = scored.groupBy(group).agg(F.sum("p1").alias("hits"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("targets"), F.count_if(F.expr("hits >= 1")).alias("one"), F.count_if(F.expr("hits >= 2")).alias("two"), F.count_if(F.expr("2 * hits > n")).alias("most"), F.count_if(F.expr("hits = n")).alias("every"))


def ablation(full: DataFrame, variants: DataFrame, key: str = "metric") -> DataFrame:
    """Each variant's metrics with their difference from the full system's."""
    return variants.join(full.select(key, F.col("value").alias("base")), key).withColumn("delta", F.round(F.col("value") - F.col("base"), 6))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``column``'s values as columns, by ``row``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def abstention(shown: DataFrame, queries: DataFrame) -> DataFrame:
    """How many queries that have an answer were refused, and how many without one were."""
    rows = queries.join(shown.select("qid").distinct().withColumn("shown", F.lit(True)), "qid", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    return rows.agg(F.count_if(F.col("has_answer") & ~F.col("shown")).alias("false_refusals"), F.count_if(~F.col("has_answer") & ~F.col("shown")).alias("abstained"), F.count_if(F.expr("not has_answer")).alias("negatives"), F.count("*").alias("n"))


#: Rows of a block of the bootstrap, and resamples drawn at a time.
BLOCK, AT_ONCE = 4096, 64


def _shares(sizes: list[int], block: int, resamples: int, seed: int) -> np.ndarray:
    """How many of each resample's draws fall into a block: the draws are split in two halves of the blocks, again and again,
    down to this one. Every split is drawn by a generator of its own (seed, split), so all blocks see the same splits."""
    low, high = 0, len(sizes)
    total = sum(sizes)
    draws = np.full(resamples, total, np.int64)
    node = 1
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = sum(sizes[low:middle]), sum(sizes[low:high])
        taken = np.random.Generator(np.random.Philox(key=[seed, node])).binomial(draws, left / whole if whole else 0.0)
        if block < middle:
            draws, high, node = taken, middle, 2 * node
        else:
            draws, low, node = draws - taken, middle, 2 * node + 1
    return draws


def block_sums(values: np.ndarray, sizes: list[int], block: int, resamples: int, seed: int) -> np.ndarray:
    """The sum of a block's draws in each resample."""
    draws = _shares(sizes, block, resamples, seed)
    rng = np.random.Generator(np.random.Philox(key=[seed, (1 << 63) + block]))
    out = np.zeros(resamples)
    for a in range(0, resamples, AT_ONCE):
        counts = draws[a : a + AT_ONCE]
        drawn = values[rng.integers(0, len(values), int(counts.sum()))] if len(values) else np.zeros(0)
        ends = np.cumsum(counts)
        sums = np.concatenate([[0.0], np.cumsum(drawn)])
        out[a : a + AT_ONCE] = sums[ends] - sums[ends - counts]
    return out


def bootstrap(scored: DataFrame, column: str, key: str = "qid", resamples: int = 2000, seed: int = 13, block: int = BLOCK) -> DataFrame:
    """(low, high): the 95 % percentile interval of the mean, each resample n draws with replacement from all n rows.

    Rows lie in blocks by their key's hash. No row is copied: a block draws its part of every resample and returns one sum a
    resample. How the draws fall to blocks is a multinomial by splits, so a resample has n draws exactly. The same
    rows, seed and block size give the same interval, however the rows lie. Rows without a value don't count; no
    rows give (0, 0).
    """
    rows = scored.select(F.col(key).cast("string").alias("key"), F.col(column).cast("double").alias("v")).where("v is not null")
    n = rows.count()
    blocks = max(1, -(-n // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    held = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    sizes = [held.get(k, 0) for k in range(blocks)]

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("v", "ascending")])
        out = block_sums(table.column("v").to_numpy(), sizes, table.column("block")[0].as_py(), resamples, seed)
        return pa.table({"r": pa.array(np.arange(resamples), pa.int32()), "s": pa.array(out)})

    means = rows.groupBy("block").applyInArrow(sums, "r int, s double").groupBy("r").agg((F.sum("s") / n if n else F.lit(0.0)).alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    at = lambda k: F.round(F.coalesce(F.get(ordered, F.lit(k)), F.lit(0.0)), 6)
    return means.agg(at(int(0.025 * resamples)).alias("low"), at(min(resamples - 1, int(0.975 * resamples))).alias("high"))


def metric_table(ranked: DataFrame, grades: DataFrame, ks: tuple[int, ...] = (5, 10, 50), latency: str | None = None) -> DataFrame:
    """One row: n, and recall at each of several depths over the queries with a relevant document; with the column of ``ranked``
    that holds a query's latency, its nearest-rank median and 95th percentile over all queries."""
    hits = grades.where("grade > 0").join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    each = hits.groupBy("qid").agg(*[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks])
    out = each.agg(F.count("*").alias("n"), *[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks])
    if latency is None:
        return out
    times = ranked.groupBy("qid").agg(F.max(latency).alias("t")).where("t is not null")
    place = F.row_number().over(Window.orderBy("t", "qid"))
    ranks = times.withColumn("place", place).crossJoin(F.broadcast(times.agg(F.count("*").alias("m"))))
    at = lambda p: F.max(F.when(F.col("place") == F.greatest(F.floor(F.col("m") * p), F.lit(1)), F.col("t")))
    return out.crossJoin(F.broadcast(ranks.agg(at(0.5).alias("p50"), at(0.95).alias("p95"))))


def label_histograms(rows: DataFrame, by: str, labels: list[str]) -> DataFrame:
    """(group, field, label, n): how often each label field takes each value, for every group; nulls are a label of their own."""
    flat = rows.select(F.col(by).cast("string").alias("group"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("label")) for c in labels])).alias("x"))
    return flat.groupBy("group", "x.field", "x.label").agg(F.count("*").alias("n"))
