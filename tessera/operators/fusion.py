"""Fusion of ranked lists and what follows from it: collapse, reciprocal ranks, votes, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
OUTCOME_SHARE = 0.25


def union_lists(**lists: DataFrame) -> DataFrame:
    """The candidates of all retrievers with their source; a retriever that gave nothing is an empty list."""
    out = None
    for source, df in lists.items():
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def collapse(candidates: DataFrame) -> DataFrame:
    """(qid, source, id, rank): each list with one entry a document, ranked among documents."""
    first = candidates.groupBy("qid", "source", "id").agg(F.min("rank").alias("at"))
    return first.select("qid", "source", "id", F.row_number().over(Window.partitionBy("qid", "source").orderBy("at", "id")).alias("rank"))


def weight_of(weights: dict[str, float]) -> Column:
    """A source's weight, 1 by default."""
    out = F.lit(1.0)
    for source, w in weights.items():
        out = F.when(F.col("source") == source, F.lit(float(w))).otherwise(out)
    return out


def fuse(collapsed: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, exact: str = "exact") -> DataFrame:
    """(qid, id, rrf, best, n_lists, n_first, pinned, position): reciprocal-rank fusion.

    Entries of the exact list are pinned: they add no reciprocal rank, yet count among lists and firsts.
    Order: pinned, then rrf, the best rank of the other lists, the id.
    """
    other = F.col("source") != exact
    rows = collapsed.groupBy("qid", "id").agg(
        F.round(F.sum(F.when(other, weight_of(weights or {}) / (k + F.col("rank"))).otherwise(0.0)), 9).alias("rrf"),
        F.min(F.when(other, F.col("rank"))).alias("best"),
        F.count("*").alias("n_lists"),
        F.count_if(F.col("rank") == 1).alias("n_first"),
        F.max(~other).alias("pinned"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("pinned"), F.desc("rrf"), F.asc_nulls_last("best"), F.asc("id"))
    return rows.withColumn("position", F.row_number().over(order))


def union_control(collapsed: DataFrame, lead: str) -> DataFrame:
    """(qid, id, position): the leading list in its order, then the rest by best rank and id."""
    rows = collapsed.groupBy("qid", "id").agg(F.min(F.when(F.col("source") == lead, F.col("rank"))).alias("lead"), F.min("rank").alias("best"))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("lead").isNotNull(), 0).otherwise(1), F.coalesce("lead", "best"), F.asc("id"))
    return rows.select("qid", "id", F.row_number().over(order).alias("position"))


def outcome_vote(fused: DataFrame, same: Column, k: int = RRF_K, share: float = OUTCOME_SHARE) -> DataFrame:
    """Adds share / (k + 1) where ``same`` holds, and sorts again; pinned rows stay where they are."""
    voted = fused.withColumn("rrf", F.round(F.col("rrf") + F.when(~F.col("pinned") & F.coalesce(same, F.lit(False)), share / (k + 1)).otherwise(0.0), 9))
    order = Window.partitionBy("qid").orderBy(F.desc("pinned"), F.when(F.col("pinned"), F.col("position")), F.desc("rrf"), F.asc("position"))
    return voted.withColumn("position", F.row_number().over(order))


def select_evidence(passages: DataFrame, most: int, preferred: Column) -> DataFrame:
    """(.., slot): for each query and document up to ``most`` passages: one of each node first, by score, then
    repeats; where none of a full hand is preferred, its last gives way to the best preferred one left. Passages may bring
    ``repeat``, whether their node has a better one."""
    node = Window.partitionBy("qid", "doc", "node").orderBy(F.desc("score"), F.asc("id"))
    doc = Window.partitionBy("qid", "doc")
    rows = passages if "repeat" in passages.columns else passages.withColumn("repeat", F.row_number().over(node) > 1)
    rows = rows.withColumn("liked", preferred)
    rows = rows.withColumn("at", F.row_number().over(doc.orderBy("repeat", F.desc("score"), F.asc("id"))))
    rows = rows.withColumn("has", F.max(F.when(F.col("at") <= most, F.col("liked"))).over(doc))
    rows = rows.withColumn("best_liked", F.min(F.when(F.col("liked") & (F.col("at") > most), F.col("at"))).over(doc))
    swap = ~F.col("has") & F.col("best_liked").isNotNull()
    kept = rows.where((F.col("at") < most) | ((F.col("at") == most) & ~swap) | (swap & (F.col("at") == F.col("best_liked"))))
    return kept.withColumn("slot", F.row_number().over(doc.orderBy("at"))).drop("has", "best_liked", "at", "repeat", "liked")


def chunk_order(entries: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, id, chunk_rrf): reciprocal ranks summed over the lists that hold a chunk."""
    return entries.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("chunk_rrf"))
