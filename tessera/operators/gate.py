"""What of a ranked list is shown: gates, labels, reranking, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR, CONFIDENT, AGREEMENT, LEAD = 0.002, 0.25, 3, 0.38
PAGE = 10


def agreement_gate(rows: DataFrame, floor: float = FLOOR, confident: float = CONFIDENT, agreement: int = AGREEMENT, lead: float = LEAD) -> DataFrame:
    """Keeps a query's rows if its top row passes: pinned, confident, or first in enough lists and either above
    the floor or well ahead. Beyond the top, pinned and confident rows stay; if the top fails, pinned ones alone."""
    agreed = (F.col("n_first") >= agreement) & ((F.col("relevance") >= floor) | (F.col("lead") >= lead))
    passes = F.coalesce(F.col("pinned") | (F.col("relevance") >= confident) | agreed, F.lit(False))
    top = F.first_value(passes).over(Window.partitionBy("qid").orderBy("position"))
    rows = rows.withColumn("passes", passes).withColumn("top_passes", top)
    keep = F.col("pinned") | (F.col("top_passes") & ((F.col("position") == 1) | (F.col("relevance") >= confident)))
    return rows.where(keep).drop("passes", "top_passes")


def lexical_lead(lists: DataFrame) -> DataFrame:
    """(qid, id, lead): over the lexical lists that hold it, the least share by which a document's score beats the
    best other one; null where it leads nowhere."""
    own = Window.partitionBy("qid", "source").orderBy(F.desc("score"), F.asc("id"))
    ranked = lists.withColumn("at", F.row_number().over(own))
    best = ranked.where("at <= 2").groupBy("qid", "source").agg(F.max(F.when(F.col("at") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("at") == 2, F.col("score"))).alias("second"))
    other = F.when(F.col("at") == 1, F.col("second")).otherwise(F.col("first"))
    ahead = ranked.join(best, ["qid", "source"]).withColumn("ahead", (F.col("score") - other) / F.col("score"))
    out = ahead.groupBy("qid", "id").agg(F.min("ahead").alias("lead"), F.count("ahead").alias("n"))
    return out.select("qid", "id", F.when((F.col("lead") > 0) & (F.col("n") > 0), F.round("lead", 6)).alias("lead"))


def confidence(relevance: Column, position: Column, high: float = 0.5, medium: float = CONFIDENT) -> Column:
    """high, medium or related, by position and relevance."""
    return F.when((position == 1) & (relevance >= high), "high").when(relevance >= medium, "medium").otherwise("related")


def capped(label: Column, cap: str) -> Column:
    """The lower of a label and a cap."""
    names = F.array(F.lit("related"), F.lit("medium"), F.lit("high"))
    return F.element_at(names, F.least(F.array_position(names, label), F.array_position(names, F.lit(cap))).cast("int"))


def rerank(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` positions sorted by logit, the rest behind them in their order."""
    order = Window.partitionBy("qid").orderBy(F.when(F.col("position") <= most, 0).otherwise(1), F.when(F.col("position") <= most, -F.col("logit")), F.col("position"))
    return rows.withColumn("position", F.row_number().over(order))


def page(rows: DataFrame, shown: DataFrame, size: int = PAGE) -> DataFrame:
    """The next ``size`` rows of each query that weren't shown."""
    left = rows.join(shown, ["qid", "id"], "left_anti")
    return left.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy("position"))).where(F.col("slot") <= size)


def filtered_page(rows: DataFrame, allowed: DataFrame, size: int = PAGE) -> DataFrame:
    """The first ``size`` rows of each query among the allowed documents."""
    left = rows.join(allowed, "id", "left_semi")
    return left.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy("position"))).where(F.col("slot") <= size)


def tail_pass(rows: DataFrame, passes: Column, last: int = 5) -> DataFrame:
    """Whether any of the ``last`` rows up to each position passes."""
    frame = Window.partitionBy("qid").orderBy("position").rowsBetween(-(last - 1), 0)
    return rows.withColumn("tail_pass", F.max(passes).over(frame))


def with_key_terms(rows: DataFrame, found: DataFrame, n_terms: DataFrame, all_up_to: int = 2, share: float = 0.5) -> DataFrame:
    """Rows that hold enough of their query's key terms: all of few, else half; pinned rows always."""
    need = F.when(F.col("n_terms") <= all_up_to, F.col("n_terms")).otherwise(F.ceil(share * F.col("n_terms")))
    joined = rows.join(found, ["qid", "id"], "left").join(n_terms, "qid", "left")
    return joined.where(F.col("pinned") | (F.coalesce(F.size("found"), F.lit(0)) >= F.coalesce(need, F.lit(0))))
