"""Documents as trees of sections, and contexts assembled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_id(doc: Column, section: Column) -> Column:
    """A node's id from its document and section: the same on every run."""
    return F.sha1(F.concat_ws("|", doc.cast("string"), section))


def build(sections: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of documents' sections (doc, section, text): one parent with its children's ids in the
    order of ``labels``; a label without text is a child with an empty text."""
    order = F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("position", "section")
    wanted = sections.select("doc").distinct().select("doc", order)
    children = wanted.join(sections, ["doc", "section"], "left").withColumn("node_id", node_id(F.col("doc"), F.col("section")))
    children = children.withColumn("parent_id", node_id(F.col("doc"), F.lit("ROOT"))).withColumn("text", F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "node_id"))), lambda s: s["node_id"])
    parents = children.groupBy("doc").agg(ordered.alias("children")).withColumn("node_id", node_id(F.col("doc"), F.lit("ROOT")))
    return parents, children


def siblings(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(parent, node, position): the children of each parent in its declared order."""
    slots = parents.select(F.col("node_id").alias("parent_id"), F.posexplode("children").alias("position", "node_id"))
    return slots.join(nodes.drop("parent_id", "position"), "node_id")


def expand(retrieved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, doc, node_id, section, text, retrieved): the retrieved nodes and the other sections of their documents."""
    docs = retrieved.select("qid", "doc").distinct()
    all_ = docs.join(nodes.select("doc", "node_id", "section", "text"), "doc")
    return all_.join(retrieved.select("qid", "node_id", F.lit(True).alias("retrieved")), ["qid", "node_id"], "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(False)))


def assemble(expanded: DataFrame, order: list[str], budget: int) -> DataFrame:
    """(qid, doc, context, n_tokens): sections with headings in a fixed order, as many as fit the budget of
    tokens, retrieved ones first."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("section"))
    rows = expanded.where((F.length("text") > 0) & (place > 0)).withColumn("place", place).withColumn("cost", F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))))
    turn = Window.partitionBy("qid", "doc").orderBy(F.desc("retrieved"), "place", "node_id")
    rows = rows.withColumn("used", F.sum("cost").over(turn.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)
    parts = F.array_sort(F.collect_list(F.struct("place", "section", "text")))
    text = F.array_join(F.transform(parts, lambda s: F.concat(F.lit("## "), s["section"], F.lit("\n"), s["text"])), "\n\n")
    return rows.groupBy("qid", "doc").agg(text.alias("context"), F.sum("cost").alias("n_tokens"))


def char_windows(docs: DataFrame, id_column: str, text_column: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk, text): windows of ``size`` characters that overlap; null and empty texts give none."""
    starts = F.sequence(F.lit(0), F.length(text_column) - 1, F.lit(size - overlap))
    rows = docs.where(F.length(text_column) > 0).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.posexplode(starts).alias("chunk", "start"))
    return rows.select("id", "chunk", F.expr(f"substring(text, start + 1, {size})").alias("text"))
