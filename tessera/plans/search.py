"""The flagship plan: many query strings over an archive, from words to pages of gated results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import fusion, gate, lexical


def search(docs: DataFrame, queries: DataFrame, k: int = 5, pool: int = 50) -> DataFrame:
    """(qid, position, id, lang, source, rrf, label): for each query (qid, text) the first k documents.

    Two retrievers (BM25 on texts, BM25 on the beginnings) give their pools; reciprocal ranks fuse them, labels
    say how sure a place is. Each step is one set-based plan over all queries.
    """
    cleaned = queries.select("qid", text.clean_query(F.col("text")).alias("text"))
    terms = lexical.query_terms(cleaned, "qid", F.col("text"))
    whole = lexical.bm25_topk(docs, "doc_id", {"text": 1.0}, terms, pool)
    leads = lexical.bm25_topk(docs.withColumn("lead", F.expr("substring(text, 1, 500)")), "doc_id", {"lead": 1.0}, terms, pool)
    fused = fusion.fuse(fusion.collapse(fusion.union_lists(bm25_text=whole, bm25_lead=leads))).where(F.col("position") <= k)
    label = gate.confidence(F.col("rrf") * 20, F.col("position"))
    fields = docs.select(F.col("doc_id").alias("id"), "lang", "source")
    return fused.join(fields, "id").select("qid", F.col("position").cast("long").alias("position"), "id", "lang", "source", "rrf", label.alias("label"))
