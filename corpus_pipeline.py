"""From raw documents to packed training sequences: each stage works on all that the one before it kept,
and what a stage returns is written to the shared store and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, packing, quality, secrets
from tessera.llm.arrow import shared_dir, small

#: Near copies here share 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays. Documents without shingles or
    without id stay."""
    joined = ngram_join.jaccard_join(docs, k=SHINGLE, percent=PERCENT)
    copies = joined.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    copies = F.broadcast(copies) if small(copies, ngram_join.BROADCAST_IDS) else copies
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; ``n_chars`` follows."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row a piece of a document, with its token ids."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Scores, tokens and automata are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
