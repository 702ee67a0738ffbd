"""A stored keyword index: posting rows written once per batch of documents, searched without reading the texts again.

An index is a folder of batches and a log of those that count. A batch holds the posting rows (term, id, positions, dl)
of its documents, in folders by the term's bucket and sorted by term, and a row (id, dl) for each document; a removal is
a row whose dl is null. A batch counts from the moment the log names it, so readers see all of it or nothing, and what a
failed write left behind is never read. Of several batches with the same id the latest holds; ``compact`` writes the
living rows as one batch. One writer at a time.

A search reads the buckets of the asked terms alone. Posting rows meet only the ids that later batches touched, not the
table of all documents; a compacted index needs no such join. Words are grouped within the rows of an Arrow batch, so building
shuffles them but to sort them into buckets. Frequent words fill large buckets, which the rebalancing
before the write splits over tasks and files.

Null ids are left out, null and empty texts are documents without words, an id twice in a batch is an error.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN, tokens
from tessera.operators import lexical
from tessera.operators.fields import FIELDS as LISTS
from tessera.operators.fields import inverted, small_batches
from tessera.sources.store import Versioned

#: Folders of a batch; at most so many values come to the driver when a search names its buckets.
BUCKETS = 64
FIELDS = {"documents": "dl int", "postings": "term string, positions array<int>, dl int, bucket int"}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _moved(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p + by)


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Versioned(spark, f"{self.path}/log")

    def _batches(self) -> list[tuple[int, str]]:
        return [] if self.log.current() is None else sorted((r["seq"], r["batch"]) for r in self.log.read().collect())

    def _commit(self, batches: list[tuple[int, str]]) -> None:
        self.log.rebuild(self.spark.createDataFrame(batches, "seq long, batch string").coalesce(1))

    def _read(self, kind: str) -> DataFrame:
        batches = self._batches()
        if not batches:
            raise FileNotFoundError(self.path)
        # a batch of removals has no posting files, so its schema is stated
        of_id = self.spark.read.parquet(f"{self.path}/documents/{batches[0][1]}").schema["id"].dataType.simpleString()
        schema = f"id {of_id}, " + FIELDS[kind]
        rows = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{batch}").withColumn("seq", F.lit(seq)) for seq, batch in batches]
        return reduce(DataFrame.unionByName, rows)

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows that no later batch has replaced or removed."""
        batches = self._batches()
        if len(batches) == 1:
            return rows
        later = self._read("documents").where(F.col("seq") > batches[0][0]).groupBy("id").agg(F.max("seq").alias("last"))
        return rows.join(later, "id", "left").where("last is null or last = seq").drop("last")

    def _write(self, postings: DataFrame, documents: DataFrame) -> str:
        batch = uuid.uuid4().hex
        documents.select("id", "dl").write.parquet(f"{self.path}/documents/{batch}")
        rows = postings.select("id", "term", "positions", "dl", bucket(F.col("term")).alias("bucket"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/postings/{batch}")
        return batch

    def upsert(self, docs: DataFrame, id_column: str, text_column: str) -> None:
        """Adds documents; those whose id is in the index already are replaced."""
        docs = docs.where(F.col(id_column).isNotNull())
        if not docs.groupBy(id_column).count().where("count > 1").isEmpty():
            raise ValueError("an id stands twice in a batch")
        length = F.regexp_count(F.coalesce(text_column, F.lit("")), F.lit(TOKEN))
        words = docs.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("words"))
        lists = words.mapInArrow(inverted(1, False), f"id {words.schema['id'].dataType.simpleString()}, {LISTS['documents']}")
        rows = lists.select("id", F.explode("postings").alias("p"), F.col("dl").cast("int").alias("dl"))
        rows = rows.select("id", F.col("p.stem").alias("term"), F.col("p.positions").cast("array<int>").alias("positions"), "dl")
        with small_batches(self.spark):
            batch = self._write(rows, docs.select(F.col(id_column).alias("id"), length.alias("dl")))
        self._add(batch)

    def remove(self, ids: DataFrame, id_column: str) -> None:
        """Documents that are in the index go; other ids change nothing."""
        gone = ids.select(F.col(id_column).alias("id")).where("id is not null").distinct().withColumn("dl", F.lit(None).cast("int"))
        none = gone.select("id", F.lit("").alias("term"), F.array(F.lit(0)).alias("positions"), "dl").where("false")
        self._add(self._write(none, gone))

    def _add(self, batch: str) -> None:
        batches = self._batches()
        self._commit([*batches, (batches[-1][0] + 1 if batches else 1, batch)])

    def compact(self) -> None:
        """Writes the living rows as one batch."""
        batch = self._write(self._living(self._read("postings")), self.documents())
        self._commit([(self._batches()[-1][0] + 1, batch)])

    def documents(self) -> DataFrame:
        """(id, dl): the documents of the index and their lengths in words."""
        return self._living(self._read("documents")).where("dl is not null").select("id", "dl")

    def rows(self, terms: DataFrame) -> DataFrame:
        """(id, term, positions, dl): the postings of the distinct ``term`` values."""
        asked = terms.select("term").distinct()
        buckets = [r["bucket"] for r in asked.select(bucket(F.col("term")).alias("bucket")).distinct().collect()]
        found = self._read("postings").where(F.col("bucket").isin(buckets)).join(asked, "term")
        return self._living(found).select("id", "term", "positions", "dl")

    def counts(self) -> DataFrame:
        """One row: posting rows, and documents with or without words."""
        return self._living(self._read("postings")).agg(F.count("*").alias("postings")).crossJoin(self.documents().agg(F.count("*").alias("documents")))

    def bm25_topk(self, terms: DataFrame, k: int) -> DataFrame:
        """The k best documents of each query by (score at 6 digits, id); ``terms``: (qid, term)."""
        tf = self.rows(terms).select("id", "term", F.size("positions").cast("double").alias("tf"), "dl")
        figures = self.documents().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        scored = lexical.scored(tf, figures, terms).withColumn("score", F.round("score", 6))
        return lexical.top(scored, k, ["qid"], [F.desc("score"), F.asc("id")])

    def key_terms(self, terms: DataFrame, share: float) -> DataFrame:
        """(qid, term, df): the query terms that some documents hold, but at most ``share`` of all."""
        df = self.rows(terms).groupBy("term").agg(F.count("*").alias("df"))
        n = self.documents().agg(F.count("*").alias("n"))
        return terms.join(df, "term").crossJoin(F.broadcast(n)).where(F.col("df") <= share * F.col("n")).select("qid", "term", "df")

    def _places(self, words: list[str]) -> DataFrame:
        """(id, p0, p1, ...): where each word stands in the documents that hold them all."""
        rows = self.rows(self.spark.createDataFrame([(w,) for w in set(words)], "term string"))
        places = [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p{k}") for k, w in enumerate(words)]
        return rows.groupBy("id").agg(*places).dropna()

    def phrase(self, words: list[str]) -> DataFrame:
        """(id, hits): documents with the words next to each other in order, and how often."""
        starts = [_moved(f"p{k}", -k) for k in range(len(words))]
        return self._places(words).select("id", F.size(reduce(F.array_intersect, starts)).cast("long").alias("hits")).where("hits > 0")

    def near(self, first: str, second: str, between: int = 2) -> DataFrame:
        """(id, hits): documents where two different words stand in any order with at most ``between`` words between them."""
        apart = [d for k in range(1, between + 2) for d in (-k, k)]
        hits = sum((F.size(F.array_intersect("p0", _moved("p1", d))) for d in apart), F.lit(0))
        return self._places([first, second]).select("id", hits.cast("long").alias("hits")).where("hits > 0")
