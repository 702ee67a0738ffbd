"""Keyword search over many queries at once.

A document's tokens are exploded and joined to the distinct query terms before anything is grouped, so
only postings that some query asks for are shuffled. Spark broadcasts the terms while they are small and
shuffles both sides beyond that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(id, term, positions, dl): one row a document and term, with the document's length in tokens."""
    words = docs.select(F.col(id_column).alias("id"), tokens(text).alias("words"))
    flat = words.select("id", F.size("words").alias("dl"), F.posexplode("words").alias("pos", "term"))
    return flat.groupBy("id", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(qid, term): the distinct words of each query."""
    return queries.select(F.col(id_column).alias("qid"), F.explode(F.array_distinct(tokens(text))).alias("term"))


def _weighed(column: str, weight: float) -> Column:
    return F.transform(tokens(F.col(column)), lambda w: F.struct(w.alias("term"), F.lit(float(weight)).alias("w")))


def matched(docs: DataFrame, id_column: str, columns: dict[str, float], terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted term counts of the asked terms, (id, term, tf, dl), and the corpus figures (n, avgdl).

    ``columns``: text columns and their weights; dl counts the tokens of all of them. Rows with the same id are one
    document whose length is that of all its rows. The words of a row are exploded once, whatever the columns.
    """
    words = docs.select(F.col(id_column).alias("id"), F.concat(*[_weighed(c, w) for c, w in columns.items()]).alias("words"), F.monotonically_increasing_id().alias("row"))
    flat = words.select("id", F.size("words").alias("dl"), "row", F.explode("words").alias("x")).select("id", "dl", "row", "x.*")
    asked = terms.select("term").distinct()
    by_row = flat.join(asked, "term").groupBy("id", "term", "row").agg(F.sum("w").alias("tf"), F.first("dl").alias("dl"))
    tf = by_row.groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl"))
    length = sum((F.regexp_count(F.coalesce(c, F.lit("")), F.lit(TOKEN)) for c in columns), F.lit(0))
    return tf, docs.agg(F.countDistinct(id_column).alias("n"), F.sum(length).alias("tokens")).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))


def top(df: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def bm25(docs: DataFrame, id_column: str, columns: dict[str, float], terms: DataFrame) -> DataFrame:
    """(qid, id, score): the BM25 score of every document for every query; an idf that isn't positive is 1e-6."""
    return scored(*matched(docs, id_column, columns, terms), terms)


def scored(tf: DataFrame, figures: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id, score) from term counts (id, term, tf, dl), the corpus figures (n, avgdl) and the queries' terms."""
    # reads all columns of tf, so that the exchange behind it is planned once and used for both
    df = tf.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") > 0) & F.col("id").isNotNull()).alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(figures)).select("term", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"), "avgdl")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "term").select("id", "term", gain.alias("gain")).join(terms, "term").groupBy("qid", "id").agg(F.sum("gain").alias("score"))


def bm25_topk(docs: DataFrame, id_column: str, columns: dict[str, float], terms: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query by (score at 6 digits, id)."""
    scored = bm25(docs, id_column, columns, terms).withColumn("score", F.round("score", 6))
    return top(scored, k, ["qid"], [F.desc("score"), F.asc("id")])


def term_df(docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(term, df): in how many documents each word stands."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def key_terms(docs: DataFrame, id_column: str, text: Column, terms: DataFrame, share: float) -> DataFrame:
    """(qid, term, df): the query terms that some documents hold, but at most ``share`` of all."""
    words = docs.select(F.explode(F.array_distinct(tokens(text))).alias("term"))
    df = words.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return terms.join(df, "term").crossJoin(F.broadcast(n)).where(F.col("df") <= share * F.col("n")).select("qid", "term", "df")


def salient(terms: DataFrame, df: DataFrame, budget: int) -> DataFrame:
    """(qid, term, df): each query's rarest terms that occur, ties in query order (``ord``)."""
    return top(terms.join(df, "term"), budget, ["qid"], [F.asc("df"), F.asc("ord")]).drop("rank")


def docs_with_terms(docs: DataFrame, id_column: str, text: Column, terms: DataFrame) -> DataFrame:
    """(qid, id, found): for each query the documents with any of its terms, and those terms, sorted."""
    words = docs.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(tokens(text))).alias("term"))
    return words.join(terms, "term").groupBy("qid", "id").agg(F.array_sort(F.collect_list("term")).alias("found"))


def _places(words: Column, word: str, moved: int = 0) -> Column:
    """Where a word stands in an array of words, each place moved by so many."""
    return F.filter(F.transform(words, lambda w, k: F.when(w == word, k + moved)), lambda k: k.isNotNull())


def _with_words(docs: DataFrame, id_column: str, text: Column, words: list[str]) -> DataFrame:
    """(id, words) of the documents that hold every one of the words; the text is searched before it is cut."""
    rows = docs.where(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w)))
    return rows.select(F.col(id_column).alias("id"), tokens(text).alias("words"))


def phrase_match(docs: DataFrame, id_column: str, text: Column, phrase: list[str]) -> DataFrame:
    """(id, hits): documents with the words next to each other in order, and how often; all within a document's row."""
    starts = [_places(F.col("words"), w, -k) for k, w in enumerate(phrase)]
    hits = F.size(reduce(F.array_intersect, starts)).cast("long")
    return _with_words(docs, id_column, text, phrase).select("id", hits.alias("hits")).where("hits > 0")


def near_match(docs: DataFrame, id_column: str, text: Column, first: str, second: str, between: int = 2) -> DataFrame:
    """(id, hits): documents where two different words stand in any order with at most ``between`` words between them;
    all within a document's row."""
    rows = _with_words(docs, id_column, text, [first, second]).select("id", _places(F.col("words"), first).alias("a"), _places(F.col("words"), second).alias("b"))
    hits = sum((F.size(F.array_intersect("a", F.transform("b", lambda k: k + d))) for n in range(1, between + 2) for d in (-n, n)), F.lit(0))
    return rows.select("id", hits.cast("long").alias("hits")).where("hits > 0")


def stemmed_topk(docs: DataFrame, id_column: str, text_column: str, terms: DataFrame, k: int) -> DataFrame:
    """BM25 on stems without diacritics: the terms of documents and queries (qid, term) are mapped through a table
    of the distinct terms' stems."""
    from tessera.functions.stem import stemmed

    words = docs.select(F.col(id_column).alias("id"), F.posexplode(tokens(F.col(text_column))).alias("pos", "term"))
    stems = stemmed(words.select("term").unionByName(terms.select("term")))
    asked = terms.join(stems, "term").select("qid", F.col("stem").alias("term")).distinct()
    flat = words.join(stems, "term").select("id", F.col("stem").alias("term"))
    length = words.groupBy("id").agg(F.count("*").alias("dl"))
    tf = flat.join(asked.select("term").distinct(), "term").groupBy("id", "term").agg(F.count("*").cast("double").alias("tf")).join(length, "id")
    figures = docs.agg(F.count("*").alias("n")).crossJoin(length.agg(F.sum("dl").alias("tokens"))).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(figures)).select("term", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"), "avgdl")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(idf, "term").select("id", "term", gain.alias("gain")).join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("gain"), 6).alias("score"))
    return top(scored, k, ["qid"], [F.desc("score"), F.asc("id")])
