"""Exact keys, names and result filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import compact, filter_words, tokens

COVERAGE, LEAST_TOKENS, QUERY_COVERAGE = 0.6, 2, 0.6


def key_lookup(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, id, key): documents (id, keys) that hold a query's key (qid, key)."""
    return docs.select("id", F.explode("keys").alias("key")).join(keys, "key").select("qid", "id", "key").distinct()


def name_tokens(names: DataFrame, stop: list[str]) -> DataFrame:
    """(id, term): the informative words of each name: longer than a letter, without digits, not in ``stop``."""
    words = F.filter(F.array_distinct(tokens(F.col("name"))), lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]") & ~w.isin(*stop))
    return names.select("id", F.explode(words).alias("term"))


def party_match(names: DataFrame, queries: DataFrame, coverage: float = COVERAGE, least: int = LEAST_TOKENS, query_coverage: float = QUERY_COVERAGE) -> DataFrame:
    """(qid, id, score): names (id, term) whose words, weighed by rarity, stand in a query (qid, term), and cover it.

    A word's weight is ln(1 + names / names with it), 1 where no name has it.
    score = 0.5 + 0.4 * name coverage * query coverage.
    """
    n = names.agg(F.countDistinct("id").alias("n"))
    idf = names.groupBy("term").agg(F.countDistinct("id").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    # a name and a query are a row each with their words, so a candidate is scored in its row
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + w["idf"])
    known = names.distinct().join(idf, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idf", "term"))).alias("words")).withColumn("whole", total(F.col("words")))
    asked = queries.distinct().join(idf, "term", "left").groupBy("qid").agg(F.collect_list("term").alias("said"), F.sum(F.coalesce("idf", F.lit(1.0))).alias("asked"))
    # a name is met through its heavier words only, without which the coverage isn't reached: a word of all names
    # brings no candidates
    heavy = F.filter("words", lambda w, k: total(F.slice("words", 1, k + 1)) >= coverage * F.col("whole") * (1 - 1e-9))
    met = known.withColumn("met", F.explode(heavy)).withColumn("term", F.col("met.term")).join(asked.withColumn("term", F.explode("said")), "term")
    met = met.withColumn("hits", F.filter("words", lambda w: F.array_contains("said", w["term"]))).withColumn("hit", total(F.col("hits")))
    rows = met.withColumn("name_share", F.col("hit") / F.col("whole")).withColumn("query_share", F.col("hit") / F.col("asked"))
    rows = rows.where((F.size("hits") >= least) & (F.col("name_share") >= coverage) & (F.col("query_share") >= query_coverage))
    return rows.select("qid", "id", F.round(0.5 + 0.4 * F.col("name_share") * F.col("query_share"), 6).alias("score")).dropDuplicates(["qid", "id"])


def result_filter(outcome: str = "", judge: str = "", words: str = "", after=None, before=None, *, outcome_column: Column, bench: Column, date: Column, haystack: Column) -> Column:
    """Whether a row passes all filters that are set. Judge words must all stand in one judge's name; a date
    limit leaves out rows without a date; each word must stand in the compacted haystack."""
    passes = F.lit(True)
    if outcome:
        passes &= outcome_column.eqNullSafe(outcome)
    if judge:
        own = filter_words(F.lit(judge), ("justice", "mr", "mrs", "ms"))
        passes &= F.exists(bench, lambda b: F.forall(own, lambda w: F.contains(compact(b), w)))
    if after is not None:
        passes &= F.coalesce(date >= F.lit(after), F.lit(False))
    if before is not None:
        passes &= F.coalesce(date <= F.lit(before), F.lit(False))
    if words:
        passes &= F.forall(filter_words(F.lit(words)), lambda w: F.contains(compact(haystack), w))
    return passes


def not_value(c: Column, value: str) -> Column:
    """Not equal, where a missing value counts as not equal."""
    return ~c.eqNullSafe(value)


def keep_known(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Fetch by key: the rows of the distinct ids; ids without a row give none."""
    return docs.join(ids.select(key).distinct(), key, "left_semi")
