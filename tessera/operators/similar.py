"""Words that nearly equal target words, by matching blocks or by edits, without comparing every pair.

Both measures need a number of common characters: a ratio of matching blocks of c needs c (|a| + |b|) / 2 of them, a share
of edits of at most 1 - c needs c max(|a|, |b|). A word is taken as the set of its characters numbered by occurrence, so
that common characters are a set's intersection, and two words can only reach the number if the prefixes of their sets
share an element, when both are ordered by one global order: the rarest first. Words meet by the elements of their
prefixes; what meets is counted, and only what has the number is measured. No pair is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the table of characters that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Room for rounding: a number is needed in full only if it is surely more.
TOLERANCE = 1e-9


def needed(a: Column, b: Column, cutoff: float, edits: bool) -> Column:
    """How many common characters words of these lengths need."""
    return F.ceil((cutoff * F.greatest(a, b) if edits else cutoff * (a + b) / 2) - TOLERANCE)


def _least(a: Column, cutoff: float, edits: bool) -> Column:
    """The fewest that a word of this length needs with any partner: a partner has the number of characters itself."""
    return F.ceil((cutoff * a if edits else cutoff * (a + F.ceil(a * cutoff / (2 - cutoff) - TOLERANCE)) / 2) - TOLERANCE)


def _elements(word: Column) -> Column:
    """The characters, numbered by occurrence: "aba" has a1, b1, a2."""
    chars = F.array_sort(F.filter(F.split(word, ""), lambda c: c != ""))
    distinct = F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), (F.length(word) - F.length(F.replace(word, c, F.lit("")))).alias("n")))
    return F.flatten(F.transform(distinct, lambda d: F.transform(F.sequence(F.lit(1), d["n"]), lambda k: F.concat(d["c"], k.cast("string")))))


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _prefixes(sets: DataFrame, rare: DataFrame, cutoff: float, edits: bool) -> DataFrame:
    """(word, n, set, element): the elements of each word's prefix."""
    flat = sets.select("word", F.explode("set").alias("element")).join(rare, "element")
    ordered = flat.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("o"))
    joined = ordered.join(sets, "word")
    length = F.greatest(F.col("n") - _least(F.col("n"), cutoff, edits) + 1, F.lit(1)).cast("int")
    return joined.select("word", "n", "set", F.explode(F.slice("o.element", 1, length)).alias("element"))


def candidates(words: DataFrame, targets: DataFrame, cutoff: float, edits: bool = False) -> DataFrame:
    """(word, target): the pairs of the distinct ``word`` and ``target`` values with enough common characters."""
    left = words.select("word").where("word <> ''").distinct()
    right = targets.select(F.col("target").alias("word")).where("word <> ''").distinct()
    sides = [s.select("word", F.length("word").alias("n"), _elements(F.col("word")).alias("set")) for s in (left, right)]
    rare = _near(sides[0].unionByName(sides[1]).select(F.explode("set").alias("element")).groupBy("element").agg(F.count("*").alias("often")))
    a = _prefixes(sides[0], rare, cutoff, edits)
    b = _prefixes(sides[1], rare, cutoff, edits).select(F.col("word").alias("target"), F.col("n").alias("m"), F.col("set").alias("other"), "element")
    met = a.join(b, "element").where(F.least("n", "m") >= needed(F.col("n"), F.col("m"), cutoff, edits))
    enough = F.size(F.array_intersect("set", "other")) >= needed(F.col("n"), F.col("m"), cutoff, edits)
    return met.where(enough).select("word", "target").distinct()


def block_ratio(a: str, b: str) -> Column:
    """Twice the characters in matching blocks (the longest first, then left and right of it) over all characters."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run(a, b)


def similar_words(words: DataFrame, targets: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(word, target, ratio): the distinct words that read as a target, by the ratio of matching blocks."""
    return candidates(words, targets, cutoff).withColumn("ratio", block_ratio("word", "target")).where(F.col("ratio") >= cutoff)


def close_words(words: DataFrame, targets: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(word, target, distance): the distinct words that are few edits from a target: at most 1 - cutoff of the longer word."""
    pairs = candidates(words, targets, cutoff, edits=True).withColumn("distance", F.levenshtein("word", "target"))
    return pairs.where(1 - F.col("distance") / F.greatest(F.length("word"), F.length("target")) >= cutoff)
