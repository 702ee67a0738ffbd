"""Sentences and chunks of texts, as columns: regular expressions cut, running sums of the sentences' token counts pack."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP, LEAST_BODY = 480, 2, 64
#: Words that a full stop follows without ending a sentence; single letters and numbers of up to two digits are the same.
ABBREVIATIONS = "mr mrs ms dr no nos vs art sec st jr sr etc pp".split()
#: A stop that ends nothing, and one that ends a sentence with the quotes and brackets behind it.
KEPT_STOP = r"(?i)(^|[^\p{L}\p{N}])(" + "|".join(ABBREVIATIONS) + r"|\p{L}|\p{N}{1,2})\."
LAST_STOP = r"([.!?]+[\"')\]]*)[ \t\r]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def sentences(c: Column) -> Column:
    """The sentences of a text, line by line, without blanks at their ends."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), KEPT_STOP, "$1$2\u0001")
    pieces = F.split(F.regexp_replace(marked, LAST_STOP, "$1\n"), "\n+")
    return F.filter(F.transform(pieces, lambda p: F.trim(F.translate(p, "\u0001", "."), F.lit(" \t\r"))), lambda p: p != "")


def words_and_signs(texts: Column) -> Column:
    """How many words and signs each text of an array has. A counter of real tokens, an array to an array, may stand in its place."""
    return F.transform(texts, lambda t: F.regexp_count(t, F.lit(TOKEN)))


def hard_split(c: Column, budget: int) -> Column:
    """A sentence cut after every ``budget`` words and signs."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?:(?:{TOKEN})\s*){{1,{budget}}}"), F.lit(0)), lambda p: F.rtrim(p))


def spans(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of sentences as (first, end): sentences are taken while they fit; a chunk begins with up to ``overlap`` sentences of
    the one before, as many as leave room for a new one, but not with its first."""
    out, first, used = [], 0, 0
    for at, size in enumerate(sizes):
        if at == first or used + size <= budget:
            used += size
            continue
        out.append((first, at))
        begin, used, total = at, size, size
        for k in range(1, overlap + 1):
            total += sizes[at - k] if at >= k else 0
            if total <= budget and at - k > first:
                begin, used = at - k, total
        first = begin
    if len(sizes) > first:
        out.append((first, len(sizes)))
    return out


CHUNKS = "array<struct<n_tokens:bigint,text:string>>"


def packed(own: Column, sizes: Column, budget: Column, overlap: int) -> Column:
    """The chunks of a text's sentences, with their tokens and text: running sums, one pass over the sentences of a row."""

    @F.arrow_udf(CHUNKS)
    def run(own: pa.Array, sizes: pa.Array, budgets: pa.Array) -> pa.Array:
        rows = []
        for parts, counts, budget in zip(own.to_pylist(), sizes.to_pylist(), budgets.to_pylist()):
            sums = list(accumulate(counts, initial=0))
            rows.append([{"n_tokens": sums[b] - sums[a], "text": " ".join(parts[a:b])} for a, b in spans(counts, budget, overlap)])
        return pa.array(rows, pa.list_(pa.struct([("n_tokens", pa.int64()), ("text", pa.string())])))

    return run(own, sizes, budget)


def chunk_rows(docs: DataFrame, id_column: str, text_column: str, most: int = MAX_TOKENS, overlap: int = OVERLAP, title_column: str | None = None, sizes_of: Callable[[Column], Column] = words_and_signs) -> DataFrame:
    """(id, chunk, n_tokens, text) for every chunk of every text; blank texts give none. With a title each chunk begins
    with it, and the body keeps at least LEAST_BODY tokens. A sentence over the budget is cut, beside a title into pieces
    of LEAST_BODY. All happens within a document's row: nothing is shuffled."""
    title = F.trim(F.coalesce(F.col(title_column), F.lit(""))) if title_column else F.lit("")
    rows = docs.select(F.col(id_column).alias("id"), title.alias("title"), sentences(F.col(text_column)).alias("own")).where(F.size("own") > 0)
    rows = rows.withColumn("head", F.when(F.col("title") != "", sizes_of(F.array("title"))[0]).otherwise(0))
    rows = rows.withColumn("budget", F.greatest(F.lit(LEAST_BODY if title_column else 1), F.lit(most) - F.col("head")))
    rows = rows.withColumn("sizes", sizes_of(F.col("own")))
    pieces = F.zip_with("own", "sizes", lambda s, n: F.when(n > F.col("budget"), hard_split(s, LEAST_BODY if title_column else most)).otherwise(F.array(s)))
    rows = rows.withColumn("own", F.flatten(pieces)).withColumn("sizes", sizes_of(F.col("own")).cast("array<bigint>"))
    rows = rows.select("id", "title", "head", packed(F.col("own"), F.col("sizes"), F.col("budget"), overlap).alias("chunks"))
    rows = rows.select("id", "title", "head", F.posexplode("chunks").alias("chunk", "c"))
    text = F.concat(F.when(F.col("title") != "", F.concat("title", F.lit("\n"))).otherwise(""), F.col("c.text"))
    return rows.select("id", "chunk", (F.col("head") + F.col("c.n_tokens")).alias("n_tokens"), text.alias("text"))


def sentence_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, position, sentence)."""
    return docs.select(F.col(id_column).alias("id"), F.posexplode(sentences(F.col(text_column))).alias("position", "sentence"))
