"""Search expressions of many queries as one table.

A query's texts (cleaned, rewritten, expansions) become rows (qid, ord, kind, parts, plain): single words, phrases
(words next to each other) and near groups (words close together in any order). The expression is the disjunction
of a query's rows; ``ord`` is the place of a row's first mention. All rules are column functions over the words of a
query; ``fields.FieldIndex`` evaluates the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN
from tessera.operators.lexical import top

# Words that are no search terms, those that are none in long descriptions, limits.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is
it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such
than that the their them then there these they this those through to too under until up very was we were what when where which
while who whom why will with would you your yours case cases judgment judgments find show tell give list any regarding related
whether did does please
""".split()
NARRATIVE_STOPWORDS = """
says said say saying claim claims claimed claiming argue argues argued arguing contend contends contended client clients side
sides opposite opposing someone somebody people person also later ever since got get gets getting went go goes going came come
comes coming told tell want wants wanted think thinks thought know knows knew like many much one ones thing things time times
day days back still even yet already never always just really able made make makes making put took take takes taken gave give
given lot whole etc
""".split()
NARRATIVE_WORDS = 25
MAX_TERMS = 64
DISTANCE = 2


def is_narrative(text: Column, flag: Column | None = None) -> Column:
    """The flag where it is set, else whether the text has NARRATIVE_WORDS words or more."""
    long = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) >= NARRATIVE_WORDS
    return long if flag is None else F.coalesce(flag, long)


def phrasings(*texts: Column) -> Column:
    """The distinct texts in order of first mention, trimmed, without nulls and blanks; a list column stands for its entries."""
    as_lists = F.flatten(F.array(*texts))
    return F.array_distinct(F.filter(F.transform(as_lists, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def _group(kind: str, parts: Column, plain: bool = False) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts"), F.lit(plain).alias("plain"))


def _number(part: Column) -> Column:
    return part.rlike(r"^\p{N}+$")


def _groups(word: Column, stop: Column) -> Column:
    """The rows of one blank-free word: none, one, or a group with its longer numbers."""
    parts = F.regexp_extract_all(word, F.lit(TOKEN), F.lit(0))
    none = F.filter(F.array(_group("term", parts)), lambda _: F.lit(False))
    first = F.get(parts, F.lit(0))
    single = F.when((F.length(first) > 1) & ~F.array_contains(stop, first), F.array(_group("term", parts, True))).otherwise(none)
    initials = F.forall(parts, lambda p: (F.length(p) == 1) & ~_number(p))
    group = F.when(F.exists(parts, _number), F.array(_group("near", parts))).otherwise(F.array(_group("phrase", parts)))
    numbers = F.transform(F.filter(parts, lambda p: _number(p) & (F.length(p) >= 2)), lambda p: _group("term", F.array(p)))
    return F.when(F.size(parts) == 0, none).when(F.size(parts) == 1, single).when(initials, none).otherwise(F.concat(group, numbers))


def expressions(queries: DataFrame, id_column: str, texts: Column, narrative: Column) -> DataFrame:
    """(qid, ord, kind, parts, plain) of every query; ``texts``: its texts as an array, in order.

    A word of one part is a term, unless it is a stop word or one character; a compound word with a number ("5-Q/2014") is
    a near group, one without (a hyphenated name) a phrase, and both give their numbers of two digits or more as
    terms of their own; compounds of single letters are none. Of equal rows of a query the first stays.
    """
    stop = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))])
    more = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS) | set(NARRATIVE_STOPWORDS))])
    words = F.regexp_extract_all(F.lower(F.array_join(texts, " ")), F.lit(r"\S+"), F.lit(0))
    rows = queries.select(F.col(id_column).alias("qid"), F.posexplode(words).alias("place", "word"), narrative.alias("narrative"))
    found = F.when(F.col("narrative"), _groups(F.col("word"), more)).otherwise(_groups(F.col("word"), stop))
    flat = rows.select("qid", "place", F.posexplode(found).alias("within", "x")).select("qid", F.struct("place", "within").alias("at"), "x.*")
    once = flat.groupBy("qid", "kind", "parts").agg(F.min_by("plain", "at").alias("plain"), F.min("at").alias("at"))
    return top(once, 1 << 30, ["qid"], [F.asc("at")]).select("qid", (F.col("rank") - 1).alias("ord"), "kind", "parts", "plain")


def budgeted(rows: DataFrame, df: DataFrame | None, budget: int = MAX_TERMS) -> DataFrame:
    """The expressions of at most ``budget`` rows: a query with more keeps its groups and numbers, and of its plain
    words those that occur, the rarest first, ties in query order. ``df``: (term, df); without it the first words stay.
    ``rows`` may have a column ``term``, under which a plain word is looked up (its stem), else its part is."""
    term = F.col("term") if "term" in rows.columns else F.get("parts", F.lit(0))
    sizes = rows.groupBy("qid").agg(F.count("*").alias("all"), F.count_if(~F.col("plain")).alias("fixed"))
    sized = rows.join(sizes, "qid")
    over = sized.where(F.col("all") > budget)
    plain = over.where("plain").withColumn("looked_up", term)
    known = plain.withColumn("df", F.lit(1)) if df is None else plain.join(df.select(F.col("term").alias("looked_up"), "df"), "looked_up").where("df > 0")
    chosen = top(known, 1 << 30, ["qid"], [F.asc("df"), F.asc("ord")]).where(F.col("rank") <= F.greatest(F.lit(budget) - F.col("fixed"), F.lit(0)))
    kept = over.where("not plain").select(*rows.columns).unionByName(chosen.select(*rows.columns))
    kept = top(kept, budget, ["qid"], [F.asc("ord")]).drop("rank")
    return sized.where(F.col("all") <= budget).select(*rows.columns).unionByName(kept)
