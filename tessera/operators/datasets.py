"""Evaluation datasets: rows checked, ids made, older formats and hand-written rows taken over, copies dropped and counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the fields of a row may hold.
QUERY_TYPES = ("issue", "entity", "paraphrase", "statute", "citation", "disposition", "vague", "unknown")
ORIGINS = ("legacy", "synthetic", "negative", "narrative_negative", "narrative", "hand")
STATUSES = ("draft", "confirmed", "rejected")
SPLITS = ("dev", "test")
NEGATIVE = ("negative", "narrative_negative")
ROW = "id string, query string, relevant map<string,int>, query_type string, origin string, split string, status string, notes string"
FIELDS = ("id", "query", "relevant", "query_type", "origin", "split", "status")


def normalised(query: Column) -> Column:
    """For comparing queries: lower case, single blanks, no stops, question or exclamation marks at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(query, F.lit("")))), r"\s+", " "), "[ ?.!]+$", "")


def stable_id(prefix: str, query: Column) -> Column:
    """prefix-<ten digits of the normalised query's SHA-1>."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(normalised(query).cast("binary")), 1, 10))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def row_issues(rows: DataFrame) -> Column:
    """Why a row can't be used: missing fields, an empty query, values that are none of the known ones, grades other than 1 and 2,
    no grade 2 among relevant ones, relevant ones of a negative. Empty for a good row."""
    missing = [F.when(F.col(c).isNull() if c in rows.columns else F.lit(True), f"missing {c}") for c in FIELDS]
    grades = F.coalesce(F.map_values("relevant"), F.array().cast("array<int>")) if "relevant" in rows.columns else F.array().cast("array<int>")
    known = {"query_type": QUERY_TYPES, "origin": ORIGINS, "status": STATUSES, "split": SPLITS}
    checks = [F.when(~F.col(c).isin(*values), f"bad {c}") for c, values in known.items() if c in rows.columns]
    if "query" in rows.columns:
        checks.append(F.when(F.trim(F.col("query")) == "", "empty query"))
    checks.append(F.when(F.exists(grades, lambda g: ~F.coalesce(g.isin(1, 2), F.lit(False))), "bad grade"))
    checks.append(F.when((F.size(grades) > 0) & ~F.coalesce(F.array_contains(grades, 2), F.lit(False)), "no grade 2"))
    if "origin" in rows.columns:
        checks.append(F.when(F.col("origin").isin(*NEGATIVE) & (F.size(grades) > 0), "relevant negative"))
    return F.array_compact(F.array(*missing, *checks))


def validated(rows: DataFrame, shown: int = 5) -> DataFrame:
    """The rows, if all are good; else an error with the first bad ones."""
    bad = rows.select("id", row_issues(rows).alias("issues")).where(F.size("issues") > 0).orderBy("id").limit(shown).collect()
    if bad:
        raise ValueError("; ".join(f"row {r['id']}: {', '.join(r['issues'])}" for r in bad))
    return rows


def legacy_rows(old: DataFrame, types: DataFrame, split: Column) -> DataFrame:
    """Rows of the older format (place, query, expect, group, note) as dataset rows with their old group; ``types``: (query,
    query_type) where one was given by hand; ``split``: of the expected id."""
    joined = old.join(types, "query", "left")
    return joined.select(
        F.concat(F.lit("legacy-"), F.lpad(F.col("place").cast("string"), 2, "0")).alias("id"), "query", F.create_map("expect", F.lit(2)).alias("relevant"), F.coalesce("query_type", F.lit("unknown")).alias("query_type"),
        F.lit("legacy").alias("origin"), split.alias("split"), F.lit("confirmed").alias("status"), F.coalesce("note", F.lit("")).alias("notes"), F.coalesce("group", F.lit("-")).alias("legacy_group"),
    )


def by_prefix(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Hand-written rows whose ``expect`` is the beginning of an id: with ``resolved``, the one id of ``known`` (id) that begins
    so, or null where none or several do. Ids and beginnings meet by their first characters, as many as the shortest beginning has."""
    shortest = rows.agg(F.min(F.length("expect"))).first()[0] or 1
    ids = known.select(F.col("id").alias("full"), F.substring("id", 1, shortest).alias("start")).distinct()
    asked = rows.select("expect").distinct().withColumn("start", F.substring("expect", 1, shortest))
    found = asked.join(ids, "start").where(F.col("full").startswith(F.col("expect"))).groupBy("expect").agg(F.min("full").alias("resolved"), F.count("*").alias("n"))
    return rows.join(found.where("n = 1").drop("n"), "expect", "left")


def collected(sources: dict[str, DataFrame], query_column: str = "query") -> tuple[DataFrame, DataFrame]:
    """The rows of several sources without repeated queries, the first source's kept (in it the least id); and (source, rows, dropped)."""
    rows = [df.withColumn("source", F.lit(name)).withColumn("place", F.lit(k)) for k, (name, df) in enumerate(sources.items())]
    every = reduce(DataFrame.unionByName, rows).withColumn("norm", normalised(F.col(query_column)))
    first = every.groupBy("norm").agg(F.min_by(F.struct("source", "id"), F.struct("place", "id")).alias("first"))
    marked = every.join(first, "norm").withColumn("kept", (F.col("source") == F.col("first.source")) & (F.col("id") == F.col("first.id")))
    counts = marked.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(~F.col("kept")).alias("dropped"))
    return marked.where("kept").drop("norm", "first", "kept", "place"), counts


# Words of a disposition, and those a question begins with.
DISPOSITION = ("dismissed", "allowed", "set aside", "remanded", "acquitted", "costs", "granted", "disposed")
QUESTION = ("is", "are", "was", "were", "can", "could", "does", "did", "do", "when", "whether", "what", "who", "why", "how", "should", "must")
JOURNALS = ("scmr", "pld", "clc", "ylr", "mld", "plc", "ptd", "pcrlj", "sc")
STATUTE_WORDS = ("act", "ordinance", "ppc", "crpc", "cpc")
NUMBERED = ("article", "section", "order", "rule", "s")


def guessed_type(query: Column, has_case: Column) -> Column:
    """A first guess for a reviewer: citation, statute, issue, vague, entity, disposition or paraphrase. ``has_case``: whether the
    query names a case."""
    low = F.concat(F.lit(" "), F.array_join(tokens(query), " "), F.lit(" "))
    listed = lambda words: "|".join(words)
    reported = low.rlike(rf" (?:19|20)[0-9][0-9] (?:{listed(JOURNALS)}) [0-9]+ ")
    statute = low.rlike(rf" (?:{listed(NUMBERED)}) [0-9]+ | (?:{listed(STATUTE_WORDS)}) ")
    names = F.substring(query, 2, 1 << 30).rlike(r"(?:^|[^\p{L}])\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)+") | low.rlike(" (?:vs|v|versus|mst) ")
    return (
        F.when(has_case | reported, "citation").when(statute, "statute").when(low.rlike(rf"^ (?:{listed(QUESTION)}) "), "issue").when(F.size(tokens(query)) <= 4, "vague")
        .when(names, "entity").when(low.rlike(rf" (?:{listed(DISPOSITION)}) "), "disposition").otherwise("paraphrase")
    )


def ingest_report(results: DataFrame) -> DataFrame:
    """(queue, processed, done, failed, rejected, pages, makespan_s, docs_per_min, mean_latency_s, ocr_s_per_page) of each queue and, under
    null, of all: from results (queue, outcome, pages, total_s, finished_offset_s, ocr_s). Rates are of finished documents."""
    done = F.col("outcome") == "done"
    of = lambda c: F.when(done, F.col(c))
    rows = results.rollup("queue").agg(
        F.grouping("queue").alias("every"), F.count("*").alias("processed"), F.count_if(done).alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.coalesce(F.sum(of("pages")), F.lit(0)).alias("pages"), F.round(F.coalesce(F.max(of("finished_offset_s")), F.lit(0.0)), 2).alias("makespan_s"), F.round(F.avg(of("total_s")), 2).alias("mean_latency_s"),
        F.sum("ocr_s").alias("ocr"), F.sum(F.when(F.col("ocr_s").isNotNull(), F.coalesce("pages", F.lit(0)))).alias("ocr_pages"), F.max(of("finished_offset_s")).alias("last"),
    )
    rate = F.when(F.col("last") > 0, F.round(F.col("done") / (F.col("last") / 60), 2))
    return rows.select("queue", (F.col("every") == 1).alias("every"), "processed", "done", "failed", "rejected", "pages", "makespan_s", rate.alias("docs_per_min"), "mean_latency_s", F.when(F.col("ocr_pages") > 0, F.round(F.col("ocr") / F.col("ocr_pages"), 2)).alias("ocr_s_per_page"))
