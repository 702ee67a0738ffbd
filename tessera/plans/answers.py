"""Queries on generated texts held against their sources, with their SQL.

A document stands for what was generated from the document before it (many are copies of each other, so that some of their
sentences are supported).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.cards import json_in
from tessera.functions.parse import apply
from tessera.operators import grounding
from tessera.operators.grounding import CONFLICTS, FORBIDDEN, GENERIC, LAW_NUMBERS, LAWS, LEAST_WORDS, NUMBER_WORDS, OUTCOME_WORDS
from tessera.plans.catalogue import query

PAIRS = "pr AS (SELECT a.doc_id AS id, a.text, b.text AS source FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1)"
LISTED = lambda words: ", ".join(f"'{w}'" for w in words)
NAMES = r"list_filter(list_transform(regexp_extract_all(s, '(?:^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}''’-]{2,})', 1), lambda w: regexp_replace(w, '(?:[''’]s|[''’-]+)$', '')), lambda w: lower(w) NOT IN (" + LISTED(GENERIC) + "))"
DATES = r"list_filter(list_transform(regexp_extract_all(s, '[\p{L}\p{N}_][\p{L}\p{N}_./-]*'), lambda w: regexp_replace(w, '[./-]+$', '')), lambda w: regexp_full_match(w, '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|(?:19|20)[0-9]{2}'))"


def pairs(t) -> DataFrame:
    """(id, text, source)."""
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(docs.select((F.col("id") + 1).alias("id"), F.col("text").alias("source")), "id", "left")


@query(
    "grounded_sentences",
    rf"""WITH {PAIRS}, f AS (SELECT id, text, regexp_replace(coalesce(source, ''), '\s+', ' ', 'g') AS plain FROM pr),
u AS (SELECT id, plain, unnest(a) AS s, generate_subscripts(a, 1) AS k FROM (SELECT id, plain, list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS a FROM f)),
b AS (SELECT id, k, s, list_concat(list_filter({NAMES}, lambda w: NOT contains(lower(plain), lower(w))), list_filter({DATES}, lambda d: NOT contains(plain, d))) AS bad FROM u)
SELECT pr.id, count(s)::BIGINT AS checked, coalesce(string_agg(CASE WHEN len(bad) = 0 THEN s END, ' ' ORDER BY k), '') AS kept, coalesce(string_agg(CASE WHEN len(bad) > 0 THEN array_to_string(bad, ',') END, ';' ORDER BY k), '') AS dropped FROM pr LEFT JOIN b USING (id) GROUP BY 1""",
)
def grounded_sentences(t):
    """The sentences of every text whose names and dates its source has, and the names and dates for which others went."""
    rows = grounding.grounded(pairs(t), "source", ["text"])
    return rows.select("id", "checked", F.col("text").alias("kept"), F.array_join(F.transform("dropped", lambda d: F.array_join(d["tokens"], ",")), ";").alias("dropped"))


FOLD = r"trim(regexp_replace(lower(coalesce({}, '')), '\s+', ' ', 'g'))"
HAS = lambda c, words: "(" + " OR ".join([f"contains({c}, '{w}')" for w in words]) + ")"
TOPIC = " OR ".join("(" + " AND ".join([HAS("o", any_of), *[f"contains(o, '{w}')" for w in all_of], HAS("s", out)]) + ")" for any_of, all_of, out in CONFLICTS)


@query(
    "summary_issues",
    rf"""WITH {PAIRS}, f AS (SELECT id, {FOLD.format("text")} AS s, {FOLD.format("source")} AS o FROM pr),
c AS (SELECT id, list_filter([CASE WHEN s = '' OR o = '' THEN 'empty' END, CASE WHEN len(list_filter(regexp_extract_all(s, '{"|".join((*LAWS, *LAW_NUMBERS))}'), lambda w: NOT contains(o, w))) > 0 THEN 'law' END, CASE WHEN {TOPIC} THEN 'topic' END,
 CASE WHEN {HAS("s", FORBIDDEN)} THEN 'phrase' END, CASE WHEN len(regexp_extract_all(s, '\S+')) < {LEAST_WORDS} THEN 'short' END, CASE WHEN NOT {HAS("s", OUTCOME_WORDS)} THEN 'outcome' END], lambda x: x IS NOT NULL) AS a FROM f)
SELECT id, array_to_string(a, ',') AS issues, len(a) = 0 AS shown FROM c""",
)
def summary_issues(t):
    """Why each text can't stand as its source's summary."""
    issues = grounding.summary_issues(F.col("text"), F.col("source"))
    return pairs(t).select("id", issues.alias("a")).select("id", F.array_join("a", ",").alias("issues"), (F.size("a") == 0).alias("shown"))


SPELLED = "map {" + ", ".join(f"'{w}': {n}" for w, n in NUMBER_WORDS.items()) + "}"
RAW, REWRITE = "concat('Order ', o_orderkey, ' of ', year(o_orderdate), ' twenty five ', o_orderpriority)", "concat('the order ', o_orderkey % 1000, ' twenty one ninety of ', year(o_orderdate), ' for 25 or ', o_custkey, ' forty five hundred')"


def numbers_sql(column: str, name: str) -> str:
    """``name`` (id, n): the distinct numbers of a text, digits and spelled ones."""
    return f"""{name}w AS (SELECT id, k, v, lag(v) OVER w AS before, lead(v) OVER w AS after FROM (SELECT id, generate_subscripts(a, 1) AS k, {SPELLED}[unnest(a)] AS v FROM (SELECT id, regexp_extract_all(lower({column}), '[a-z]+') AS a FROM tx)) WINDOW w AS (PARTITION BY id ORDER BY k)),
{name} AS (SELECT DISTINCT id, n FROM (SELECT id, unnest(regexp_extract_all({column}, '[0-9]+')) AS n FROM tx UNION ALL SELECT id, (CASE WHEN v >= 20 AND after BETWEEN 1 AND 9 THEN v + after ELSE v END)::VARCHAR FROM {name}w WHERE v IS NOT NULL AND NOT coalesce(v BETWEEN 1 AND 9 AND before >= 20, false)))"""


@query(
    "rewrite_adds",
    f"WITH tx AS (SELECT o_orderkey AS id, {RAW} AS raw, {REWRITE} AS rewrite FROM orders), {numbers_sql('raw', 'ra')}, {numbers_sql('rewrite', 'rb')} SELECT id, n AS number FROM rb ANTI JOIN ra USING (id, n)",
)
def rewrite_adds(t):
    """The numbers of a rewritten query that the query lacks, spelled or in digits."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.expr(RAW).alias("raw"), F.expr(REWRITE).alias("rewrite"))
    return rows.select("id", F.explode(grounding.added(F.col("rewrite"), F.col("raw"))).alias("number"))


SUBJECTS = ["Economy", "Small", "Large", "Promo"]
ANSWER = """concat('Here it is: ```json {"subject": " ', upper(p_type), '", "headnote": " ', p_name, ' ", "issues": "', p_name, '", "holding": null, "keywords": ["', replace(p_name, ' ', '", "'), '", " ", {"k": "', p_brand, '", "z": "x"}, ', p_size, ', "a", "b", "c", "d", "e", "f"]} ```')"""


@query(
    "card_fields",
    f"""SELECT p_partkey AS id, coalesce(map {{{", ".join(f"'{s.lower()}': '{s}'" for s in SUBJECTS)}}}[lower(p_type)], 'Other') AS subject, p_name AS headnote, p_name AS issues, '' AS holding,
 array_to_string(list_concat(string_split(p_name, ' '), [p_brand || ' x', p_size::VARCHAR, 'a', 'b', 'c', 'd', 'e', 'f'])[1:8], '; ') AS keywords FROM part""",
)
def card_fields(t):
    """The fields of noisy JSON answers: one of the known subjects, lists of texts, eight keywords."""
    rows = t("part").select(F.col("p_partkey").alias("id"), apply(json_in, "string", F.expr(ANSWER)).alias("answer"))
    rows = rows.select("id", grounding.card_fields(F.col("answer"), SUBJECTS).alias("c")).select("id", "c.*")
    return rows.select("id", "subject", "headnote", F.array_join("issues", "; ").alias("issues"), "holding", F.array_join("keywords", "; ").alias("keywords"))



PART = "concat('[RELEVANT FACTS] ', CASE WHEN {0} % 3 = 0 THEN {1} ELSE 'not found in retrieved judgments' END, ' [LEGAL ISSUE] [COURT REASONING]', chr(10), CASE WHEN {0} % 5 = 0 THEN {1} ELSE 'Not Found in Retrieved Judgments.' END, ' [FINAL DECISION] ', CASE WHEN {0} % 2 = 0 THEN {1} ELSE '' END, CASE WHEN {0} % 7 = 0 THEN '[NO RELEVANT AUTHORITY]' ELSE '' END, '[KEY PRINCIPLE] ', {1})"


@query("unsupported_answers", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND text IS NOT NULL THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '' END AS decision, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 2 = 0 AND doc_id % 7 <> 0 AS unsupported FROM documents WHERE regexp_matches(text, '\\S') AND NOT contains(text, '[')")
def unsupported_answers(t):
    """Answers that report a decision though nothing of substance was found."""
    rows = t("documents").where(r"text rlike '\\S' and not contains(text, '[')").select(F.col("doc_id").alias("id"), F.expr(PART.format("doc_id", "text")).alias("answer"))
    decision = F.regexp_replace(grounding.answer_part(F.col("answer"), grounding.DECISION), r"\s*\[NO RELEVANT AUTHORITY\]$", "")
    return rows.select("id", decision.alias("decision"), grounding.unsupported_answer(F.col("answer")).alias("unsupported"))


@query("judge_ranking", "WITH c AS (SELECT conv_id AS id, list(turn ORDER BY turn) AS f FROM conversations GROUP BY 1), r AS (SELECT id, f, [f[3], f[1]] AS own FROM c), u AS (SELECT id, unnest(list_concat(list_filter(own, lambda x: x IS NOT NULL), f)) AS x, generate_subscripts(list_concat(list_filter(own, lambda x: x IS NOT NULL), f), 1) AS k FROM r) SELECT id, array_to_string(list(x ORDER BY k), ',') AS ids FROM (SELECT id, x, min(k) AS k FROM u GROUP BY 1, 2) GROUP BY 1")
def judge_ranking(t):
    """A judge's ranking of labels as ids: unknown and repeated labels out, omitted ids behind."""
    rows = t("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list("turn")).alias("f"))
    labels = F.map_from_arrays(F.transform("f", lambda x, k: F.concat(F.lit("C"), (k + 1).cast("string"))), F.col("f"))
    ranking = F.array(F.lit("C3"), F.lit(" C1 "), F.lit("C99"), F.lit("C3"))
    return rows.select("id", F.array_join(grounding.ranked(ranking, labels, F.col("f")).cast("array<string>"), ",").alias("ids"))
