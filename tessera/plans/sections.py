"""Queries on paragraphs, sections and what is read from their regions, with their SQL.

The driver's texts are invented words, so the cues of sections are words of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metadata, segments
from tessera.functions.segments import HEADINGS, OUTCOMES, PENALTIES, SECTIONS, SHARES, TRAILERS
from tessera.plans.catalogue import query

CUES = {"FACTS": ("is the",), "ARGUMENTS": ("of the", "de la"), "ISSUES": ("with the", "la de"), "ANALYSIS": ("for the", "er un")}
MATTERS_HERE, OUTCOMES_HERE = ("the", "la", "die"), ("and", "de", "und")

#: The texts with blank lines between their lines, numbers in lines of their own, and numbered lines.
TYPESET = "replace(replace(replace(text, chr(10), concat(chr(10), chr(10))), '. The ', concat('.', chr(10), chr(10), '3.', chr(10), chr(10), 'The ')), '. It ', concat('.', chr(10), '4. It '))"
PARAGRAPHS_SQL = rf"""ln AS (SELECT doc_id AS id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS k FROM (SELECT doc_id, string_split({TYPESET}, chr(10)) AS a FROM documents WHERE text <> '')),
lk AS (SELECT *, CASE WHEN regexp_full_match(line, '[ \t]*(?:\d+|-+ *page \d+(?: of \d+)? *-*|page \d+ of \d+)[ \t\r\f]*', 'i') THEN 'mark' WHEN regexp_full_match(line, '[ \t]*\(?\d{{1,4}}[.)][ \t\r\f]*') THEN 'orphan'
 WHEN regexp_matches(line, '^[ \t]*\(?\d{{1,4}}[.)][ \t]+\S') THEN 'numbered' WHEN regexp_matches(line, '^[ \t]*["“‘>]') THEN 'quote' WHEN regexp_matches(line, '\S') THEN 'text' ELSE 'blank' END AS kind FROM ln),
lb AS (SELECT id, k, kind, line, lag(kind) OVER w AS before, k - lag(k) OVER w > 1 AS gap FROM lk WHERE kind <> 'blank' WINDOW w AS (PARTITION BY id ORDER BY k)),
st AS (SELECT id, k, CASE kind WHEN 'orphan' THEN 'numbered' ELSE kind END AS kind, CASE WHEN kind IN ('orphan', 'numbered') THEN regexp_extract(line, '\d+')::BIGINT END AS number, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS idx FROM lb
 WHERE before IS NULL OR kind IN ('mark', 'numbered', 'orphan') OR before = 'mark' OR (before <> 'orphan' AND (gap OR (kind = 'quote' AND before <> 'quote')))),
ls AS (SELECT ln.id, ln.k, ln.line, greatest(sum(CASE WHEN st.k IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ln.id ORDER BY ln.k) - 1, 0) AS idx FROM ln LEFT JOIN st ON st.id = ln.id AND st.k = ln.k),
pa AS (SELECT ls.id, ls.idx::BIGINT AS idx, coalesce(any_value(st.kind), 'blank') AS kind, any_value(st.number) AS number, string_agg(line, chr(10) ORDER BY ls.k) AS text FROM ls LEFT JOIN st ON st.id = ls.id AND st.idx = ls.idx GROUP BY ls.id, ls.idx)"""

FOLD = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
ANY = lambda text, words: "(" + " OR ".join([f"contains({text}, '{w}')" for w in words] or ["false"]) + ")"
HEADED = lambda s: rf"regexp_replace(head, '^[0-9.)( ]+|[ .:]+$', '', 'g') IN ({', '.join(repr(n) for n in HEADINGS[s])})"
LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda y: {FOLD.format('y')}), lambda y: y <> '')"
TRAILER_SQL = f"(length(trim(text)) <= 400 AND len(list_filter({LINES}, lambda x: list_bool_or(list_transform([{', '.join(repr(w) for w in TRAILERS)}], lambda z: starts_with(x, z))))) >= greatest(1, len({LINES}) // 2))"
DISPOSAL_SQL = f"regexp_matches({FOLD.format('text')}, '{segments.disposal_pattern(MATTERS_HERE, OUTCOMES_HERE)}')"


def _chain() -> str:
    """Each section's first place after the section before and before the order, one step a section."""
    steps, last = [], "ax"
    for k, s in enumerate(SECTIONS[1:-1]):
        hit = f"({ANY('head', CUES[s])} OR {HEADED(s)})"
        steps.append(f"a{k} AS (SELECT {last}.*, f.pl AS s{k + 1}, coalesce(f.pl, {last}.reached) AS reached_{k} FROM {last} LEFT JOIN (SELECT h.id, min(idx) AS pl FROM hd h JOIN {last} USING (id) WHERE {hit} AND idx > {last}.reached AND ({last}.s5 IS NULL OR idx < {last}.s5) GROUP BY h.id) f ON f.id = {last}.id)")
        steps.append(f"b{k} AS (SELECT * EXCLUDE (reached, reached_{k}), reached_{k} AS reached FROM a{k})")
        last = f"b{k}"
    return ",\n".join(steps)


SPANS_SQL = f"""{PARAGRAPHS_SQL},
hd AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS idx, {FOLD.format('substr(text, 1, 300)')} AS head FROM pa WHERE kind NOT IN ('mark', 'blank')),
ax AS (SELECT d.doc_id AS id, count(h.id) AS total, max(CASE WHEN idx > 0 AND last_one THEN idx END) AS s5, 0::BIGINT AS reached FROM documents d LEFT JOIN (SELECT *, idx = max(CASE WHEN {DISPOSAL_SQL} AND NOT {TRAILER_SQL} THEN idx END) OVER (PARTITION BY id) AS last_one FROM hd) h ON h.id = d.doc_id GROUP BY d.doc_id),
{_chain()},
kn AS (SELECT id, k, [0, s1, s2, s3, s4, s5, total][k + 1] AS pl FROM b3, range(7) r(k)),
bw AS (SELECT *, max(CASE WHEN pl IS NOT NULL THEN k END) OVER (PARTITION BY id ORDER BY k) AS a, min(CASE WHEN pl IS NOT NULL THEN k END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM kn),
bo AS (SELECT w.id, w.k, coalesce(w.pl, x.pl + (y.pl - x.pl) * list_sum({list(SHARES)}[w.a + 1 : w.k]) // list_sum({list(SHARES)}[w.a + 1 : w.b]))::BIGINT AS pl FROM bw w JOIN kn x ON x.id = w.id AND x.k = w.a JOIN kn y ON y.id = w.id AND y.k = w.b),
sn AS (SELECT x.id, {list(SECTIONS)}[x.k + 1] AS section, x.pl AS first, y.pl AS stop FROM bo x JOIN bo y ON y.id = x.id AND y.k = x.k + 1),
se AS (SELECT sn.id, section, first, stop, coalesce(string_agg(text, chr(10) ORDER BY idx), '') AS text FROM sn LEFT JOIN hd ON hd.id = sn.id AND idx >= first AND idx < stop GROUP BY sn.id, section, first, stop)"""


def typeset(t) -> DataFrame:
    return t("documents").select("doc_id", F.expr(TYPESET).alias("text"))


def spanned(t) -> DataFrame:
    return segments.spans(typeset(t), "doc_id", "text", CUES, MATTERS_HERE, OUTCOMES_HERE)


@query("paragraph_split", f"WITH {PARAGRAPHS_SQL} SELECT id, idx, kind, number, text FROM pa")
def paragraph_split(t):
    """The paragraphs of every document: numbered, quoted, page marks, text."""
    rows = typeset(t).select(F.col("doc_id").alias("id"), F.posexplode(segments.paragraphs(F.col("text"))).alias("idx", "p"))
    return rows.select("id", "idx", "p.*")


@query("segment_sections", f"WITH {SPANS_SQL} SELECT id, section, first, stop, text FROM se")
def segment_sections(t):
    """Six ordered sections without gaps of every document."""
    return segments.section_rows(spanned(t))


LABELS = " ".join(f"WHEN {ANY('head', CUES[s])} THEN '{s}'" for s in ("ANALYSIS", "ARGUMENTS", "ISSUES", "FACTS"))


@query(
    "paragraph_labels",
    f"WITH {SPANS_SQL}, tn AS (SELECT id, total FROM ax) SELECT hd.id, idx, section, CASE WHEN {TRAILER_SQL.replace('text', 'hd.text')} THEN 'TRAILER' WHEN {DISPOSAL_SQL.replace('text', 'hd.text')} AND 3 * idx >= 2 * total THEN 'ORDER' {LABELS} ELSE section END AS label FROM hd JOIN tn USING (id) JOIN se ON se.id = hd.id AND idx >= first AND idx < stop",
)
def paragraph_labels(t):
    """What each paragraph is by its own words and by its place."""
    return segments.labelled(spanned(t), CUES, MATTERS_HERE, OUTCOMES_HERE)


CHECKS_SQL = {
    "court": "NOT contains(h, 'supreme court')",
    "judge": "NOT contains(h, 'justice')",
    "case_number": "NOT regexp_matches(h, '(civil|criminal|constitution) (appeal|petition)')",
    "facts_analysis": ANY("f", ("we have", "we are", "we find", "we hold", "in our view")),
    "no_question": "NOT " + ANY("i", ("whether", "?")),
    "generic_issues": f"contains(i, '{segments.GENERIC}')",
    "no_outcome": "NOT " + ANY("o", OUTCOMES),
    "order_trailer": f"(o = '' OR {TRAILER_SQL.replace('text', 'ot')})",
    "no_submission": "(g <> '' AND NOT " + ANY("g", ("learned counsel", "learned asc", "argued that", "submitted that", "contended that", "urged that", "on behalf of")) + ")",
    "facts_caption": " + ".join(f"contains(f, '{w}')::INT" for w in ("versus", "date of hearing", "for the appellant", "for the respondent")) + " >= 2",
}
WIDE_SQL = ", ".join(f"{FOLD.format(f'max(CASE WHEN section = {s!r} THEN text END)')} AS {a}" for s, a in (("HEADER", "h"), ("FACTS", "f"), ("ARGUMENTS", "g"), ("ISSUES", "i"), ("ORDER", "o")))


@query(
    "parse_quality",
    f"WITH {SPANS_SQL}, wd AS (SELECT id, {WIDE_SQL}, max(CASE WHEN section = 'ORDER' THEN text END) AS ot FROM se GROUP BY 1), ck AS (SELECT id, list_filter([{', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in CHECKS_SQL.items())}], lambda x: x IS NOT NULL) AS issues, "
    f"round(greatest(0, 0.95 - ({' + '.join(f'CASE WHEN {c} THEN {PENALTIES[n]}::DOUBLE ELSE 0 END' for n, c in CHECKS_SQL.items())})), 4) AS score FROM wd) SELECT id, array_to_string(issues, ',') AS issues, score, len(issues) <= 2 AS passes FROM ck",
)
def parse_quality(t):
    """What the sections of each document lack, by ten checks."""
    return segments.quality(segments.section_texts(spanned(t))).withColumn("issues", F.array_join("issues", ","))


JUDGMENT = """concat('--- PAGE 1 ---', chr(10), 'SUPREME COURT', chr(10), 'PRESENT:', chr(10), 'Mr. Justice ', CASE WHEN doc_id % 2 = 0 THEN 'Ali Khan' ELSE 'Omar Shah, CJ' END, chr(10), 'CIVIL APPEALS NO. ', doc_id, '-K AND ', doc_id + 1, ' OF 20', 10 + doc_id % 9, chr(10),
 '(On appeal from the judgment dated 3.', 1 + doc_id % 12, '.2009 passed by the Peshawar High Court in W.P. No. 7/2008)', chr(10), 'Person ', lang, chr(10), 'Versus', chr(10), 'The State and others', chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Date of decision: 05.06.2019' ELSE 'Date of hearing: 1st May, 2018' END, chr(10), 'JUDGMENT', chr(10),
 replace(coalesce(text, ''), 'Date of', ''), chr(10), repeat('filler ', 110), chr(10), CASE WHEN doc_id % 5 = 0 THEN concat('Announced on 7.8.', 2015 + doc_id % 4) WHEN doc_id % 5 = 1 THEN 'Lahore, the 2nd March, 2016' ELSE 'The appeal is dismissed.' END)"""


@query(
    "judgment_metadata",
    f"""WITH j AS (SELECT doc_id AS id, 'CA-' || doc_id || '-K-20' || 10 + doc_id % 9 AS a, 'CA-' || doc_id + 1 || '-20' || 10 + doc_id % 9 AS b, lang, {JUDGMENT} AS text FROM documents)
SELECT id, a || ',' || b AS case_keys, 'Civil Appeal No. ' || id || '-K of 20' || 10 + id % 9 || ' (+1 connected)' AS case_display, CASE WHEN id % 2 = 0 THEN 'Ali Khan' ELSE 'Omar Shah (CJ)' END AS bench, 'Person ' || lang AS appellant, 'The State' AS respondent, 'Peshawar High Court' AS lower_court,
 '03.' || lpad((1 + id % 12)::VARCHAR, 2, '0') || '.2009' AS impugned_date, CASE WHEN id % 3 = 0 THEN '05.06.2019' WHEN id % 5 = 0 THEN '07.08.' || 2015 + id % 4 WHEN id % 5 = 1 THEN '02.03.2016' ELSE '01.05.2018' END AS decision_date,
 CASE WHEN id % 3 = 0 THEN 'caption_decision' WHEN id % 5 = 0 THEN 'announced' WHEN id % 5 = 1 THEN 'signature' ELSE 'hearing' END AS decision_date_source, CASE WHEN id % 5 > 1 THEN 'dismissed' ELSE 'unknown' END AS outcome FROM j""",
)
def judgment_metadata(t):
    """The fields of every document behind a caption of its own."""
    docs = t("documents").select("doc_id", F.expr(JUDGMENT).alias("text"))
    rows = metadata.metadata(docs, "doc_id", "text")
    return rows.select("id", F.array_join("case_keys", ",").alias("case_keys"), "case_display", F.array_join("bench", ",").alias("bench"), "appellant", "respondent", "lower_court", "impugned_date", "decision_date", "decision_date_source", "outcome")


ASKED = "concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN ' v. ' ELSE ' and ' END, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN concat(' C.A. ', c_custkey, '-L/2014') ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN ' under section 302 PPC in Quetta' ELSE ' in 2011 and 1930' END, CASE WHEN c_custkey % 7 = 0 THEN ' appeal dismissed' ELSE '' END)"


@query(
    "query_analysis",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'CA-' || c_custkey || '-L-2014' ELSE '' END AS keys, CASE WHEN c_custkey % 5 = 0 THEN 'Section 302 PPC' ELSE '' END AS statutes, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '2014' ELSE '2014,2011' END WHEN c_custkey % 5 = 0 THEN '' ELSE '2011' END AS years,
 CASE WHEN c_custkey % 3 = 0 THEN 'L' WHEN c_custkey % 5 = 0 THEN 'Q' END AS registry, CASE WHEN c_custkey % 7 = 0 THEN 'dismissed' END AS outcome, c_custkey % 2 = 0 AS versus FROM customer""",
)
def query_analysis(t):
    """What query strings name: cases, statutes, years, a registry, an outcome, parties."""
    rows = metadata.query_analysis(t("customer").select("c_custkey", F.expr(ASKED).alias("text")), "c_custkey", "text")
    joined = lambda c: F.array_join(c, ",")
    return rows.select("id", joined(F.transform("case_refs", lambda r: r["key"])).alias("keys"), joined("statutes").alias("statutes"), joined(F.col("years").cast("array<string>")).alias("years"), "registry", "outcome", (F.size("parties") == 2).alias("versus"))
