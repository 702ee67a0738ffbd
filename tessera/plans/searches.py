"""Queries on search expressions and the stored index of several fields, with their SQL.

Cards are orders: their key and priority the case, customer and supplier the parties. Asked are customers whose id is
divisible by 100, and all benchmark strings with two compound words made of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.cards import CARD_COLUMNS, WEIGHTS
from tessera.operators import expressions as ex
from tessera.operators import paging
from tessera.operators.fields import FieldIndex, stored
from tessera.plans.catalogue import FUSED_SQL, GATE_SQL, fused_rows, gate_rows, query
from tessera.sources.store import kept, shared_dir

WORD = r"'[\p{L}\p{N}]+'"
LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
NUMBER = r"regexp_full_match(p, '\p{N}+')"
#: From ``asked`` (qid, texts, narrative) to the expressions ``e`` (qid, ord, kind, parts, plain).
EXPRESSIONS = rf"""tk AS (SELECT qid, narrative, unnest(a) AS tok, generate_subscripts(a, 1) AS place FROM (SELECT qid, narrative, regexp_extract_all(lower(array_to_string(texts, ' ')), '\S+') AS a FROM asked)),
tp AS (SELECT *, regexp_extract_all(tok, {WORD}) AS parts FROM tk),
tq AS (SELECT *, len(list_filter(parts, lambda p: {NUMBER})) AS numbers, len(list_filter(parts, lambda p: length(p) = 1 AND NOT {NUMBER})) AS initials FROM tp),
tg AS (SELECT * FROM tq WHERE len(parts) > 1 AND initials < len(parts)),
er AS (SELECT qid, place * 1000 AS pt, 'term' AS kind, parts, true AS plain FROM tq WHERE len(parts) = 1 AND length(parts[1]) > 1 AND NOT list_contains(CASE WHEN narrative THEN {LISTED(set(ex.STOPWORDS) | set(ex.NARRATIVE_STOPWORDS))} ELSE {LISTED(set(ex.STOPWORDS))} END, parts[1])
 UNION ALL SELECT qid, place * 1000, CASE WHEN numbers > 0 THEN 'near' ELSE 'phrase' END, parts, false FROM tg
 UNION ALL SELECT qid, place * 1000 + k, 'term', [p], false FROM (SELECT qid, place, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM tg) WHERE {NUMBER} AND length(p) >= 2),
e AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY min(pt)) - 1 AS ord, kind, parts, arg_min(plain, pt) AS plain FROM er GROUP BY qid, kind, parts)"""


def search_sql(fields: list[str], weights: tuple) -> str:
    """From ``live`` (id, fields) and ``e`` to ``sc`` (qid, id, score, rank)."""
    places = " UNION ALL ".join(f"SELECT id, {k + 1} AS f, unnest(a) AS term, generate_subscripts(a, 1) AS pos FROM (SELECT id, regexp_extract_all(lower({c}), {WORD}) AS a FROM live)" for k, c in enumerate(fields))
    w = "sum([" + ", ".join(str(float(x)) for x in weights) + "][f])"
    return f"""p AS ({places}), dl AS (SELECT id, count(*) AS dl FROM p GROUP BY 1),
us AS (SELECT kind, parts, len(parts) AS n, unnest(parts) AS term, generate_subscripts(parts, 1) AS k FROM (SELECT DISTINCT kind, parts FROM e)),
m AS (SELECT kind, parts, n, k, id, f, pos FROM us JOIN p USING (term)),
ph AS (SELECT parts, id, f, pos - k AS s FROM m WHERE n > 1 AND kind = 'phrase' GROUP BY parts, n, id, f, s HAVING count(DISTINCT k) = n),
ns AS (SELECT a.parts, a.id, a.f, a.pos AS s FROM (SELECT DISTINCT parts, n, id, f, pos FROM m WHERE n > 1 AND kind = 'near') a JOIN m b ON b.kind = 'near' AND a.parts = b.parts AND a.id = b.id AND a.f = b.f AND b.pos BETWEEN a.pos AND a.pos + 3 GROUP BY a.parts, a.n, a.id, a.f, a.pos HAVING count(DISTINCT b.k) = a.n),
nr AS (SELECT DISTINCT m.parts, m.k, m.id, m.f, m.pos FROM m JOIN ns ON m.kind = 'near' AND m.parts = ns.parts AND m.id = ns.id AND m.f = ns.f AND m.pos BETWEEN s AND s + 3),
h AS (SELECT 'term' AS kind, parts, 1 AS k, id, {w} AS tf FROM m WHERE n = 1 GROUP BY parts, id UNION ALL SELECT 'phrase', parts, 1, id, {w} FROM ph GROUP BY parts, id UNION ALL SELECT 'near', parts, k, id, {w} FROM nr GROUP BY parts, k, id),
dt AS (SELECT term, count(DISTINCT id) AS df FROM p WHERE term IN (SELECT term FROM us) GROUP BY 1),
dv AS (SELECT kind, parts, k, df FROM us JOIN dt USING (term) WHERE n = 1 OR kind = 'near' UNION ALL SELECT 'phrase', parts, 1, count(DISTINCT id) FROM ph GROUP BY parts),
g AS (SELECT (SELECT count(*) FROM live) AS total, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM live) AS avgdl),
gain AS (SELECT h.kind, h.parts, h.id, CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS gain FROM h JOIN dv ON h.kind = dv.kind AND h.parts = dv.parts AND h.k = dv.k JOIN dl ON h.id = dl.id, g),
sc AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(gain), 6) AS score FROM gain JOIN e ON gain.kind = e.kind AND gain.parts = e.parts GROUP BY 1, 2))"""


def _texts(rows: DataFrame, id_column: str, cleaned, *more) -> DataFrame:
    """(qid, texts, narrative)."""
    texts = ex.phrasings(F.array(cleaned), *more)
    return rows.select(F.col(id_column).alias("qid"), texts.alias("texts"), ex.is_narrative(cleaned).alias("narrative"))


def expressed(asked: DataFrame) -> DataFrame:
    return ex.expressions(asked, "qid", F.col("texts"), F.col("narrative"))


PHRASINGS = "SELECT page_id AS qid, [trim(url), lower(url), 'page ' || page_id] AS a FROM pages"


@query("query_phrasings", f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY min(k)) - 1 AS ord, x AS text FROM (SELECT qid, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM ({PHRASINGS})) GROUP BY qid, x")
def query_phrasings(t):
    """The distinct texts of a query in order of first mention; nulls and blanks are none."""
    more = F.array(F.lower("url"), F.lit(None), F.lit("  "), F.col("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    texts = _texts(t("pages"), "page_id", F.col("url"), more)
    return texts.select("qid", F.posexplode("texts").alias("ord", "text"))


@query("query_expressions", f"WITH asked AS (SELECT page_id AS qid, [url, 'page ' || page_id] AS texts, false AS narrative FROM pages), {EXPRESSIONS} SELECT qid, ord, kind, array_to_string(parts, ' ') AS parts, plain FROM e")
def query_expressions(t):
    """Terms, phrases and near groups of every page's address."""
    asked = _texts(t("pages"), "page_id", F.col("url"), F.array(F.concat(F.lit("page "), F.col("page_id").cast("string"))))
    return expressed(asked).withColumn("parts", F.array_join("parts", " "))


LONG_ASKED = "asked AS (SELECT doc_id AS qid, [coalesce(text, '')] AS texts, len(regexp_extract_all(coalesce(text, ''), '\\S+')) >= 25 AS narrative FROM documents WHERE doc_id % 100 = 0)"


@query(
    "query_budget",
    f"""WITH {LONG_ASKED}, {EXPRESSIONS}, df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {WORD})) AS term FROM documents) GROUP BY 1),
z AS (SELECT qid, count(*) AS n, count(*) FILTER (NOT plain) AS fixed FROM e GROUP BY 1),
c AS (SELECT e.*, row_number() OVER (PARTITION BY qid ORDER BY df, ord) AS place FROM e JOIN df ON df.term = parts[1] WHERE plain),
k AS (SELECT qid, ord FROM e WHERE NOT plain UNION ALL SELECT qid, ord FROM c JOIN z USING (qid) WHERE place <= 64 - fixed),
l AS (SELECT qid, ord FROM e JOIN z USING (qid) WHERE n <= 64 UNION ALL SELECT qid, ord FROM (SELECT qid, ord, row_number() OVER (PARTITION BY qid ORDER BY ord) AS place FROM k) JOIN z USING (qid) WHERE n > 64 AND place <= 64)
SELECT qid, ord, kind, array_to_string(parts, ' ') AS parts FROM e JOIN l USING (qid, ord)""",
)
def query_budget(t):
    """Whole documents as queries: groups and numbers stay, of the plain words the rarest, 64 in all, in their order."""
    index = stored(t("documents"), "doc_id", ["text"])
    asked = expressed(_texts(t("documents").where("doc_id % 100 = 0"), "doc_id", F.coalesce("text", F.lit(""))))
    return ex.budgeted(asked, index.dictionary().withColumnRenamed("stem", "term")).select("qid", "ord", "kind", F.array_join("parts", " ").alias("parts"))


COMPOUND = "[text, w[2] || '-' || w[3], w[4] || '.' || w[5] || '.' || w[6], 'version-2.0', '2.0/version']"


@query(
    "expression_search",
    f"""WITH asked AS (SELECT item_id AS qid, {COMPOUND} AS texts, len(regexp_extract_all(text, '\\S+')) >= 25 AS narrative FROM (SELECT item_id, text, regexp_extract_all(lower(text), {WORD}) AS w FROM benchmark)), {EXPRESSIONS},
live AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {search_sql(["text"], (1,))} SELECT qid, id, score, rank FROM sc WHERE rank <= 10""",
)
def expression_search(t):
    """The ten best documents for every benchmark string with its terms, phrases and near groups, from the stored index."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    word = lambda k: F.get(words, F.lit(k - 1))
    more = F.array(F.concat_ws("-", word(2), word(3)), F.concat_ws(".", word(4), word(5), word(6)), F.lit("version-2.0"), F.lit("2.0/version"))
    rows = expressed(_texts(t("benchmark"), "item_id", F.col("text"), more))
    return stored(t("documents"), "doc_id", ["text"]).search(rows, 10)


CARDS_SQL = """cards AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey || '-' || o_orderpriority || '/' || year(o_orderdate) AS case_display, o_orderkey || '-' || year(o_orderdate) AS case_keys, c_name AS appellant, coalesce(s_name, '') AS respondent,
 o_orderpriority AS bench, 'Region ' || n_regionkey AS statutes, c_mktsegment AS subject, n_name || ' ' || c_mktsegment || ' ' || o_orderstatus AS headnote, coalesce(flags, '') AS issues, o_orderstatus AS holding, coalesce(p_name, '') AS keywords
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s, min(l_partkey) AS p, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN supplier ON s = s_suppkey LEFT JOIN part ON p = p_partkey)"""
LIVE_CARDS = CARDS_SQL + ", live AS (SELECT * EXCLUDE (keywords), CASE WHEN holding = 'P' THEN keywords || ' red-widget' ELSE keywords END AS keywords FROM cards WHERE id % 7 <> 0)"


def cards(t) -> DataFrame:
    """A card of eleven text columns for every order."""
    items = t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"), F.min("l_partkey").alias("p_partkey"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("flags"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("supplier"), "s_suppkey", "left").join(t("part"), "p_partkey", "left")
    key, year, none = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string"), F.lit("")
    columns = [
        F.concat(F.lit("Order "), key, F.lit("-"), "o_orderpriority", F.lit("/"), year), F.concat(key, F.lit("-"), year), F.col("c_name"), F.coalesce("s_name", none),
        F.col("o_orderpriority"), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")), F.col("c_mktsegment"), F.concat_ws(" ", "n_name", "c_mktsegment", "o_orderstatus"),
        F.coalesce("flags", none), F.col("o_orderstatus"), F.coalesce("p_name", none),
    ]
    return rows.select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in zip(CARD_COLUMNS, columns)])


def card_index(t) -> FieldIndex:
    """The index of all cards after some were amended and some removed."""
    rows = cards(t)
    index = FieldIndex(rows.sparkSession, shared_dir(rows.sparkSession, "cards"), list(CARD_COLUMNS), stemmed=False)
    index.upsert(rows, "id")
    index.upsert(rows.where("holding = 'P'").withColumn("keywords", F.concat("keywords", F.lit(" red-widget"))), "id")
    index.remove(rows.where("id % 7 = 0"), "id")
    return index


@query(
    "card_search",
    f"""WITH asked AS (SELECT c_custkey AS qid, [lower(c_name || ' ' || c_mktsegment), 'supplier#' || lpad(c_custkey::VARCHAR, 9, '0'), '1-urgent', 'red-widget'] AS texts, false AS narrative FROM customer WHERE c_custkey % 100 = 0), {EXPRESSIONS},
{LIVE_CARDS}, {search_sql(list(CARD_COLUMNS), WEIGHTS)} SELECT qid, id, score, rank FROM sc WHERE rank <= 10""",
)
def card_search(t):
    """The ten best cards by the weights of their eleven columns, from an index that was changed and compacted."""
    index = card_index(t)
    index.compact()
    more = F.array(F.concat(F.lit("supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), F.lit("1-urgent"), F.lit("red-widget"))
    asked = t("customer").where("c_custkey % 100 = 0")
    rows = expressed(_texts(asked, "c_custkey", F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), more))
    return index.search(rows, 10, list(WEIGHTS))


@query(
    "index_figures",
    f"WITH {LIVE_CARDS}, w AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', {', '.join(CARD_COLUMNS)})), {WORD})) AS term FROM live) SELECT (SELECT count(*) FROM (SELECT DISTINCT id, term FROM w)) AS postings, count(DISTINCT term) AS stems, (SELECT count(*) FROM live) AS documents, count(*) AS words FROM w",
)
def index_figures(t):
    """Posting rows, terms, documents and words of the changed card index, from its log and dictionary."""
    return card_index(t).counts()


def paged_rows(t) -> DataFrame:
    """The fused lists with the relevance that a scorer would give, searched once for all that reads them."""
    return kept(gate_rows(t).select("qid", "id", "position", "pinned", "relevance"), "fused")


PASSES = "coalesce(pinned OR relevance >= 0.12, false)"


@query(
    "paging_requests",
    f"""WITH RECURSIVE {GATE_SQL}, o AS (SELECT qid, id, position, {PASSES} AS pass, (position - 1) // 10 AS s FROM g),
sl AS (SELECT qid, s, count(*) AS len, count(*) FILTER (pass) AS hits, bool_or(pass AND back <= 5) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY qid, s ORDER BY position DESC) AS back FROM o) GROUP BY 1, 2),
nn AS (SELECT qid, count(*) AS n FROM o GROUP BY 1),
st AS (SELECT sl.qid, 1 AS request, 0 AS step, len AS scanned, tail, 30 AS budget, 0::BIGINT AS have, 0::BIGINT AS spare, hits AS shown, false AS closed FROM sl WHERE s = 0
 UNION ALL SELECT st.qid, request + CASE WHEN closed THEN 1 ELSE 0 END, step + 1,
  CASE WHEN NOT closed AND scan THEN scanned + x.len ELSE scanned END, CASE WHEN NOT closed AND scan THEN x.tail ELSE st.tail END,
  CASE WHEN closed THEN 30 WHEN scan THEN budget - x.len ELSE budget END,
  CASE WHEN closed THEN least(spare, least(10, 100 - shown - have)) WHEN scan THEN least(have + x.hits, size) ELSE have END,
  CASE WHEN closed THEN spare - least(spare, least(10, 100 - shown - have)) WHEN scan THEN spare + have + x.hits - least(have + x.hits, size) ELSE spare END,
  CASE WHEN closed THEN shown + have ELSE shown END, NOT closed AND NOT scan
  FROM (SELECT st.*, least(10, 100 - shown) AS size, n, have < least(10, 100 - shown) AND budget > 0 AND tail AND scanned < n AS scan FROM st JOIN nn USING (qid)) st LEFT JOIN sl x ON x.qid = st.qid AND x.s = st.scanned // 10 WHERE request < 3 OR NOT closed),
pg AS (SELECT qid, 0 AS request, hits AS have, 0::BIGINT AS before FROM sl WHERE s = 0 UNION ALL SELECT qid, request, have, shown FROM st WHERE closed),
ps AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY position) AS k FROM o WHERE pass)
SELECT pg.qid, request::BIGINT AS request, id, k - before AS slot FROM pg JOIN ps ON ps.qid = pg.qid AND k > before AND k <= before + have""",
)
def paging_requests(t):
    """The first page and three further ones of every query: what is scored depends on what passed before."""
    score = paging.by_relevance(0.12)
    page, session = paging.opened(paged_rows(t), score)
    pages = [page]
    for _ in range(3):
        page, session = paging.next_page(session, score)
        pages.append(page)
    return reduce(DataFrame.unionByName, [p.withColumn("request", F.lit(k)) for k, p in enumerate(pages)])


FILTERED = "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500"


@query(
    "paging_filtered",
    f"""WITH {GATE_SQL}, o AS (SELECT qid, id, position, {PASSES} AS pass FROM g),
al AS (SELECT *, position <= 10 AND pass AS listed, row_number() OVER (PARTITION BY qid, position <= 10 ORDER BY position) AS k FROM o WHERE id IN ({FILTERED})),
pe AS (SELECT *, (k - 1) // 10 AS s FROM al WHERE position > 10),
sl AS (SELECT qid, s, count(*) FILTER (pass) AS hits FROM pe GROUP BY 1, 2),
cu AS (SELECT *, coalesce(sum(hits) OVER (PARTITION BY qid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(min(hits) OVER (PARTITION BY qid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS least_hits FROM sl),
sc AS (SELECT qid, s FROM cu WHERE s < 4 AND before < 10 AND least_hits > 0),
ok AS (SELECT qid, id, position FROM pe JOIN sc USING (qid, s) WHERE pass)
SELECT qid, id, slot FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY position) AS slot FROM ok) WHERE slot <= 10""",
)
def paging_filtered(t):
    """The second page among the documents of a filter, after a first page without it."""
    score = paging.by_relevance(0.12)
    rows = paged_rows(t)
    _, session = paging.opened(rows, score)
    allowed = rows.join(t("documents").where("lang = 'en' and n_chars >= 500").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return paging.filtered_page(session, allowed, score)[0]


@query(
    "category_browse",
    f"""WITH {FUSED_SQL}, h AS (SELECT doc_id AS id, count(DISTINCT p) AS found FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])(license|apache|with|thnd)(?:[^a-z]|$)', 1)) AS p FROM documents) GROUP BY 1)
SELECT qid, id, slot FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY found DESC, position) AS slot FROM fused JOIN h USING (id) WHERE position <= 30) WHERE slot <= 10""",
)
def category_browse(t):
    """Of the first thirty documents of every query those with a category's phrases, the most phrases first."""
    rows = fused_rows(t).select("qid", "id", "position", "pinned")
    texts = t("documents").select(F.col("doc_id").alias("id"), "text")
    return paging.opened(rows, paging.by_phrases(texts, ["license", "apache", "with", "thnd"]), paging.CATEGORY_WINDOW)[0]
