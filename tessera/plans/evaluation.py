"""Queries on evaluation datasets, ingestion reports and small look-ups, with their SQL. Conversations' turns are query strings here,
labels their grades, customers accounts, events ingested files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunks, parse, text
from tessera.operators import datasets, metrics
from tessera.operators.datasets import DISPOSITION, JOURNALS, NUMBERED, ORIGINS, QUERY_TYPES, QUESTION, SPLITS, STATUSES, STATUTE_WORDS
from tessera.plans.catalogue import GRADES_SQL, LISTS_SQL, candidate_lists, grades, query
from tessera.sources.store import Versioned, shared_dir

NORM = r"regexp_replace(regexp_replace(trim(lower(coalesce({}, ''))), '\s+', ' ', 'g'), '[ ?.!]+$', '')"


@query("query_ids", f"SELECT conv_id, turn, 'q-' || substr(sha1({NORM.format('text')}), 1, 10) AS id, {NORM.format('text')} AS norm FROM conversations")
def query_ids(t):
    """Every turn as a query string: its normalised form and the id made of it."""
    return t("conversations").select("conv_id", "turn", datasets.stable_id("q", F.col("text")).alias("id"), datasets.normalised(F.col("text")).alias("norm"))


LISTED = lambda words: ", ".join(f"'{w}'" for w in words)
MADE = """SELECT CASE doc_id % 50 WHEN 0 THEN NULL ELSE 'r' || doc_id END AS id, CASE doc_id % 9 WHEN 1 THEN ' ' ELSE 'q' END AS query, ['issue', 'entity', 'other'][doc_id % 3 + 1] AS query_type, ['legacy', 'negative', 'hand', 'x'][doc_id % 4 + 1] AS origin,
 CASE doc_id % 7 WHEN 0 THEN 'train' ELSE 'dev' END AS split, CASE doc_id % 11 WHEN 0 THEN NULL ELSE 'draft' END AS status, quality AS g, toxic AS h FROM labels"""


@query(
    "dataset_issues",
    f"""WITH r AS ({MADE}), c AS (SELECT *, list_filter([g + 1, CASE WHEN h = 1 THEN 3 END], lambda x: x IS NOT NULL) AS grades FROM r),
 i AS (SELECT list_filter([CASE WHEN id IS NULL THEN 'missing id' END, CASE WHEN status IS NULL THEN 'missing status' END, CASE WHEN query_type NOT IN ({LISTED(QUERY_TYPES)}) THEN 'bad query_type' END, CASE WHEN origin NOT IN ({LISTED(ORIGINS)}) THEN 'bad origin' END, CASE WHEN status NOT IN ({LISTED(STATUSES)}) THEN 'bad status' END,
 CASE WHEN split NOT IN ({LISTED(SPLITS)}) THEN 'bad split' END, CASE WHEN trim(query) = '' THEN 'empty query' END, CASE WHEN list_contains(grades, 3) THEN 'bad grade' END, CASE WHEN len(grades) > 0 AND NOT list_contains(grades, 2) THEN 'no grade 2' END, CASE WHEN origin = 'negative' AND len(grades) > 0 THEN 'relevant negative' END], lambda x: x IS NOT NULL) AS issues FROM c)
 SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM i) GROUP BY 1""",
)
def dataset_issues(t):
    """What is wrong with dataset rows, counted."""
    of = lambda c, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % c + 1).cast("int"))
    relevant = F.when(F.col("toxic") == 1, F.create_map(F.lit("a"), F.col("quality").cast("int") + 1, F.lit("b"), F.lit(3))).otherwise(F.create_map(F.lit("a"), F.col("quality").cast("int") + 1))
    rows = t("labels").select(
        F.expr("case doc_id % 50 when 0 then null else concat('r', doc_id) end").alias("id"), F.expr("case doc_id % 9 when 1 then ' ' else 'q' end").alias("query"), relevant.alias("relevant"), of(3, ("issue", "entity", "other")).alias("query_type"),
        of(4, ("legacy", "negative", "hand", "x")).alias("origin"), F.expr("case doc_id % 7 when 0 then 'train' else 'dev' end").alias("split"), F.expr("case doc_id % 11 when 0 then null else 'draft' end").alias("status"),
    )
    return rows.select(F.explode(datasets.row_issues(rows)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(
    "dataset_sources",
    f"""WITH e AS (SELECT 'user' AS source, 0 AS place, conv_id || '-' || turn AS id, {NORM.format('text')} AS norm FROM conversations WHERE role = 'user' UNION ALL SELECT 'first', 1, conv_id || '-f', {NORM.format("substr(text, 1, 20)")} FROM conversations WHERE turn < 2 UNION ALL SELECT 'item', 2, 'i' || item_id, {NORM.format('text')} FROM benchmark),
 k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY place, id) AS n, first_value(id) OVER (PARTITION BY norm ORDER BY place, id) AS first, first_value(source) OVER (PARTITION BY norm ORDER BY place, id) AS s FROM e) SELECT source, count(*) AS rows, count(*) FILTER (NOT (id = first AND source = s)) AS dropped FROM k GROUP BY 1""",
)
def dataset_sources(t):
    """Rows of three sources, and how many went because an earlier source has the query."""
    turns = t("conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    sources = {
        "user": turns.where("role = 'user'").select(key.alias("id"), F.col("text").alias("query")),
        "first": turns.where("turn < 2").select(F.concat_ws("-", "conv_id", F.lit("f")).alias("id"), F.substring("text", 1, 20).alias("query")),
        "item": t("benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("query")),
    }
    return datasets.collected(sources)[1]


@query(
    "query_type_guesses",
    rf"""WITH q AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'Whether the appeal lies' WHEN 1 THEN '2010 SCMR ' || c_custkey WHEN 2 THEN 'Suit of ' || 'Gul Khan for the land and house' WHEN 3 THEN 'land of the ' || c_mktsegment WHEN 4 THEN 'section 302 of it' WHEN 5 THEN 'his suit for land was dismissed with costs' ELSE 'his suit for land and for the house' END AS q FROM customer),
 l AS (SELECT id, q, ' ' || array_to_string(regexp_extract_all(lower(q), '[a-z0-9]+'), ' ') || ' ' AS low, len(regexp_extract_all(lower(q), '[a-z0-9]+')) AS n FROM q)
 SELECT id, CASE WHEN regexp_matches(low, ' (?:19|20)[0-9][0-9] (?:{"|".join(JOURNALS)}) [0-9]+ ') THEN 'citation' WHEN regexp_matches(low, ' (?:{"|".join(NUMBERED)}) [0-9]+ | (?:{"|".join(STATUTE_WORDS)}) ') THEN 'statute' WHEN regexp_matches(low, '^ (?:{"|".join(QUESTION)}) ') THEN 'issue' WHEN n <= 4 THEN 'vague'
 WHEN regexp_matches(substr(q, 2), '(?:^|[^\p{{L}}])\p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)+') THEN 'entity' WHEN regexp_matches(low, ' (?:{"|".join(DISPOSITION)}) ') THEN 'disposition' ELSE 'paraphrase' END AS type FROM l""",
)
def query_type_guesses(t):
    """A first guess at the type of query strings."""
    said = F.expr("case c_custkey % 7 when 0 then 'Whether the appeal lies' when 1 then concat('2010 SCMR ', c_custkey) when 2 then 'Suit of Gul Khan for the land and house' when 3 then concat('land of the ', c_mktsegment) when 4 then 'section 302 of it' when 5 then 'his suit for land was dismissed with costs' else 'his suit for land and for the house' end")
    rows = t("customer").select(F.col("c_custkey").alias("id"), said.alias("q"), parse.case_numbers_of(said).alias("cases"))
    return rows.select("id", datasets.guessed_type(F.col("q"), F.size("cases") > 0).alias("type"))


@query("prefix_ids", "WITH k AS (SELECT 'd' || md5(doc_id::VARCHAR) AS id FROM documents), a AS (SELECT doc_id, substr('d' || md5(doc_id::VARCHAR), 1, 3 + doc_id % 4) AS expect FROM documents), f AS (SELECT expect, min(id) AS resolved FROM (SELECT DISTINCT expect FROM a) JOIN k ON starts_with(id, expect) GROUP BY 1 HAVING count(*) = 1) SELECT doc_id, expect, resolved FROM a LEFT JOIN f USING (expect)")
def prefix_ids(t):
    """Hand-written beginnings of ids as the one id that begins so."""
    ids = t("documents").select("doc_id", F.concat(F.lit("d"), F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("id"))
    rows = ids.select("doc_id", F.substring(F.col("id"), F.lit(1), (F.col("doc_id") % 4 + 3).cast("int")).alias("expect"))
    return datasets.by_prefix(rows, ids.select("id")).select("doc_id", "expect", "resolved")


RESULTS = "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'scanned' ELSE 'digital' END AS queue, CASE event_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'rejected' ELSE 'done' END AS outcome, event_id % 12 AS pages, round(value, 2) AS total_s, (event_id % 1000)::DOUBLE AS finished_offset_s, CASE WHEN user_id % 3 = 0 THEN round(value / 2, 2) END AS ocr_s FROM events"


@query(
    "ingest_report",
    f"""WITH r AS ({RESULTS}) SELECT queue, grouping(queue) = 1 AS every, count(*) AS processed, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'rejected') AS rejected, coalesce(sum(pages) FILTER (outcome = 'done'), 0)::BIGINT AS pages,
 max(finished_offset_s) FILTER (outcome = 'done') AS makespan_s, round(count(*) FILTER (outcome = 'done') / (max(finished_offset_s) FILTER (outcome = 'done') / 60), 2) AS docs_per_min, round(avg(total_s) FILTER (outcome = 'done'), 2) AS mean_latency_s, round(sum(ocr_s) / sum(pages) FILTER (ocr_s IS NOT NULL), 2) AS ocr_s_per_page FROM r GROUP BY ROLLUP (queue)""",
)
def ingest_report(t):
    """What became of ingested files, by queue and over all."""
    rows = t("events").select(
        F.expr("case when user_id % 3 = 0 then 'scanned' else 'digital' end").alias("queue"), F.expr("case event_id % 8 when 0 then 'failed' when 1 then 'rejected' else 'done' end").alias("outcome"), (F.col("event_id") % 12).alias("pages"),
        F.round("value", 2).alias("total_s"), (F.col("event_id") % 1000).cast("double").alias("finished_offset_s"), F.expr("case when user_id % 3 = 0 then round(value / 2, 2) end").alias("ocr_s"),
    )
    return datasets.ingest_report(rows)


@query(
    "metric_table",
    f"""WITH {LISTS_SQL}, {GRADES_SQL}, rk AS (SELECT qid, id, rank FROM c WHERE source = 'bm25'), mh AS (SELECT gr.qid, rk.rank FROM gr LEFT JOIN rk USING (qid, id) WHERE grade > 0), me AS (SELECT qid, count(*) FILTER (rank <= 5) / count(*)::DOUBLE AS a, count(*) FILTER (rank <= 10) / count(*)::DOUBLE AS b, count(*) FILTER (rank <= 50) / count(*)::DOUBLE AS c FROM mh GROUP BY 1),
 tm AS (SELECT qid, (qid * 37 % 101)::DOUBLE AS t, row_number() OVER (ORDER BY qid * 37 % 101, qid) AS place, count(*) OVER () AS m FROM (SELECT DISTINCT qid FROM rk))
 SELECT count(*) AS n, round(avg(a), 6) AS recall_5, round(avg(b), 6) AS recall_10, round(avg(c), 6) AS recall_50, (SELECT t FROM tm WHERE place = greatest(floor(m * 0.5), 1)) AS p50, (SELECT t FROM tm WHERE place = greatest(floor(m * 0.95), 1)) AS p95 FROM me""",
)
def metric_table(t):
    """Recall at 5, 10 and 50 of the keyword lists, and percentiles of a latency."""
    ranked = candidate_lists(t).where("source = 'bm25'").withColumn("ms", (F.col("qid") * 37 % 101).cast("double"))
    return metrics.metric_table(ranked, grades(t), latency="ms")


@query("label_histograms", "SELECT lang AS \"group\", field, label, count(*) AS n FROM (SELECT lang, unnest(['quality', 'toxic']) AS field, unnest([coalesce(quality::VARCHAR, '-'), coalesce(toxic::VARCHAR, '-')]) AS label FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2, 3")
def label_histograms(t):
    """How often each label occurs, by language; documents without labels count."""
    rows = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return metrics.label_histograms(rows, "lang", ["quality", "toxic"])


def _nodes(t) -> DataFrame:
    """Documents as nodes of judgments: of each ten ids the first is the root, the next six are sections."""
    rows = t("documents").select("doc_id", F.expr("doc_id div 10").alias("judgment"), (F.col("doc_id") % 10).alias("k"), "source", "lang", "text")
    return rows.where("k <= 6")


@query("judgment_context", "WITH n AS (SELECT doc_id, doc_id // 10 AS judgment, doc_id % 10 AS k, source, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <= 6), r AS (SELECT judgment, source AS title FROM n WHERE k = 0) SELECT judgment, title, string_agg('[' || ['FACTS', 'ARGUMENTS', 'ISSUES', 'ANALYSIS', 'ORDER', 'OTHER'][k] || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS context FROM n JOIN r USING (judgment) WHERE k > 0 AND text <> '' GROUP BY 1, 2")
def judgment_context(t):
    """Every judgment's whole context: its sections in order under their headings, with the title of its root."""
    nodes = _nodes(t)
    root = nodes.where("k = 0").select("judgment", F.col("source").alias("title"))
    names = F.array(*[F.lit(s) for s in ("FACTS", "ARGUMENTS", "ISSUES", "ANALYSIS", "ORDER", "OTHER")])
    part = F.struct("k", F.concat(F.lit("["), F.element_at(names, F.col("k").cast("int")), F.lit("]\n"), "text").alias("text"))
    body = nodes.where("k > 0 and coalesce(text, '') <> ''").groupBy("judgment").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return root.join(body, "judgment").select("judgment", "title", F.array_join("parts.text", "\n\n").alias("context"))


@query("corpus_titles", "SELECT r.doc_id // 10 AS judgment, trim(r.source) AS title, coalesce(p.url, '') AS filename FROM documents r LEFT JOIN pages p ON p.page_id = r.doc_id // 10 WHERE r.doc_id % 10 = 0")
def corpus_titles(t):
    """Every judgment that has a root: its title and its file's name, empty where none is known."""
    root = _nodes(t).where("k = 0").select("judgment", F.trim("source").alias("title"))
    files = t("pages").select(F.col("page_id").alias("judgment"), F.col("url").alias("filename"))
    return root.join(files, "judgment", "left").fillna("", ["filename"])


HEADED = "CASE WHEN k = 0 THEN '' ELSE '[' || source || CASE WHEN lang <> 'en' THEN ' | ' || lang ELSE '' END || ']' || chr(10) END"


@query(
    "contextual_chunks",
    f"""WITH n AS (SELECT doc_id AS node, doc_id // 10 AS judgment, doc_id % 10 AS k, source, lang, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <= 6),
 p AS (SELECT node, judgment, k, source, lang, i AS chunk, substr(text, i * 11500 + 1, 12000) AS body FROM n, generate_series(0, 400) g(i) WHERE k > 0 AND length(text) > 0 AND (i = 0 OR length(text) > (i - 1) * 11500 + 12000))
 SELECT node || '::' || chunk AS vector_id, judgment, chunk::BIGINT AS chunk, {HEADED} || body AS text FROM p""",
)
def contextual_chunks(t):
    """The chunks of every judgment's sections behind a header that names the case and the section; roots are left out."""
    nodes = _nodes(t).where("k > 0 and coalesce(text, '') <> ''")
    start = F.expr("sequence(0, case when length(text) <= 12000 then 0 else cast(ceil((length(text) - 12000) / 11500.0) as int) end)")
    parts = nodes.select("doc_id", "judgment", "source", "lang", "text", F.explode(start).alias("chunk"))
    body = F.substring(F.col("text"), F.col("chunk") * 11500 + 1, F.lit(12000))
    header = F.concat(F.lit("["), "source", F.when(F.col("lang") != "en", F.concat(F.lit(" | "), "lang")).otherwise(""), F.lit("]\n"))
    return parts.select(F.concat_ws("::", "doc_id", "chunk").alias("vector_id"), "judgment", "chunk", F.concat(header, body).alias("text"))


@query("vector_sync", "SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS n FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 99, len(embedding) FROM embeddings WHERE vec_id % 3 = 1")
def vector_sync(t):
    """A vector table that is brought to a given set: new and changed vectors are put in, those not in the set go; then it is
    dropped and made again for vectors of another length, and brought back."""
    rows = t("embeddings").select("vec_id", "label", "embedding")
    store = Versioned(rows.sparkSession, shared_dir(rows.sparkSession, "vectors"))
    store.rebuild(rows)
    wanted = rows.where("vec_id % 3 = 0").unionByName(rows.where("vec_id % 3 = 1").withColumn("label", F.lit(99)))
    store.synced(wanted, "vec_id")
    whole = store.read()
    store.reset(whole.withColumn("embedding", F.slice("embedding", 1, 8)))
    if store.read().where(F.size("embedding") > 8).limit(1).count():
        raise ValueError("vectors of the former length are left")
    store.reset(whole)
    return store.read().select("vec_id", "label", F.size("embedding").alias("n"))


@query("accounts_by_email", "WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END || '@x.org' AS email FROM customer), a AS (SELECT DISTINCT c_custkey AS asked, c_name || '@x.org' AS mail FROM customer WHERE c_custkey % 3 > 0) SELECT asked, min(id) AS id FROM a LEFT JOIN u ON email = mail OR email = lower(mail) GROUP BY 1")
def accounts_by_email(t):
    """Accounts by an address as it was typed, or in lower case."""
    users = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.expr("case when c_custkey % 2 = 0 then lower(c_name) else c_name end"), F.lit("@x.org")).alias("email"))
    asked = t("customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("asked"), F.concat("c_name", F.lit("@x.org")).alias("mail"))
    either = asked.select("asked", F.explode(F.array_distinct(F.array("mail", F.lower("mail")))).alias("email"))
    return either.join(users, "email", "left").groupBy("asked").agg(F.min("id").alias("id"))


@query("prunable_copies", "SELECT doc_id, lang IN ('en', 'de') AND coalesce(quality, 0) = 1 AND n_chars > 100 AS prunable FROM documents LEFT JOIN labels USING (doc_id)")
def prunable_copies(t):
    """Whether a document's local copy may go: it is complete and there is a remote copy."""
    rows = t("documents").join(t("labels"), "doc_id", "left")
    complete = F.col("lang").isin("en", "de") & (F.coalesce("quality", F.lit(0)) == 1)
    return rows.select("doc_id", (complete & (F.col("n_chars") > 100)).alias("prunable"))


DATED = "CASE event_id % 5 WHEN 0 THEN strftime(ts, '%d.%m.%Y') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN '31.02.2020' WHEN 3 THEN NULL ELSE 'soon' END"


@query("article_dates", "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN strftime(ts, '%Y-%m-%d') END AS published, event_id % 5 < 2 AS valid FROM events")
def article_dates(t):
    """Dates of articles as dates that sort; null for what is none."""
    said = F.expr("case event_id % 5 when 0 then date_format(ts, 'dd.MM.yyyy') when 1 then date_format(ts, 'yyyy-MM-dd') when 2 then '31.02.2020' when 3 then null else 'soon' end")
    day = text.card_date(said)
    return t("events").select("event_id", day.cast("string").alias("published"), day.isNotNull().alias("valid"))


@query("active_filters", "SELECT c_custkey AS id, (c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS active FROM customer")
def active_filters(t):
    """Whether any filter of a query is set; blanks and "unknown" are none."""
    fields = [F.expr(f"case when c_custkey % {k} = 0 then 'x' when c_custkey % 4 = 1 then ' ' when c_custkey % 4 = 2 then 'unknown' end") for k in (2, 3, 5)]
    return t("customer").select(F.col("c_custkey").alias("id"), F.exists(F.array(*[~text.is_blank(f) for f in fields]), lambda x: F.coalesce(x, F.lit(False))).alias("active"))


@query("one_tree", "SELECT doc_id // 10 AS judgment, min(doc_id) AS tree FROM documents WHERE doc_id % 10 IN (0, 4, 7) GROUP BY 1")
def one_tree(t):
    """One tree a judgment, the first that was made, however often it is made again."""
    trees = t("documents").where("doc_id % 10 in (0, 4, 7)").select(F.expr("doc_id div 10").alias("judgment"), F.col("doc_id").alias("tree"))
    made = trees.groupBy("judgment").agg(F.min("tree").alias("tree"))
    again = made.unionByName(trees).groupBy("judgment").agg(F.min("tree").alias("tree"))
    return again


@query("merged_parses", "WITH p AS (SELECT conv_id, turn, role AS section, text, (turn * 37 % 11) / 10.0::DOUBLE AS confidence FROM conversations) SELECT conv_id, section, string_agg(text, chr(10) ORDER BY turn) AS text, max(confidence) AS confidence, arg_min(substr(text, 1, 20), turn) AS heading FROM p GROUP BY 1, 2")
def merged_parses(t):
    """Parses of a text's parts as one: texts in order, the highest confidence, the first heading of each section."""
    rows = t("conversations").select("conv_id", "turn", F.col("role").alias("section"), "text", ((F.col("turn") * 37 % 11) / 10.0).cast("double").alias("confidence"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "section").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.max("confidence").alias("confidence"), F.min_by(F.substring("text", 1, 20), "turn").alias("heading"))


@query("query_log", "SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"hits\":[' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '{\"id\":' || user_id || ',\"score\":' || (event_id % 7)::VARCHAR || '}' END || ']}' AS line FROM events")
def query_log(t):
    """One slim line of JSON for each search: of its hits the ids and scores alone."""
    hits = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<struct<id:bigint,score:bigint,text:string>>")).otherwise(F.array(F.struct(F.col("user_id").alias("id"), (F.col("event_id") % 7).alias("score"), F.col("props").alias("text"))))
    slim = F.transform(hits, lambda h: F.struct(h["id"].alias("id"), h["score"].alias("score")))
    return t("events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), slim.alias("hits"))).alias("line"))
