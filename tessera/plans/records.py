"""Further queries of the catalogue: names and years in texts, cuts and shuffles of contexts, changes between runs, updates
of list fields. The tables stand for what they do in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parse, text
from tessera.operators.fields import stored
from tessera.operators.postings import PostingIndex
from tessera.plans.catalogue import BM25_SQL, FUSED_SQL, GRADES_SQL, ITEM_DENSE_SQL, LISTS_SQL, OUTCOME, POSITIONS, WORDS, candidate_lists, fused_rows, grades, query, terms_of
from tessera.sources.store import shared_dir
from tessera.streaming import windows

NAMES = r"([A-Z][\w.]*(?: [A-Z][\w.]*){0,4}) (?:v|vs|versus)\.? ([A-Z][\w.]*(?: [A-Z][\w.]*){0,4})"
PAGE_MARKS = r"(?im)^[ \t]*(?:-{2,}[ \t]*)?page[ \t]+[0-9]+(?:[ \t]+of[ \t]+[0-9]+)?(?:[ \t]*-{2,})?[ \t]*$"
TAIL = 1500


@query("explicit_names", f"SELECT doc_id, list_aggregate(regexp_extract_all(coalesce(text, ''), '{NAMES}', 1), 'string_agg', '; ') AS first, list_aggregate(regexp_extract_all(coalesce(text, ''), '{NAMES}', 2), 'string_agg', '; ') AS second FROM documents")
def explicit_names(t):
    """The sides of every "X v. Y" in running text."""
    side = lambda k: F.nullif(F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NAMES), F.lit(k)), "; "), F.lit(""))
    return t("documents").select("doc_id", side(1).alias("first"), side(2).alias("second"))


@query("years_without_statutes", f"SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '{parse.ACT_YEAR}', ' ', 'g'), '(?:19|20)[0-9][0-9]'))), 'string_agg', ',') AS years FROM documents")
def years_without_statutes(t):
    """The years of a text but for those of the acts that it names."""
    years = F.regexp_extract_all(F.regexp_replace(F.coalesce("text", F.lit("")), parse.ACT_YEAR, " "), F.lit("(?:19|20)[0-9][0-9]"), F.lit(0))
    return t("documents").select("doc_id", F.nullif(F.array_join(F.array_sort(F.array_distinct(years)), ","), F.lit("")).alias("years"))


@query("page_marks_removed", f"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '{PAGE_MARKS}', '', 'g')) AS cleaned FROM documents")
def page_marks_removed(t):
    """Texts without lines that only number a page, by their digest."""
    return t("documents").select("doc_id", F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), PAGE_MARKS, "").cast("binary")).alias("cleaned"))


TAIL_OUTCOME = {k: c.replace("coalesce(text, '')", f"right(coalesce(text, ''), {TAIL})") for k, c in OUTCOME.items()}


def _case(conditions: dict[str, str]) -> str:
    return f"CASE WHEN {conditions['allowed']} AND {conditions['dismissed']} AND NOT {conditions['partly allowed']} THEN 'unknown' " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in conditions.items()) + " ELSE 'unknown' END"


@query("outcome_with_tail", f"WITH o AS (SELECT doc_id, {_case(OUTCOME)} AS whole, {_case(TAIL_OUTCOME)} AS tail FROM documents) SELECT doc_id, CASE WHEN whole <> 'unknown' THEN whole ELSE tail END AS outcome, CASE WHEN whole <> 'unknown' THEN 'text' WHEN tail <> 'unknown' THEN 'tail' ELSE 'none' END AS found_in FROM o")
def outcome_with_tail(t):
    """The outcome that a text words; where it words none or contrary ones, that of its end; and which of them it was."""
    c = F.coalesce("text", F.lit(""))
    rows = t("documents").select("doc_id", parse.outcome_of(c).alias("whole"), parse.outcome_of(F.when(F.length(c) > TAIL, F.substring(c, -TAIL, TAIL)).otherwise(c)).alias("tail"))
    where = F.when(F.col("whole") != "unknown", "text").when(F.col("tail") != "unknown", "tail").otherwise("none")
    return rows.select("doc_id", F.when(F.col("whole") != "unknown", F.col("whole")).otherwise(F.col("tail")).alias("outcome"), where.alias("found_in"))


@query("truncate_with_marker", f"WITH w AS (SELECT doc_id, {WORDS} AS a FROM documents) SELECT doc_id, array_to_string(a[1:50], ' ') || CASE WHEN len(a) > 50 THEN ' [truncated]' ELSE '' END AS cut FROM w WHERE len(a) > 0")
def truncate_with_marker(t):
    """The first fifty words, with a marker where more follow."""
    rows = t("documents").select("doc_id", text.tokens(F.col("text")).alias("a")).where(F.size("a") > 0)
    return rows.select("doc_id", F.concat(F.array_join(F.slice("a", 1, 50), " "), F.when(F.size("a") > 50, " [truncated]").otherwise("")).alias("cut"))


@query("budget_split", f"WITH {FUSED_SQL}, sh AS (SELECT qid, id FROM fused WHERE position <= 5), nn AS (SELECT qid, count(*) AS n FROM sh GROUP BY 1) SELECT qid, id, 6000 // n AS budget FROM sh JOIN nn USING (qid)")
def budget_split(t):
    """A budget of tokens, split evenly over the documents shown for a query."""
    shown = fused_rows(t).where("position <= 5").select("qid", "id")
    return shown.join(shown.groupBy("qid").agg(F.count("*").alias("n")), "qid").select("qid", "id", F.expr("6000 div n").alias("budget"))


@query("seeded_shuffle", f"WITH {FUSED_SQL} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || ':' || id)) AS slot FROM fused WHERE position <= 10")
def seeded_shuffle(t):
    """The first ten of each query in an order that depends on the query and the document alone."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy(F.md5(F.concat_ws(":", "qid", "id").cast("binary")))
    return fused_rows(t).where("position <= 10").select("qid", "id", F.row_number().over(order).alias("slot"))


@query("has_more", f"WITH {FUSED_SQL} SELECT qid, count(*) AS n, count(*) > 10 AS more FROM fused GROUP BY 1")
def has_more(t):
    """Whether a query has results beyond its first page."""
    return fused_rows(t).groupBy("qid").agg(F.count("*").alias("n")).withColumn("more", F.col("n") > 10)


@query("baseline_diff", f"WITH {LISTS_SQL}, tops AS (SELECT qid, max(CASE WHEN source = 'bm25' THEN id END) AS before, max(CASE WHEN source = 'dense' THEN id END) AS after FROM c WHERE rank = 1 GROUP BY 1) SELECT qid, before, after FROM tops WHERE before IS DISTINCT FROM after")
def baseline_diff(t):
    """Queries whose first result differs between two runs."""
    top = lambda s: F.max(F.when(F.col("source") == s, F.col("id")))
    return candidate_lists(t).where("rank = 1").groupBy("qid").agg(top("bm25").alias("before"), top("dense").alias("after")).where("not before <=> after")


@query("primary_judgment", f"WITH {ITEM_DENSE_SQL}, {GRADES_SQL} SELECT qid, min(id) AS id FROM gr WHERE grade >= 2 GROUP BY 1")
def primary_judgment(t):
    """The least id among a query's best grades."""
    return grades(t).where("grade >= 2").groupBy("qid").agg(F.min("id").alias("id"))


@query("list_updates", "WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS tags FROM events GROUP BY 1) SELECT user_id, list_aggregate(list_sort(list_distinct(list_concat(list_filter(tags, lambda x: x <> 'error'), ['click', 'seen']))), 'string_agg', ',') AS tags FROM u")
def list_updates(t):
    """A list field after one value is pulled and two are added to the set."""
    tags = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    new = F.array_union(F.array_remove("tags", "error"), F.array(F.lit("click"), F.lit("seen")))
    return tags.select("user_id", F.array_join(F.array_sort(new), ",").alias("tags"))


@query("missing_slugs", r"WITH f AS (SELECT conv_id, arg_min(text, turn) AS title FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, 'chat-' || conv_id || '-' || substr(md5(title), 1, 8) AS slug FROM f WHERE conv_id % 3 > 0")
def missing_slugs(t):
    """Slugs for the conversations that have none (here two of three)."""
    first = t("conversations").where("role = 'user' and conv_id % 3 > 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    return first.select("conv_id", F.concat(F.lit("chat-"), F.col("conv_id").cast("string"), F.lit("-"), F.substring(F.md5(F.col("title").cast("binary")), 1, 8)).alias("slug"))


@query("index_counts", f"WITH w AS (SELECT doc_id AS id, unnest({WORDS}) AS term FROM documents) SELECT count(*) AS postings, count(DISTINCT id) AS documents FROM (SELECT DISTINCT id, term FROM w)")
def index_counts(t):
    """Rows of the stored keyword index and documents with words in it."""
    index = stored(t("documents"), "doc_id", ["text"])
    return index.counts().select("postings").crossJoin(index.documents().where("dl > 0").agg(F.count("*").alias("documents")))


LIVE = "live AS (SELECT doc_id, CASE WHEN lang = 'de' THEN concat('amended ', text) ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'fr')"
AMENDED = "case when lang = 'de' then concat('amended ', coalesce(text, '')) else text end"


def _index(t) -> PostingIndex:
    """The index of all documents after German ones were amended and French ones removed."""
    docs = t("documents")
    index = PostingIndex(docs.sparkSession, shared_dir(docs.sparkSession, "postings"))
    index.upsert(docs, "doc_id", "text")
    index.upsert(docs.where("lang = 'de'").withColumn("text", F.expr(AMENDED)), "doc_id", "text")
    index.remove(docs.where("lang = 'fr'"), "doc_id")
    return index


@query("index_bm25", f"WITH {LIVE}, {BM25_SQL.replace('FROM documents', 'FROM live')} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 5")
def index_bm25(t):
    """The five best documents of every query string, from a stored index after an upsert and a removal."""
    return _index(t).bm25_topk(terms_of(t), 5)


PAIRED = "SELECT a.id, count(*) AS hits FROM p a JOIN p b ON a.id = b.id AND {} WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1"


@query(
    "index_phrase_near",
    f"WITH {LIVE}, {POSITIONS.replace('FROM documents', 'FROM live')}, ph AS ({PAIRED.format('b.pos = a.pos + 1')}), ne AS ({PAIRED.format('abs(a.pos - b.pos) BETWEEN 1 AND 3')}) SELECT id, coalesce(ph.hits, 0) AS phrase, ne.hits AS near FROM ne LEFT JOIN ph USING (id)",
)
def index_phrase_near(t):
    """Where two words stand as a phrase or close together, from a compacted index."""
    index = _index(t)
    index.compact()
    near, phrase = index.near("of", "the", 2).withColumnRenamed("hits", "near"), index.phrase(["of", "the"]).withColumnRenamed("hits", "phrase")
    return near.join(phrase, "id", "left").select("id", F.coalesce("phrase", F.lit(0)).alias("phrase"), "near")


@query("limited_calls")
def limited_calls(t):
    """Purchases as calls of the foreground, other events as background, two slots a half day and user; errors are tried again."""
    rows = t("events").withColumn("background", F.col("event_type") != "purchase").withColumn("again", F.when(F.col("event_type") == "error", 600))
    return windows.limited(rows, "user_id", "ts", "event_id", "background", "again", rate=2, period=43_200, reserve=1, wait=7_200, background_wait=86_400)


@query("event_markers")
def event_markers(t):
    """Each user's event type once in three days, and again after one in ten that fails."""
    rows = t("events").withColumn("mark", F.concat_ws(":", "user_id", "event_type")).withColumn("failed", F.col("event_id") % 10 == 0)
    return windows.marked(rows, "mark", "ts", "event_id", "failed", 3 * 86_400)


@query("replaced_subscriptions", "WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'sub' || event_id % 3 END AS sub, CASE user_id % 7 WHEN 0 THEN NULL ELSE 'sub' || user_id % 3 END AS own FROM events) SELECT event_id, sub, own FROM s WHERE sub <> '' AND own <> '' AND sub <> own")
def replaced_subscriptions(t):
    """Events about a subscription that is no longer the user's."""
    sub = F.expr("case event_id % 5 when 0 then null when 1 then '' else concat('sub', event_id % 3) end")
    own = F.expr("case user_id % 7 when 0 then null else concat('sub', user_id % 3) end")
    return windows.replaced(t("events").select("event_id", sub.alias("sub"), own.alias("own")), "sub", "own")
