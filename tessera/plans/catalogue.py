"""The query catalogue: every operator family on the driver's tables, with SQL beside what SQL can state.

Stand-ins: ``documents`` are the archive (``source`` a subject, ``lang`` a facet), ``benchmark`` the query strings,
``embeddings`` the vectors (``vec_id`` a document's or a chunk's id, ``label`` its group), ``labels`` the grades,
``events`` hits of users, ``conversations`` sessions, customers and suppliers parties, orders cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import cards, chunks, parse, text
from tessera.operators import audit, dense, fusion, gate, lexical, match, metrics, similar, tree
from tessera.operators.fields import stored
from tessera.sources.store import json_lines, kept, table
from tessera.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, floats as double: the types that SQL gives too."""
    kinds = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    return df.select(*[F.col(c).cast(kinds[t]).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(lambda t: table(spark, sf_dir, t)))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
DOC_WORDS = f"w AS (SELECT doc_id AS id, {WORDS} AS words FROM documents)"
TERMS = f"q AS (SELECT DISTINCT item_id AS qid, unnest({WORDS}) AS term FROM benchmark)"
IDF = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END"
BM25_SQL = f"""{DOC_WORDS}, {TERMS},
d AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM w),
tf AS (SELECT id, term, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM d WHERE term IN (SELECT term FROM q) GROUP BY id, term),
f AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT q.qid, tf.id, round(sum({IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM tf JOIN df USING (term) JOIN q USING (term), f GROUP BY 1, 2)"""


def terms_of(t) -> DataFrame:
    return lexical.query_terms(t("benchmark"), "item_id", F.col("text"))


def as_expressions(terms: DataFrame) -> DataFrame:
    """Single words (qid, term) as search expressions."""
    return terms.select("qid", F.lit("term").alias("kind"), F.array("term").alias("parts"))


def bm25_lists(t, k: int) -> DataFrame:
    """The k best documents of every query string: few rows, searched for once however often a plan reads them."""
    return kept(stored(t("documents"), "doc_id", ["text"]).search(as_expressions(terms_of(t)), k), "bm25")


@query("bm25_topk", f"WITH {BM25_SQL} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 5")
def bm25_topk(t):
    """The five best documents of every query string."""
    return bm25_lists(t, 5)


@query(
    "bm25_weighted_columns",
    rf"""WITH {TERMS},
w AS (SELECT doc_id AS id, {WORDS} AS a, regexp_extract_all(lower(source), '[\p{{L}}\p{{N}}]+') AS b, regexp_extract_all(lower(substr(text, 1, 200)), '[\p{{L}}\p{{N}}]+') AS c FROM documents),
x AS (SELECT *, len(a) + len(b) + len(c) AS dl FROM w),
d AS (SELECT id, dl, unnest(a) AS term, 1.0 AS w FROM x UNION ALL SELECT id, dl, unnest(b), 2.0 FROM x UNION ALL SELECT id, dl, unnest(c), 3.0 FROM x),
tf AS (SELECT id, term, sum(w)::DOUBLE AS tf, any_value(dl) AS dl FROM d WHERE term IN (SELECT term FROM q) GROUP BY id, term),
f AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM x), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT q.qid, tf.id, round(sum({IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), f GROUP BY 1, 2)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 5""",
)
def bm25_weighted(t):
    """BM25 over several weighted columns, as on a card."""
    docs = t("documents").withColumn("lead", F.expr("substring(text, 1, 200)"))
    return stored(docs, "doc_id", ["text", "source", "lead"]).search(as_expressions(terms_of(t)), 5, [1.0, 2.0, 3.0])


@query("term_df", f"WITH {DOC_WORDS}, d AS (SELECT DISTINCT id, unnest(words) AS term FROM w) SELECT term, count(*) AS df FROM d GROUP BY term")
def term_df(t):
    return lexical.term_df(t("documents"), "doc_id", F.col("text"))


@query("key_terms", f"WITH {DOC_WORDS}, {TERMS}, d AS (SELECT DISTINCT id, unnest(words) AS term FROM w), df AS (SELECT term, count(*) AS df FROM d GROUP BY term) SELECT qid, term, df FROM q JOIN df USING (term) WHERE df <= 0.2 * (SELECT count(*) FROM documents)")
def key_terms(t):
    return lexical.key_terms(t("documents"), "doc_id", F.col("text"), terms_of(t), 0.2)


@query(
    "salient_terms",
    f"""WITH {DOC_WORDS}, d AS (SELECT DISTINCT id, unnest(words) AS term FROM w), df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
p AS (SELECT item_id AS qid, {WORDS} AS a FROM benchmark), o AS (SELECT qid, unnest(a) AS term, generate_subscripts(a, 1) AS ord FROM p), q AS (SELECT qid, term, min(ord) AS ord FROM o GROUP BY 1, 2)
SELECT qid, term, df FROM (SELECT qid, term, df, row_number() OVER (PARTITION BY qid ORDER BY df, ord) AS rn FROM q JOIN df USING (term)) WHERE rn <= 8""",
)
def salient(t):
    """Each query's eight rarest terms."""
    words = t("benchmark").select(F.col("item_id").alias("qid"), F.posexplode(text.tokens(F.col("text"))).alias("ord", "term")).groupBy("qid", "term").agg(F.min("ord").alias("ord"))
    asked = t("documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).join(words.select("term").distinct(), "term")
    return lexical.salient(words, asked.groupBy("term").agg(F.count("*").alias("df")), 8).select("qid", "term", "df")


@query("docs_with_terms", f"WITH {DOC_WORDS}, {TERMS}, d AS (SELECT DISTINCT id, unnest(words) AS term FROM w), df AS (SELECT term FROM d GROUP BY term HAVING count(*) <= 0.02 * (SELECT count(*) FROM documents)) SELECT qid, id, list_aggregate(list_sort(list(term)), 'string_agg', ' ') AS found FROM d JOIN q USING (term) WHERE term IN (SELECT term FROM df) GROUP BY 1, 2")
def docs_with_terms(t):
    rare = lexical.key_terms(t("documents"), "doc_id", F.col("text"), terms_of(t), 0.02).select("qid", "term")
    return lexical.docs_with_terms(t("documents"), "doc_id", F.col("text"), rare).withColumn("found", F.array_join("found", " "))


POSITIONS = f"{DOC_WORDS}, p AS (SELECT id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM w)"


@query("phrase_match", f"WITH {POSITIONS} SELECT a.id, count(*) AS hits FROM p a JOIN p b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def phrase_match(t):
    return lexical.phrase_match(t("documents"), "doc_id", F.col("text"), ["of", "the"])


@query("near_match", f"WITH {POSITIONS} SELECT a.id, count(*) AS hits FROM p a JOIN p b ON a.id = b.id AND abs(a.pos - b.pos) BETWEEN 1 AND 3 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def near_match(t):
    return lexical.near_match(t("documents"), "doc_id", F.col("text"), "of", "the", 2)


DOT = "round(list_sum(list_transform(generate_series(1, len(v)), lambda i: v[i]::DOUBLE * q[i]::DOUBLE)), 6)"
VECTORS = "e AS (SELECT vec_id AS id, label::BIGINT AS label, embedding AS v FROM embeddings), k AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)"
DENSE_SQL = f"{VECTORS}, s AS (SELECT qid, id, label, {DOT} AS score FROM e, k)"
ITEM_VECTORS = "WHERE vec_id IN (SELECT item_id FROM benchmark)"
ITEM_DENSE_SQL = DENSE_SQL.replace("WHERE vec_id % 100 = 0", ITEM_VECTORS)


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def noded(t) -> DataFrame:
    """The vectors with their node: four ids in a row."""
    return vectors(t).withColumn("node", F.expr("id div 4"))


def asked_vectors(t) -> DataFrame:
    """The vector queries: every vector whose id is divisible by 100."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def item_vectors(t) -> DataFrame:
    """The embedded query strings: the vector of each benchmark item's id stands for it."""
    asked = t("embeddings").join(t("benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id")
    return asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query("dense_topk", f"WITH {DENSE_SQL} SELECT qid, id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def dense_topk(t):
    return dense.topk(asked_vectors(t), vectors(t), 10)


@query(
    "dense_multi_phrasing_max",
    f"WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), k AS (SELECT vec_id // 400 AS qid, vec_id // 100 % 4 AS phrase, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, phrase, id, {DOT} AS score FROM e, k), "
    "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, phrase ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 10), m AS (SELECT qid, id, max(score) AS score FROM a GROUP BY 1, 2) "
    "SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 10",
)
def dense_multi(t):
    phrases = t("embeddings").where("vec_id % 100 = 0").selectExpr("vec_id div 400 as qid", "vec_id div 100 % 4 as phrase", "embedding as q")
    return dense.multi_phrasing(phrases, vectors(t), 10)


@query("group_max_topk", f"WITH {DENSE_SQL}, g AS (SELECT qid, label, max(score) AS score FROM s GROUP BY 1, 2 HAVING max(score) >= 0.2) SELECT qid, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS rank FROM g) WHERE rank <= 3")
def group_max(t):
    return dense.group_max(dense.leading(asked_vectors(t), vectors(t), ["qid"], ["label"], 1), "label", 0.2, 3)


@query("within_group_topk", f"WITH {DENSE_SQL} SELECT qid, id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 2")
def within_group(t):
    return dense.within_group(dense.leading(asked_vectors(t), vectors(t), ["qid"], ["label"], 2), "label", 2)


@query("adaptive_pool", f"WITH {DENSE_SQL} SELECT qid, id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= least(greatest(floor((SELECT count(*) FROM embeddings) * 0.05), 30), 150)")
def adaptive(t):
    return dense.adaptive_topk(asked_vectors(t), vectors(t), 0.05, 30, 150)


@query("facet_argmax", f"WITH {DENSE_SQL} SELECT qid, label, id, score, preferred FROM (SELECT *, id % 2 = 0 AS preferred, row_number() OVER (PARTITION BY qid, label ORDER BY id % 2, score DESC, id) AS rn FROM s) WHERE rn = 1")
def facet_argmax(t):
    """The best chunk of each facet (label), preferring the facet's own sections."""
    rows = dense.leading(asked_vectors(t), vectors(t).withColumn("even", F.col("id") % 2 == 0), ["qid"], ["label", "even"], 1)
    return dense.best_preferred(rows, ["qid", "label"], F.col("even")).select("qid", "label", "id", "score", "preferred")


@query("dedupe_best_per_node", f"WITH {DENSE_SQL} SELECT qid, node, id, score FROM (SELECT *, id // 4 AS node, row_number() OVER (PARTITION BY qid, id // 4 ORDER BY score DESC, id) AS rn FROM s) WHERE rn = 1")
def dedupe_best(t):
    """The best chunk of every node; a node is whole in a part, so that no pair is shuffled."""
    return dense.leading(asked_vectors(t), noded(t), ["qid"], ["node"], 1, whole=True).select("qid", "node", "id", "score")


@query(
    "evidence_select",
    f"""WITH {DENSE_SQL}, r AS (SELECT qid, label AS doc, id // 4 AS node, id, score, id % 5 = 0 AS liked, row_number() OVER (PARTITION BY qid, label, id // 4 ORDER BY score DESC, id) > 1 AS again FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY again, score DESC, id) AS place FROM r),
h AS (SELECT *, bool_or(CASE WHEN place <= 3 THEN liked ELSE NULL END) OVER (PARTITION BY qid, doc) AS has, min(CASE WHEN liked AND place > 3 THEN place END) OVER (PARTITION BY qid, doc) AS bl FROM o),
x AS (SELECT * FROM h WHERE place < 3 OR (place = 3 AND (has OR bl IS NULL)) OR (NOT has AND place = bl))
SELECT qid, doc, node, id, score, row_number() OVER (PARTITION BY qid, doc ORDER BY place) AS slot FROM x""",
)
def evidence(t):
    held = noded(t).withColumnRenamed("label", "doc").withColumn("liked", F.col("id") % 5 == 0)
    rows = dense.leading(asked_vectors(t), held, ["qid"], ["doc"], 3, ["node"], "liked")
    return fusion.select_evidence(rows, 3, F.col("liked"))


LISTS_SQL = f"""{BM25_SQL}, {ITEM_DENSE_SQL},
l AS (SELECT qid, id, 'bm25' AS source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, score FROM bm
 UNION ALL SELECT qid, id, 'dense', row_number() OVER (PARTITION BY qid ORDER BY score DESC, id), score FROM s
 UNION ALL SELECT qid, qid * 3 AS id, 'exact', 1, 1.0 FROM k WHERE qid % 5 = 0),
c AS (SELECT * FROM l WHERE rank <= 50)"""
FUSED_SQL = f"""{LISTS_SQL},
u AS (SELECT qid, id, round(sum(CASE WHEN source <> 'exact' THEN 1.0::DOUBLE / (60 + rank) ELSE 0 END), 9) AS rrf, min(CASE WHEN source <> 'exact' THEN rank END) AS best, count(*) AS n_lists, count(*) FILTER (rank = 1) AS n_first, bool_or(source = 'exact') AS pinned FROM c GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, rrf DESC, best NULLS LAST, id) AS position FROM u)"""


def candidate_lists(t) -> DataFrame:
    bm = bm25_lists(t, 50).select("qid", "id", "rank", "score")
    near = dense.topk(item_vectors(t), vectors(t), 50).select("qid", "id", "rank", "score")
    exact = item_vectors(t).where("qid % 5 = 0").select("qid", (F.col("qid") * 3).alias("id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    return fusion.union_lists(bm25=bm, dense=near, exact=exact)


def fused_rows(t) -> DataFrame:
    return fusion.fuse(fusion.collapse(candidate_lists(t)))


@query("candidate_union", f"WITH {LISTS_SQL} SELECT source, count(*) AS n, count(DISTINCT qid) AS queries, round(sum(score), 4) AS total FROM c GROUP BY 1")
def candidate_union(t):
    return candidate_lists(t).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("queries"), F.round(F.sum("score"), 4).alias("total"))


@query("rrf_fusion", f"WITH {FUSED_SQL} SELECT qid, id, rrf, coalesce(best, 0) AS best, n_lists, n_first, pinned, position FROM fused")
def rrf_fusion(t):
    return fused_rows(t).withColumn("best", F.coalesce("best", F.lit(0)))


@query("rrf_weighted", f"WITH {LISTS_SQL}, u AS (SELECT qid, id, round(sum(CASE source WHEN 'exact' THEN 0 WHEN 'bm25' THEN 2.0::DOUBLE / (60 + rank) ELSE 1.0::DOUBLE / (60 + rank) END), 9) AS rrf, min(CASE WHEN source <> 'exact' THEN rank END) AS best, bool_or(source = 'exact') AS pinned FROM c GROUP BY 1, 2) SELECT qid, id, rrf, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, rrf DESC, best NULLS LAST, id) AS position FROM u")
def rrf_weighted(t):
    return fusion.fuse(fusion.collapse(candidate_lists(t)), {"bm25": 2.0}).select("qid", "id", "rrf", "position")


@query("pinned_first", f"WITH {FUSED_SQL} SELECT qid, id, position FROM fused WHERE pinned")
def pinned_first(t):
    return fused_rows(t).where("pinned").select("qid", "id", "position")


@query("union_control", f"WITH {LISTS_SQL}, u AS (SELECT qid, id, min(CASE WHEN source = 'dense' THEN rank END) AS lead, min(rank) AS best FROM c GROUP BY 1, 2) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN lead IS NOT NULL THEN 0 ELSE 1 END, coalesce(lead, best), id) AS position FROM u")
def union_control(t):
    return fusion.union_control(fusion.collapse(candidate_lists(t)), "dense")


@query("collapse_ranks", f"WITH {DENSE_SQL}, r AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s), m AS (SELECT qid, label, min(rank) AS place FROM r WHERE rank <= 100 GROUP BY 1, 2) SELECT qid, label AS id, 'dense' AS source, row_number() OVER (PARTITION BY qid ORDER BY place, label) AS rank FROM m")
def collapse_ranks(t):
    """A list of chunks as a list of their documents (labels)."""
    rows = dense.topk(asked_vectors(t), vectors(t), 100)
    return fusion.collapse(rows.select("qid", F.col("label").alias("id"), "rank", F.lit("dense").alias("source")))


@query("chunk_rrf", f"WITH {LISTS_SQL} SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS chunk_rrf FROM c WHERE source <> 'exact' GROUP BY 1, 2")
def chunk_rrf(t):
    return fusion.chunk_order(candidate_lists(t).where("source <> 'exact'"))


@query("outcome_vote", f"WITH {FUSED_SQL}, v AS (SELECT f.qid, f.id, f.pinned, f.position AS was, round(f.rrf + CASE WHEN NOT f.pinned AND coalesce(d.lang = 'fr', false) THEN 0.25 / 61 ELSE 0 END, 9) AS rrf FROM fused f LEFT JOIN documents d ON d.doc_id = f.id) SELECT qid, id, rrf, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, CASE WHEN pinned THEN was END, rrf DESC, was) AS position FROM v")
def outcome_vote(t):
    """A soft vote for documents whose facet (lang) is the query's."""
    rows = fused_rows(t).join(t("documents").select(F.col("doc_id").alias("id"), "lang"), "id", "left")
    return fusion.outcome_vote(rows, F.col("lang") == "fr").select("qid", "id", "rrf", "position")


GATE_SQL = f"""{FUSED_SQL}, g AS (SELECT *, round(rrf * 10, 6) AS relevance, CASE WHEN qid % 3 = 0 THEN 0.5 END AS lead FROM fused),
p AS (SELECT *, coalesce(pinned OR relevance >= 0.25 OR (n_first >= 2 AND (relevance >= 0.3 OR lead >= 0.38)), false) AS passes FROM g),
x AS (SELECT *, first_value(passes) OVER (PARTITION BY qid ORDER BY position) AS top_passes FROM p)"""


def gate_rows(t) -> DataFrame:
    return fused_rows(t).withColumn("relevance", F.round(F.col("rrf") * 10, 6)).withColumn("lead", F.when(F.col("qid") % 3 == 0, 0.5))


@query("agreement_gate", f"WITH {GATE_SQL} SELECT qid, id, position, relevance FROM x WHERE pinned OR (top_passes AND (position = 1 OR relevance >= 0.25))")
def agreement_gate(t):
    return gate.agreement_gate(gate_rows(t), floor=0.3, agreement=2).select("qid", "id", "position", "relevance")


@query("lexical_lead", f"WITH {LISTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) AS place FROM c WHERE source <> 'exact'), b AS (SELECT qid, source, max(CASE WHEN place = 1 THEN score END) AS f1, max(CASE WHEN place = 2 THEN score END) AS f2 FROM r GROUP BY 1, 2), a AS (SELECT r.qid, r.id, (score - CASE WHEN place = 1 THEN f2 ELSE f1 END) / score AS ahead FROM r JOIN b USING (qid, source)) SELECT qid, id, CASE WHEN min(ahead) > 0 THEN round(min(ahead), 6) END AS lead FROM a GROUP BY 1, 2")
def lexical_lead(t):
    return gate.lexical_lead(candidate_lists(t).where("source <> 'exact'"))


@query("confidence_labels", f"WITH {GATE_SQL} SELECT qid, id, CASE WHEN position = 1 AND relevance >= 0.3 THEN 'high' WHEN relevance >= 0.25 THEN 'medium' ELSE 'related' END AS label, CASE WHEN relevance >= 0.25 THEN 'medium' ELSE 'related' END AS capped FROM x WHERE position <= 10 AND NOT pinned")
def confidence_labels(t):
    label = gate.confidence(F.col("relevance"), F.col("position"), high=0.3)
    return gate_rows(t).where("position <= 10 and not pinned").select("qid", "id", label.alias("label"), gate.capped(label, "medium").alias("capped"))


@query("rerank_append_rest", f"WITH {FUSED_SQL}, lg AS (SELECT qid, id, position AS was, ((id * 37) % 101) / 10.0::DOUBLE AS logit FROM fused) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN was <= 10 THEN 0 ELSE 1 END, CASE WHEN was <= 10 THEN -logit END, was) AS position FROM lg")
def rerank(t):
    return gate.rerank(fused_rows(t).withColumn("logit", (F.col("id") * 37 % 101) / 10.0), 10).select("qid", "id", "position")


@query("page_slice", f"WITH {FUSED_SQL}, s2 AS (SELECT qid, id, position FROM fused WHERE NOT (position <= 10)) SELECT qid, id, position, slot FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position) AS slot FROM s2) WHERE slot <= 10")
def page_slice(t):
    rows = kept(fused_rows(t).select("qid", "id", "position"), "fused")  # read twice below, searched once
    return gate.page(rows, rows.where("position <= 10"))


@query("filtered_page", f"WITH {FUSED_SQL} SELECT qid, id, position, slot FROM (SELECT qid, id, position, row_number() OVER (PARTITION BY qid ORDER BY position) AS slot FROM fused WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500)) WHERE slot <= 10")
def filtered_page(t):
    allowed = t("documents").where("lang = 'en' and n_chars >= 500").select(F.col("doc_id").alias("id"))
    return gate.filtered_page(fused_rows(t).select("qid", "id", "position"), allowed)


@query("tail_pass", f"WITH {GATE_SQL} SELECT qid, id, position, bool_or(relevance >= 0.2) OVER (PARTITION BY qid ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tail_pass FROM x")
def tail_pass(t):
    return gate.tail_pass(gate_rows(t), F.col("relevance") >= 0.2).select("qid", "id", "position", "tail_pass")


@query(
    "key_term_requirement",
    f"""WITH {FUSED_SQL}, dd AS (SELECT DISTINCT id, unnest(words) AS term FROM w), kt AS (SELECT term FROM dd GROUP BY term HAVING count(*) <= 0.2 * (SELECT count(*) FROM documents)),
kq AS (SELECT qid, term FROM q WHERE term IN (SELECT term FROM kt)), nt AS (SELECT qid, count(*) AS n FROM kq GROUP BY 1), h AS (SELECT qid, id, count(*) AS k FROM dd JOIN kq USING (term) GROUP BY 1, 2)
SELECT fused.qid, fused.id, position FROM fused LEFT JOIN nt USING (qid) LEFT JOIN h ON h.qid = fused.qid AND h.id = fused.id
WHERE pinned OR coalesce(k, 0) >= coalesce(CASE WHEN n <= 2 THEN n ELSE ceil(0.5 * n) END, 0)""",
)
def key_term_requirement(t):
    terms = lexical.key_terms(t("documents"), "doc_id", F.col("text"), terms_of(t), 0.2)
    found = lexical.docs_with_terms(t("documents"), "doc_id", F.col("text"), terms.select("qid", "term"))
    return gate.with_key_terms(fused_rows(t), found, terms.groupBy("qid").agg(F.count("*").alias("n_terms"))).select("qid", "id", "position")


@query(
    "party_match_idf",
    r"""WITH nm AS (SELECT DISTINCT p_partkey AS id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\p{L}\p{N}]+')) AS term FROM part), names AS (SELECT * FROM nm WHERE length(term) > 1 AND NOT regexp_matches(term, '[0-9]') AND term NOT IN ('brand')),
qs AS (SELECT qid, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) AS term FROM (SELECT min(p_partkey) AS qid, p_name || ' ' || p_type || ' plated' AS name FROM part GROUP BY 2)),
q AS (SELECT DISTINCT * FROM qs WHERE NOT regexp_matches(term, '[0-9]')),
idf AS (SELECT term, ln(1 + (SELECT count(DISTINCT id) FROM names) / count(DISTINCT id)::DOUBLE) AS idf FROM names GROUP BY term),
whole AS (SELECT id, sum(idf) AS whole FROM names JOIN idf USING (term) GROUP BY 1), asked AS (SELECT qid, sum(coalesce(idf, 1.0)) AS asked FROM q LEFT JOIN idf USING (term) GROUP BY 1),
hit AS (SELECT qid, id, sum(idf) AS hit, count(*) AS n FROM names JOIN idf USING (term) JOIN q USING (term) GROUP BY 1, 2)
SELECT qid, id, round(0.5 + 0.4 * (hit / whole) * (hit / asked), 6) AS score FROM hit JOIN whole USING (id) JOIN asked USING (qid) WHERE n >= 2 AND hit / whole >= 0.6 AND hit / asked >= 0.6""",
)
def party_match(t):
    """Parts stand for parties; every distinct name, with a word that few have, asks."""
    names = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    asked = t("part").groupBy(F.concat_ws(" ", "p_name", "p_type", F.lit("plated")).alias("name")).agg(F.min("p_partkey").alias("qid"))
    words = asked.select("qid", F.explode(F.filter(F.array_distinct(text.tokens(F.col("name"))), lambda w: ~w.rlike("[0-9]"))).alias("term"))
    return match.party_match(match.name_tokens(names, ["brand"]), words)


@query("case_key_lookup", "WITH k AS (SELECT o_orderkey AS id, upper(substr(o_orderpriority, 3, 1)) || '-' || o_orderkey || '-' || year(o_orderdate) AS key FROM orders), q AS (SELECT o_custkey AS qid, upper(substr(o_orderpriority, 3, 1)) || '-' || o_orderkey || '-' || year(o_orderdate) AS key FROM orders) SELECT DISTINCT qid, id, key FROM k JOIN q USING (key)")
def case_key_lookup(t):
    key = text.canonical_key(F.substring("o_orderpriority", 3, 1), F.col("o_orderkey"), F.year("o_orderdate"))
    docs = t("orders").select(F.col("o_orderkey").alias("id"), F.array(key).alias("keys"))
    return match.key_lookup(docs, t("orders").select(F.col("o_custkey").alias("qid"), key.alias("key")))


@query("result_filter", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND n_chars >= 500 AND contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'tion') AND contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'the')")
def result_filter(t):
    docs = t("documents")
    passes = match.result_filter(outcome="en", words="tion the", after=500, outcome_column=F.col("lang"), bench=F.array("source"), date=F.col("n_chars"), haystack=F.col("text"))
    return docs.where(passes).select("doc_id", "lang", "source")


@query("judge_filter", "SELECT c_custkey FROM customer WHERE contains(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 'customer') AND contains(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), '0001')")
def judge_filter(t):
    passes = match.result_filter(judge="Justice Customer 0001", outcome_column=F.lit(""), bench=F.array("c_name"), date=F.lit(None).cast("date"), haystack=F.lit(""))
    return t("customer").where(passes).select("c_custkey")


@query("date_range_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'")
def date_range(t):
    passes = match.result_filter(after="1995-01-01", before="1995-12-31", outcome_column=F.lit(""), bench=F.array(F.lit("")), date=F.col("o_orderdate"), haystack=F.lit(""))
    return t("orders").where(passes).select("o_orderkey", "o_orderdate")


VISIBLE = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS status FROM events"


@query("null_safe_visibility", f"SELECT event_id, status FROM ({VISIBLE}) WHERE status IS DISTINCT FROM 'click'")
def null_safe(t):
    rows = t("events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("status"))
    return rows.where(match.not_value(F.col("status"), "click"))


@query("missing_field_scan", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 OR o_orderpriority IN ('', 'unknown') GROUP BY 1")
def missing_scan(t):
    rows = t("orders").withColumn("field", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    return rows.where(text.is_blank(F.col("field"))).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("expired_subscriptions", "SELECT user_id, event_id FROM events WHERE regexp_matches(event_type, '(?i)^(purchase|view|click)$') AND (value > 50 OR user_id % 7 = 0) AND ts < TIMESTAMP '2024-01-10'")
def expired(t):
    return t("events").where(F.col("event_type").rlike("(?i)^(purchase|view|click)$") & ((F.col("value") > 50) | (F.col("user_id") % 7 == 0)) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))).select("user_id", "event_id")


@query("fetch_by_ids", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT DISTINCT vec_id * 3 FROM embeddings)")
def fetch_by_ids(t):
    ids = t("embeddings").select((F.col("vec_id") * 3).alias("doc_id"))
    return match.keep_known(t("documents"), ids, "doc_id").select("doc_id", "lang", "n_chars")


@query("clean_query", r"SELECT item_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^a-zA-Z0-9 \-.,?/()§]', '', 'g'), ' +', ' ', 'g'))) AS cleaned FROM benchmark")
def clean_query(t):
    return t("benchmark").select("item_id", text.clean_query(F.col("text")).alias("cleaned"))


@query("intent", "SELECT doc_id, CASE WHEN contains(lower(text), 'appeal') THEN 'appeal' WHEN contains(lower(text), 'tion') THEN 'petition' ELSE 'other' END AS kind, len(list_filter(list_transform(regexp_extract_all(text, '[0-9]{4}'), lambda x: x::INT), lambda y: y BETWEEN 1947 AND 2026)) AS n_years FROM documents")
def intent(t):
    low = F.lower("text")
    years = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[0-9]{4}"), F.lit(0)), lambda x: x.cast("int")), lambda y: y.between(1947, 2026))
    kind = F.when(F.contains(low, F.lit("appeal")), "appeal").when(F.contains(low, F.lit("tion")), "petition").otherwise("other")
    return t("documents").select("doc_id", kind.alias("kind"), F.size(years).alias("n_years"))


@query("category_ground", "WITH h AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])(license|apache|the|and)(?:[^a-z]|$)', 1)) AS p FROM documents) SELECT doc_id, count(DISTINCT p) AS hits FROM h GROUP BY 1")
def category_ground(t):
    hits = text.phrase_hits(F.col("text"), ["the", "and", "apache", "license"])
    return t("documents").select("doc_id", F.size(hits).alias("hits")).where("hits > 0")


@query("slugify", r"SELECT item_id, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50), '-+$', '') AS slug FROM benchmark")
def slugify(t):
    return t("benchmark").select("item_id", text.slugify(F.col("text")).alias("slug"))


@query("title_from_first_user", r"WITH f AS (SELECT conv_id, arg_min(text, turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1), o AS (SELECT conv_id, trim(regexp_replace(first, '\s+', ' ', 'g')) AS one FROM f) SELECT conv_id, CASE WHEN length(one) <= 60 THEN one ELSE regexp_replace(substr(one, 1, 60), ' [^ ]*$', '') || '…' END AS title FROM o")
def titles(t):
    first = t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return first.select("conv_id", text.title_of(F.col("first")).alias("title"))


@query("canonical_key", "SELECT o_orderkey, upper(o_orderstatus) || '-' || o_orderkey || '-' || year(o_orderdate) AS key FROM orders")
def canonical_key(t):
    return t("orders").select("o_orderkey", text.canonical_key(F.col("o_orderstatus"), F.col("o_orderkey"), F.year("o_orderdate")).alias("key"))


@query("hash_split", "SELECT doc_id, CASE WHEN ('0x' || substr(sha256('v1:' || doc_id), 1, 8))::BIGINT % 100 < 40 THEN 'test' ELSE 'dev' END AS split FROM documents")
def hash_split(t):
    return t("documents").select("doc_id", text.hash_split(F.col("doc_id").cast("string"), "v1").alias("split"))


@query("script_detect", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'arabic' WHEN regexp_matches(text, '[\x{00C0}-\x{024F}]') THEN 'accented' ELSE 'plain' END AS script FROM documents")
def script_detect(t):
    return t("documents").select("doc_id", text.script(F.col("text")).alias("script"))


@query("char_window_chunks", "SELECT doc_id AS id, c AS chunk, substr(text, c * 900 + 1, 1000) AS text FROM documents, LATERAL (SELECT unnest(generate_series(0, (length(text) - 1) // 900)) AS c) WHERE length(text) > 0")
def char_windows(t):
    return tree.char_windows(t("documents"), "doc_id", "text", 1000, 100)


@query("token_budget_chunks")
def token_budget(t):
    return chunks.chunk_rows(t("documents"), "doc_id", "text")


@query(
    "chunk_sentences",
    rf"""WITH m AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '{chunks.KEPT_STOP}', '\1\2' || chr(1), 'g') AS t FROM documents),
p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '{chunks.LAST_STOP.replace("'", "''")}', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(replace(x, chr(1), '.'), ' ' || chr(9) || chr(13))), lambda x: x <> '') AS a FROM m)
SELECT id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS position FROM p""",
)
def chunk_sentences(t):
    return chunks.sentence_rows(t("documents"), "doc_id", "text")


@query("case_numbers")
def case_numbers(t):
    return t("documents").select("doc_id", parse.case_numbers_of(F.col("text")).alias("keys"))


@query("statutes")
def statutes(t):
    return t("documents").select("doc_id", parse.statutes_of(F.col("text")).alias("statutes"))


@query(
    "citations",
    rf"""WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{parse.CITATION}'), lambda x: replace(replace(regexp_replace(x, '\s+', ' ', 'g'), 'PCr.LJ', 'PCrLJ'), 'Supreme Court', 'SC')) AS a FROM documents)
SELECT doc_id, list_aggregate(list_sort(list_distinct(a)), 'string_agg', '; ') AS citations FROM c""",
)
def citations(t):
    found = F.array_join(F.array_sort(parse.citations_of(F.col("text"))), "; ")
    return t("documents").select("doc_id", F.nullif(found, F.lit("")).alias("citations"))


OUTCOME = {k: rf"regexp_matches(coalesce(text, ''), '(?i)\b(?:{p})\b')" for k, p in parse.OUTCOMES.items()}


@query("outcome_classify", f"SELECT doc_id, CASE WHEN {OUTCOME['allowed']} AND {OUTCOME['dismissed']} AND NOT {OUTCOME['partly allowed']} THEN 'unknown' " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in OUTCOME.items()) + " ELSE 'unknown' END AS outcome FROM documents")
def outcome_classify(t):
    return t("documents").select("doc_id", parse.outcome_of(F.col("text")).alias("outcome"))


MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in parse.MONTHS) + "]"


@query(
    "decision_date",
    rf"""WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{parse.DATE}'), lambda x: regexp_split_to_array(regexp_replace(replace(lower(x), ',', ''), '([0-9])(?:st|nd|rd|th)', '\1'), '[./\s-]+')) AS a FROM documents),
d AS (SELECT doc_id, list_filter(list_transform(a, lambda p: try_cast(CASE WHEN length(p[3]) = 2 THEN CASE WHEN p[3]::INT < 50 THEN '20' ELSE '19' END ELSE '' END || p[3] || '-' || CASE WHEN regexp_matches(p[2], '^[0-9]') THEN p[2] ELSE list_position({MONTH_LIST}, p[2])::VARCHAR END || '-' || p[1] AS DATE)), lambda y: y IS NOT NULL) AS a FROM c)
SELECT doc_id, strftime(a[1], '%d.%m.%Y') AS date FROM d""",
)
def decision_date(t):
    return t("documents").select("doc_id", parse.first_date_of(F.col("text")).alias("date"))


@query("spelling")
def spelling(t):
    return t("documents").select("doc_id", parse.spelling_of(F.col("text")).alias("text"))


DOCS_SPLIT = "SELECT doc_id AS doc, ['FACTS', 'ISSUES', 'ORDER'][(doc_id % 3 + 1)::INT] AS section, text FROM documents UNION ALL SELECT doc_id, 'HEADER', source FROM documents"
LABELS = ["HEADER", "FACTS", "ISSUES", "ORDER"]
TREE_SQL = f"WITH s AS ({DOCS_SPLIT}), d AS (SELECT DISTINCT doc FROM s), l AS (SELECT unnest(['HEADER', 'FACTS', 'ISSUES', 'ORDER']) AS section, unnest([0, 1, 2, 3]) AS position), n AS (SELECT d.doc, l.section, l.position, coalesce(s.text, '') AS text, sha1(d.doc || '|' || l.section) AS node_id FROM d CROSS JOIN l LEFT JOIN s ON s.doc = d.doc AND s.section = l.section)"


def sections(t) -> DataFrame:
    docs = t("documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in LABELS[1:]]), (F.col("doc_id") % 3 + 1).cast("int"))
    body = docs.select(F.col("doc_id").alias("doc"), kind.alias("section"), "text")
    return body.unionByName(docs.select(F.col("doc_id").alias("doc"), F.lit("HEADER").alias("section"), F.col("source").alias("text")))


@query("tree_build", f"{TREE_SQL} SELECT doc, section, position::BIGINT AS position, text, node_id, sha1(doc || '|ROOT') AS parent_id FROM n")
def tree_build(t):
    return tree.build(sections(t), LABELS)[1]


@query("siblings_in_order", f"{TREE_SQL} SELECT sha1(doc || '|ROOT') AS parent_id, position::BIGINT AS position, node_id, section FROM n")
def siblings_in_order(t):
    parents, nodes = tree.build(sections(t), LABELS)
    return tree.siblings(parents, nodes.select("node_id", "section")).select("parent_id", "position", "node_id", "section")


@query("context_expand", f"{TREE_SQL}, r AS (SELECT doc AS qid, doc, node_id FROM n WHERE section = 'FACTS') SELECT r.qid, n.doc, n.node_id, n.section, n.text, n.node_id = r.node_id AS retrieved FROM r JOIN n ON n.doc = r.doc")
def context_expand(t):
    _, nodes = tree.build(sections(t), LABELS)
    asked = nodes.where("section = 'FACTS'").select(F.col("doc").alias("qid"), "doc", "node_id")
    return tree.expand(asked, nodes)


@query(
    "context_trim",
    rf"""{TREE_SQL}, r AS (SELECT doc AS qid, doc, node_id FROM n WHERE section = 'FACTS'), x AS (SELECT r.qid, n.doc, n.section, n.position, n.node_id, n.text, n.node_id = r.node_id AS retrieved, len(regexp_extract_all(n.text, '[^\s]+')) AS cost FROM r JOIN n ON n.doc = r.doc WHERE length(n.text) > 0),
u AS (SELECT *, sum(cost) OVER (PARTITION BY qid, doc ORDER BY retrieved DESC, position, node_id ROWS UNBOUNDED PRECEDING) AS used FROM x)
SELECT qid, doc, string_agg('## ' || section || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context, sum(cost)::BIGINT AS n_tokens FROM u WHERE used <= 400 GROUP BY 1, 2""",
)
def context_trim(t):
    _, nodes = tree.build(sections(t), LABELS)
    asked = nodes.where("section = 'FACTS'").select(F.col("doc").alias("qid"), "doc", "node_id")
    return tree.assemble(tree.expand(asked, nodes), LABELS, 400)


AUDIT_SQL = "WITH v AS (SELECT vec_id AS id, count(*) AS n FROM embeddings GROUP BY 1), l AS (SELECT doc_id AS id, count(*) AS n FROM labels GROUP BY 1), p AS (SELECT page_id AS id, count(*) AS n FROM pages GROUP BY 1), a AS (SELECT doc_id AS id, coalesce(v.n, 0) AS n_vectors, coalesce(l.n, 0) AS n_cards, coalesce(p.n, 0) AS n_pages FROM documents d LEFT JOIN v ON v.id = d.doc_id LEFT JOIN l ON l.id = d.doc_id LEFT JOIN p ON p.id = d.doc_id), s AS (SELECT *, CASE WHEN n_vectors > 0 AND n_cards > 0 AND n_pages > 0 THEN 'complete' WHEN n_vectors > 0 AND n_cards > 0 THEN 'searchable' ELSE 'partial' END AS status, concat_ws(',', CASE WHEN n_vectors = 0 THEN 'vectors' END, CASE WHEN n_cards = 0 THEN 'cards' END, CASE WHEN n_pages = 0 THEN 'pages' END) AS gaps FROM a)"


def stores(t) -> dict[str, DataFrame]:
    return {"vectors": t("embeddings").select(F.col("vec_id").alias("id")), "cards": t("labels").select(F.col("doc_id").alias("id")), "pages": t("pages").select(F.col("page_id").alias("id"))}


def audited(t) -> DataFrame:
    return audit.store_audit(t("documents").select(F.col("doc_id").alias("id")), stores(t), ["vectors", "cards"])


@query("store_audit", f"{AUDIT_SQL} SELECT * FROM s")
def store_audit(t):
    return audited(t)


@query("audit_rollup", f"{AUDIT_SQL} SELECT status, gaps, count(*) AS n FROM s GROUP BY 1, 2")
def audit_rollup(t):
    return audited(t).groupBy("status", "gaps").agg(F.count("*").alias("n"))


@query("orphans", "SELECT 'vectors' AS store, vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0) UNION SELECT 'cards', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0)")
def orphans(t):
    docs = t("documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"))
    return audit.orphans(docs, {k: v for k, v in stores(t).items() if k != "pages"})


@query("triage_classify", "WITH f AS (SELECT doc_id AS id, md5(text) AS hash, n_chars >= 50 AS valid FROM documents), k AS (SELECT DISTINCT hash FROM f WHERE id % 11 = 0) SELECT id, hash, CASE WHEN NOT valid THEN 'invalid' WHEN hash IN (SELECT hash FROM k) THEN 'known' WHEN min(id) OVER (PARTITION BY hash) <> id THEN 'duplicate' ELSE 'new' END AS category FROM f")
def triage(t):
    files = t("documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("hash"), (F.col("n_chars") >= 50).alias("valid"))
    return audit.triage(files, files.where("id % 11 = 0").select("hash"))


@query("status_histogram", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def status_histogram(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("histogram_multi_key", "SELECT 'o_orderstatus' AS key, o_orderstatus AS value, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2")
def histogram_multi(t):
    return audit.histogram(t("orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice")).withColumn("total", F.round("total", 2))


@query("year_range", "WITH y AS (SELECT list_extract(regexp_extract_all(o_orderkey || ' of ' || year(o_orderdate), '(?:19|20)[0-9]{2}'), -1)::INT AS y FROM orders) SELECT min(y)::BIGINT AS first_year, max(y)::BIGINT AS last_year FROM y WHERE y <= 2026")
def year_range(t):
    return audit.year_range(t("orders"), F.concat_ws(" of ", "o_orderkey", F.year("o_orderdate")), 2026)


@query("next_id", "SELECT coalesce(max(try_cast(split_part(s_name, '#', 2) AS BIGINT)) + 1, 1001) AS next_id FROM supplier")
def next_id(t):
    return audit.next_id(t("supplier"), "s_name")


@query(
    "stage_stats",
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN value END) AS p50, max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END) AS p95, max(value) AS most FROM r GROUP BY 1",
)
def stage_stats(t):
    return audit.stage_stats(t("events"), "event_type", "value")


GRADES_SQL = "gr AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS qid, doc_id AS id, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS grade FROM labels WHERE quality = 1)"
METRICS_SQL = f"""WITH {ITEM_DENSE_SQL}, {GRADES_SQL}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s),
h AS (SELECT gr.qid, grade, CASE WHEN rank <= 100 THEN rank END AS rank, row_number() OVER (PARTITION BY gr.qid ORDER BY grade DESC, gr.id) AS ideal FROM gr LEFT JOIN r ON r.qid = gr.qid AND r.id = gr.id),
sc AS (SELECT qid, coalesce(max((rank = 1)::INT), 0)::BIGINT AS p1, coalesce(max((rank <= 3)::INT), 0)::BIGINT AS p3, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr, round(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS recall,
 round(sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END), 6) AS ndcg FROM h GROUP BY 1)"""


def grades(t) -> DataFrame:
    return t("labels").where("quality = 1").selectExpr(f"doc_id % {t('benchmark').count()} as qid", "doc_id as id", "case when toxic = 1 then 2 else 1 end as grade")


def query_scores(t) -> DataFrame:
    return metrics.score_queries(dense.topk(item_vectors(t), vectors(t), 100).select("qid", "id", "rank"), grades(t))


@query("score_queries", f"{METRICS_SQL} SELECT qid, p1, p3, rr, recall, ndcg FROM sc")
def score_queries(t):
    return query_scores(t)


@query(
    "metric_summary",
    f"{METRICS_SQL}, m AS (SELECT count(*) AS n, sum(p1)::BIGINT AS hits, round(avg(p1), 6) AS p1, round(avg(p3), 6) AS p3, round(avg(rr), 6) AS rr, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM sc), w AS (SELECT *, hits::DOUBLE / n AS p, 1.96::DOUBLE AS z FROM m) SELECT n, hits, p1, p3, rr, recall, ndcg, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS p1_low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS p1_high FROM w",
)
def metric_summary(t):
    return metrics.summary(query_scores(t))


@query("findability", f"{METRICS_SQL}, fa AS (SELECT qid // 4 AS target, sum(p3) AS hits, count(*) AS n FROM sc GROUP BY 1) SELECT count(*) AS targets, count(*) FILTER (hits >= 1) AS one, count(*) FILTER (hits >= 2) AS two, count(*) FILTER (2 * hits > n) AS most, count(*) FILTER (hits = n) AS every FROM fa")
def findability(t):
    rows = query_scores(t).select(F.expr("qid div 4").alias("target"), F.col("p3").alias("p1"))
    return metrics.findability(rows, "target")


@query("abstention", f"WITH {FUSED_SQL}, sh AS (SELECT DISTINCT qid FROM fused WHERE rrf >= 0.028), qq AS (SELECT item_id AS qid, item_id % 3 > 0 AS has_answer FROM benchmark) SELECT count(*) FILTER (has_answer AND sh.qid IS NULL) AS false_refusals, count(*) FILTER (NOT has_answer AND sh.qid IS NULL) AS abstained, count(*) FILTER (NOT has_answer) AS negatives, count(*) AS n FROM qq LEFT JOIN sh ON sh.qid = qq.qid")
def abstention(t):
    return metrics.abstention(fused_rows(t).where("rrf >= 0.028"), t("benchmark").selectExpr("item_id as qid", "item_id % 3 > 0 as has_answer"))


@query("ablation_delta", "WITH f AS (SELECT event_type AS metric, round(avg(value), 6) AS base FROM events GROUP BY 1), v AS (SELECT event_type AS metric, user_id % 3 AS variant, round(avg(value), 6) AS value FROM events GROUP BY 1, 2) SELECT metric, variant, value, base, round(value - base, 6) AS delta FROM v JOIN f USING (metric)")
def ablation(t):
    full = t("events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    each = t("events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("variant")).agg(F.round(F.avg("value"), 6).alias("value"))
    return metrics.ablation(full, each)


@query("crosstab", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es, count(*) AS total FROM documents GROUP BY 1")
def crosstab(t):
    return metrics.crosstab(t("documents"), "source", "lang", ["en", "fr", "de", "es"])


@query("bootstrap_ci")
def bootstrap(t):
    return metrics.bootstrap(query_scores(t), "rr")


def _grams(n: int, source: str, key: str) -> str:
    return f"SELECT DISTINCT {key} AS id, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] || ' ' || a[i + 3] AS g FROM (SELECT {key}, {WORDS} AS a FROM {source}) z, LATERAL (SELECT unnest(generate_series(1, len(a) - {n - 1})) AS i)"


@query("ngram_leak", f"WITH d AS ({_grams(4, 'documents', 'doc_id')}), b AS ({_grams(4, 'benchmark', 'item_id')}) SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY 1, 2")
def ngram_leak(t):
    """Four-word runs that documents share with query strings."""
    grams = lambda df, key: df.select(F.col(key), F.explode(F.array_distinct(text.ngrams(text.tokens(F.col("text")), 4))).alias("g"))
    return grams(t("documents"), "doc_id").join(grams(t("benchmark"), "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query(
    "grounded_span",
    f"""WITH p AS (SELECT item_id, {WORDS} AS raw FROM benchmark), s AS (SELECT item_id, raw, list_concat(raw[3:10], CASE WHEN item_id % 2 = 0 THEN ['zzz'] ELSE [] END) AS span FROM p),
g AS (SELECT item_id, raw, span, list_transform(generate_series(1, len(span) - 2), lambda i: span[i] || ' ' || span[i + 1] || ' ' || span[i + 2]) AS sg, list_transform(generate_series(1, len(raw) - 2), lambda i: raw[i] || ' ' || raw[i + 1] || ' ' || raw[i + 2]) AS rg FROM s)
SELECT item_id, contains(' ' || array_to_string(raw, ' ') || ' ', ' ' || array_to_string(span, ' ') || ' ') OR len(list_filter(sg, lambda x: list_contains(rg, x))) >= 0.85 * len(sg) AS grounded FROM g""",
)
def grounded_span(t):
    rows = t("benchmark").select("item_id", text.tokens(F.col("text")).alias("raw"))
    span = F.concat(F.slice("raw", 3, 8), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("zzz"))).otherwise(F.array().cast("array<string>")))
    return rows.select("item_id", text.grounded(span, F.col("raw")).alias("grounded"))


@query("text_dedupe_first_wins", r"WITH n AS (SELECT doc_id, source, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS norm FROM documents) SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY source, doc_id) AS rn FROM n) WHERE rn = 1")
def text_dedupe(t):
    norm = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    return audit.dedupe_first(t("documents"), F.sha2(norm, 256), ["source", "doc_id"]).select("doc_id", "source")


@query(
    "stratified_sample",
    """WITH sz AS (SELECT source AS s, count(*) AS size, 100 * count(*)::DOUBLE / (SELECT count(*) FROM documents) AS exact FROM documents GROUP BY 1), q0 AS (SELECT s, size, greatest(1, floor(exact))::BIGINT AS q, exact - floor(exact) AS rest FROM sz), tt AS (SELECT sum(q) AS dealt FROM q0),
un AS (SELECT s, row_number() OVER (ORDER BY u DESC, s) AS k FROM (SELECT s, unnest(generate_series(1, q)) AS u FROM q0)), ls AS (SELECT s, count(*) AS n FROM un, tt WHERE k <= dealt - 100 GROUP BY 1), mo AS (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY rest DESC, s) AS k FROM q0), tt WHERE k <= 100 - dealt),
qu AS (SELECT s, q - coalesce(ls.n, 0) + CASE WHEN mo.s IS NULL THEN 0 ELSE 1 END AS quota FROM q0 LEFT JOIN ls USING (s) LEFT JOIN mo USING (s)), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, source FROM r JOIN qu ON s = source WHERE rn <= quota""",
)
def stratified(t):
    """A hundred documents, dealt to sources by largest remainders, in hash order."""
    return audit.choose_sample(t("documents").select("doc_id", "source"), "source", "doc_id", 100, "s")


@query("sessions_topn", "WITH s AS (SELECT conv_id, max(turn) AS last_turn, conv_id % 10 = 0 AS pinned FROM conversations GROUP BY 1) SELECT conv_id, last_turn, pinned FROM s ORDER BY pinned DESC, last_turn DESC, conv_id LIMIT 20")
def sessions_topn(t):
    rows = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).withColumn("pinned", F.col("conv_id") % 10 == 0)
    return rows.orderBy(F.desc("pinned"), F.desc("last_turn"), "conv_id").limit(20)


@query("keep_newest_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def keep_newest(t):
    return audit.keep_newest(t("events"), "user_id", 5, [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "purchase").select("user_id", "event_id")


@query("message_tail", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE back <= 4 AND used <= 4000")
def message_tail(t):
    """The last messages of each session within a count and a size in bytes."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = t("conversations").withColumn("back", F.row_number().over(back)).withColumn("used", F.sum(F.octet_length("text")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("back <= 4 and used <= 4000").select("conv_id", "turn", "role")


@query("sliding_count", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_count(t):
    return windows.sliding_count(t("events"), "user_id", "ts", 86_400).select("event_id", "user_id", "in_window")


@query("daily_quota_admit", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def daily_quota(t):
    return windows.daily_quota(t("events"), "user_id", "ts", "event_id", 2).select("event_id", "user_id", "admitted")


@query("event_dedupe", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def event_dedupe(t):
    return windows.dedupe(t("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t):
    return audit.latest_per_key(t("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("retention_prune", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(t):
    last = t("events").agg(F.max("ts").alias("last"))
    return t("events").crossJoin(F.broadcast(last)).where(F.expr("ts >= last - interval 7 days")).select("event_id", "ts")


@query("late_reject", "SELECT event_id, user_id, coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts, false) AS late FROM events")
def late_reject(t):
    return windows.late(t("events"), "user_id", "ts", "event_id").select("event_id", "user_id", "late")


@query("rpm_wait", "SELECT event_id, greatest(coalesce(lag(epoch_us(ts), 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 86400000000 - epoch_us(ts), 0), 0) AS wait_us FROM events")
def rpm_wait(t):
    return windows.wait_for_slot(t("events"), "user_id", "ts", "event_id", 3, 86_400).select("event_id", "wait_us")


@query("sliding_admit")
def sliding_admit(t):
    return windows.sliding_admit(t("events"), "user_id", "ts", "event_id", ((1, 3_600), (3, 86_400)))


@query("lockout_window")
def lockout_window(t):
    return windows.lockout(t("events"), "user_id", "ts", "event_id", 3, 86_400, 172_800)


@query("json_canonical", "SELECT r_regionkey::BIGINT AS r_regionkey, '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' AS line FROM region".replace('\\"', '"'))
def json_canonical(t):
    """Rows as lines of JSON whose bytes depend on their values alone."""
    return json_lines(t("region"), "r_regionkey").select("r_regionkey", "line")


@query("json_props", "SELECT event_id, json_valid(props) AS ok, len(json_keys(props)) AS n_keys FROM events")
def json_props(t):
    keys = F.json_object_keys("props")
    return t("events").select("event_id", keys.isNotNull().alias("ok"), F.size(keys).alias("n_keys"))


@query("comparison_table", "SELECT s_suppkey, 'name' AS field, coalesce(nullif(trim(s_name), ''), '—') AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', coalesce(nullif(trim(n_name), ''), '—') FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0")
def comparison_table(t):
    """One row for each record and field; a missing value is a dash."""
    rows = t("supplier").join(t("nation").where("n_nationkey % 2 = 0"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.col("s_name").alias("name"), F.col("n_name").alias("nation"))
    long_ = rows.unpivot("s_suppkey", ["name", "nation"], "field", "value")
    return long_.withColumn("value", F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.lit("—")))


@query("cascade_delete", "SELECT 'events' AS store, count(*) AS kept FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def cascade_delete(t):
    gone = t("customer").where("c_custkey % 5 = 0").select("c_custkey")
    out = None
    for name, key in (("events", "user_id"), ("orders", "o_custkey")):
        left = t(name).join(gone, F.col(key) == F.col("c_custkey"), "left_anti").agg(F.lit(name).alias("store"), F.count("*").alias("kept"))
        out = left if out is None else out.unionByName(left)
    return out


@query("related_items", "SELECT item, related, rn FROM (SELECT a.p_partkey AS item, b.p_partkey AS related, row_number() OVER (PARTITION BY a.p_partkey ORDER BY a.p_brand = b.p_brand DESC, b.p_retailprice DESC, b.p_partkey) AS rn FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) WHERE rn <= 3")
def related_items(t):
    """Of the same kind, the same brand first, then the dearest; three each. Every item meets the four dearest of its kind
    and brand and, of its kind, the six dearest of three a brand: whatever its own brand, three others are among them."""
    best = [F.desc("p_retailprice"), F.asc("related")]
    rows = t("part").select(F.col("p_partkey").alias("related"), "p_brand", "p_type", "p_retailprice")
    own = lexical.top(rows, 4, ["p_type", "p_brand"], best)
    other = lexical.top(own.where("rank <= 3").drop("rank"), 6, ["p_type"], best).drop("rank")
    items = t("part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), "p_type")
    met = items.join(own.drop("rank").withColumnRenamed("p_brand", "brand"), ["p_type", "brand"]).select("item", "related", F.lit(True).alias("same"), "p_retailprice")
    met = met.unionByName(items.join(other, "p_type").where("brand <> p_brand").select("item", "related", F.lit(False).alias("same"), "p_retailprice"))
    return lexical.top(met.where("item <> related"), 3, ["item"], [F.desc("same"), *best]).select("item", "related", F.col("rank").alias("rn"))


@query("sigmoid_scores", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p FROM events")
def sigmoid_scores(t):
    return t("events").select("event_id", F.round(text.sigmoid((F.col("value") - 50) / 10), 6).alias("p"))


@query("contextual_header", "WITH c AS (SELECT doc_id, 'DOC-' || doc_id AS a, CASE WHEN doc_id % 3 > 0 THEN source END AS b, CASE WHEN lang = 'fr' THEN 'Other' ELSE upper(lang) END AS s FROM documents) SELECT doc_id, '[' || concat_ws(' | ', a, b, CASE WHEN s <> 'Other' THEN s END) || ']' AS header FROM c")
def contextual_header(t):
    section = F.when(F.col("lang") == "fr", "Other").otherwise(F.upper("lang"))
    subject = F.when(F.col("doc_id") % 3 > 0, F.col("source"))
    return t("documents").select("doc_id", cards.contextual_header(F.concat(F.lit("DOC-"), "doc_id"), subject, section).alias("header"))


@query("card_text", "SELECT s_suppkey, concat_ws(chr(10), 'Name: ' || s_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation: ' || n_name END) AS card, concat_ws('; ', s_name, n_name) AS row FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def card_text(t):
    rows = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    card = cards.card_text({"Name": F.col("s_name"), "Nation": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))})
    return rows.select("s_suppkey", card.alias("card"), cards.card_row(F.array("s_name", F.lit(""), "n_name")).alias("row"))


@query("readable_status", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'complete' WHEN quality = 1 THEN 'searchable' END AS status FROM labels")
def readable_status(t):
    return t("labels").select("doc_id", cards.readable_status({"a": F.col("quality") == 1, "b": F.col("toxic") == 0}, ["a"]).alias("status"))


@query("effective_plan", "WITH u AS (SELECT user_id, max(ts) AS last, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'pro' ELSE 'standard' END AS plan FROM events GROUP BY user_id) SELECT user_id, CASE WHEN coalesce(last <= TIMESTAMP '2024-01-29', false) THEN 'free' ELSE coalesce(plan, 'free') END AS plan FROM u")
def effective_plan(t):
    users = t("events").groupBy("user_id").agg(F.max("ts").alias("last"))
    plan = F.when(F.col("user_id") % 3 == 0, None).when(F.col("user_id") % 3 == 1, "pro").otherwise("standard")
    return users.select("user_id", cards.effective_plan(plan, F.col("last"), F.lit("2024-01-29").cast("timestamp_ntz")).alias("plan"))


@query("plan_histogram", "WITH u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN 'pro' WHEN user_id % 4 = 1 THEN 'premium' ELSE 'free' END AS plan FROM events) SELECT CASE WHEN plan IN ('pro', 'premium') THEN 'paid' ELSE plan END AS plan, count(*) AS n FROM u GROUP BY 1")
def plan_histogram(t):
    users = t("events").select("user_id").distinct()
    plan = F.when(F.col("user_id") % 4 == 0, "pro").when(F.col("user_id") % 4 == 1, "premium").otherwise("free")
    return users.groupBy(F.when(plan.isin("pro", "premium"), "paid").otherwise(plan).alias("plan")).agg(F.count("*").alias("n"))


@query("facet_relevance", f"WITH {DENSE_SQL}, m AS (SELECT qid, label, max(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS rn FROM m) SELECT qid, round(avg(score), 6) AS relevance FROM r WHERE rn <= 2 GROUP BY 1")
def facet_relevance(t):
    """The mean of a query's two best facets, each by its best chunk."""
    best = dense.leading(asked_vectors(t), vectors(t), ["qid"], ["label"], 1).groupBy("qid", "label").agg(F.max("score").alias("score"))
    return best.groupBy("qid").agg(F.round(cards.facet_relevance(F.collect_list("score")), 6).alias("relevance"))


@query("fuzzy_words", f"WITH w AS (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark), t AS (SELECT lower(n_name) AS target FROM nation UNION SELECT unnest(['that', 'there', 'nation', 'estion'])) SELECT word, target, levenshtein(word, target) AS distance FROM w, t WHERE 1 - levenshtein(word, target)::DOUBLE / greatest(length(word), length(target)) >= 0.75")
def fuzzy_words(t):
    """Words of query strings that are few edits from a target."""
    words = t("benchmark").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word")).distinct()
    extra = t("region").sparkSession.createDataFrame([("that",), ("there",), ("nation",), ("estion",)], "target string")
    targets = t("nation").select(F.lower("n_name").alias("target")).union(extra).distinct()
    return similar.close_words(words, targets, 0.75)


@query("similar_words")
def similar_words(t):
    """Words of all documents that read as one of the query strings' words, by matching blocks."""
    own = lambda name, key: t(name).select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias(key)).distinct()
    return similar.similar_words(own("documents", "word"), own("benchmark", "target").where(F.length("target") >= 6), 0.85)


@query("quota_with_refunds", "SELECT user_id, ts::DATE::VARCHAR AS day, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS used FROM events GROUP BY 1, 2")
def quota_with_refunds(t):
    delta = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return t("events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sum(delta).alias("used"))


@query("ready_stores", "SELECT 'documents' AS store, count(*) > 0 AS ready FROM documents UNION ALL SELECT 'embeddings', count(*) > 0 FROM embeddings WHERE label > 100")
def ready_stores(t):
    """Whether each store holds anything; reads a row at most."""
    out = None
    for name, rows in (("documents", t("documents")), ("embeddings", t("embeddings").where("label > 100"))):
        one = rows.limit(1).agg(F.lit(name).alias("store"), (F.count("*") > 0).alias("ready"))
        out = one if out is None else out.unionByName(one)
    return out


@query("recent_jobs", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def recent_jobs(t):
    return t("events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)


@query("message_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def message_index(t):
    own = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", (F.row_number().over(own) - 1).alias("idx"), F.lag("role").over(own).alias("before"))


@query("seed_upsert", "SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) o FULL JOIN (SELECT s_suppkey * 3 AS k, s_name AS v FROM supplier) n ON n.k = o.k")
def seed_upsert(t):
    """New values win, old rows stay, nothing is deleted."""
    old = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("old"))
    new = t("supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("new"))
    return old.join(new, "k", "full").select("k", F.coalesce("new", "old").alias("v"))


@query("mapping_rows", "SELECT label::BIGINT AS node, vec_id // 1000 AS block, count(*) AS chunk_count, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS vector_ids FROM embeddings GROUP BY 1, 2")
def mapping_rows(t):
    """Each node's vectors in blocks of a thousand ids: the ids in order, and how many. No row grows with a node."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")), ",")
    return t("embeddings").groupBy(F.col("label").alias("node"), F.expr("vec_id div 1000").alias("block")).agg(F.count("*").alias("chunk_count"), ids.alias("vector_ids"))


@query("captions")
def captions(t):
    c = F.col("text")
    return t("documents").select("doc_id", cards.bench_of(c).alias("bench"), cards.parties_of(c).alias("parties"), cards.counsel_of(c).alias("counsel"))


@query("query_types")
def query_types(t):
    return t("benchmark").select("item_id", cards.query_type_of(F.col("text")).alias("type"), cards.category_of(F.col("text")).alias("category"), cards.numbers_of(F.col("text")).alias("numbers"))


@query("bm25_stemmed")
def bm25_stemmed(t):
    return lexical.stemmed_topk(t("documents"), "doc_id", "text", terms_of(t), 5)


@query(
    "evidence_top_up",
    f"""WITH {DENSE_SQL}, a AS (SELECT qid, label AS doc, id // 4 AS node, id, score, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rn FROM s), h AS (SELECT * FROM a WHERE rn <= 2),
f AS (SELECT *, (qid, doc, node) IN (SELECT (qid, doc, node) FROM h) OR row_number() OVER (PARTITION BY qid, doc, node ORDER BY score DESC, id) > 1 AS again FROM a WHERE rn > 2)
SELECT qid, doc, node, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY again, score DESC, id) AS rank FROM f) WHERE rank <= 2""",
)
def evidence_top_up(t):
    """Two more chunks of each document beside its best two."""
    rows = dense.leading(asked_vectors(t), noded(t).withColumnRenamed("label", "doc"), ["qid"], ["doc"], 4, ["node"])
    return dense.top_up(rows, 2).select("qid", "doc", "node", "id", "score", "rank")


@query("wave_candidates", "SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE l.doc_id IS NULL AND d.lang = 'en'")
def wave_candidates(t):
    """Searchable documents without a current card."""
    current = t("labels").where("quality = 1").select("doc_id")
    return t("documents").where("lang = 'en'").join(current, "doc_id", "left_anti").select("doc_id", "n_chars")


@query("judgment_texts", "SELECT source, doc_id // 100 AS block, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1, 2")
def judgment_texts(t):
    """The texts of a group in the order of their ids, joined in blocks of a hundred ids."""
    parts = F.array_sort(F.collect_list(F.struct("doc_id", F.col("text").alias("t"))))
    return t("documents").groupBy("source", F.expr("doc_id div 100").alias("block")).agg(F.array_join(F.transform(parts, lambda s: s["t"]), "\n").alias("text"))
