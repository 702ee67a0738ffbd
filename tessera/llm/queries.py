"""The queries of this subpackage: each applies one operator, with its production parameters, to the
whole of its table. SQL stands beside a query where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import jaccard_join

    joined = jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import without_repeats

    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import drawn, joined

    return joined(drawn(table(spark, sf_dir, "embeddings")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import THRESHOLD, scored

    marked = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    marked = marked.select("doc_id", F.col("toxicity.toxic").alias("score"), F.col("toxicity.junk").alias("junk"), F.col("toxicity.toxic_wellformed").alias("toxic_wellformed"))
    return marked.withColumn("toxic", F.col("score") >= THRESHOLD)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import THRESHOLD, held_out, scored

    marked = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    marked = marked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return marked.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import digest

    return digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import packed

    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fim import restored, transformed

    made = transformed(table(spark, sf_dir, "documents"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


def op13_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import laid_out, reshard

    sharded = reshard(laid_out(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rows, shard, slot = sharded.placed()
    return rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(shard), F.col(slot), F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_media_copies": op3_media_copies,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_fim": op11_fim,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_reshard": op13_reshard,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
BASE32 = " || ".join(f"substr('{UPPER}234567', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT) >> {shift}) & 31)::INT + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))

#: crc32 of the decimal ``c``: each byte is taken in, then eight shifts (-1).
CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"

#: What SQL can state in reasonable time.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, {SPACED}) AS a FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(a[i : i + 3], ' ')) AS g FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 3, 1))) AS i FROM w WHERE len(a) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
 FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = d.doc_id""",
    "op2_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS a FROM documents),
 h AS (SELECT doc_id, i, md5(array_to_string(a[i : i + 34], ' ')) AS h FROM (SELECT doc_id, a, unnest(generate_series(1, len(a) - 34)) AS i FROM w WHERE len(a) >= 35)),
 r AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1),
 c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM h WHERE h IN (SELECT h FROM r))),
 k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS p FROM w) z ANTI JOIN c USING (doc_id, p) GROUP BY 1),
 m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
 SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(m.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op4_decontaminate": f"""WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({FOLDED}, {ALNUM}) AS a FROM benchmark),
 bw AS (SELECT DISTINCT item, size, array_to_string(a[i : i + size - 1], ' ') AS g FROM (SELECT item, a, least(13, len(a)) AS size, unnest(generate_series(1, len(a) - least(13, len(a)) + 1)) AS i FROM b WHERE len(a) > 0)),
 w AS (SELECT doc_id, regexp_extract_all({FOLDED}, {ALNUM}) AS a FROM documents),
 dw AS (SELECT doc_id, size, i, array_to_string(a[i : i + size - 1], ' ') AS g FROM (SELECT doc_id, a, size, unnest(generate_series(1, len(a) - size + 1)) AS i FROM w, (SELECT DISTINCT size FROM bw) WHERE len(a) >= size)),
 m AS (SELECT doc_id, size, i, item FROM dw JOIN bw USING (size, g)),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
 SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(a) AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
 SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op11_fim": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS a FROM documents),
 x AS (SELECT *, len(a)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(a) + 1) AS i, ('0x' || substr(h, 9, 8))::BIGINT % (len(a) + 1) AS j, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
 f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
 p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(a[1 : least(i, j)], ''), '') AS p, coalesce(array_to_string(a[least(i, j) + 1 : greatest(i, j)], ''), '') AS m, coalesce(array_to_string(a[greatest(i, j) + 1 : n], ''), '') AS s FROM f)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_prefix_trie": f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS x, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT c, m, len(regexp_extract_all(x, {SPACED}))::BIGINT AS w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS k FROM t),
 s AS (SELECT c, count(*) AS total, c - c % 20 AS base, {CRC32} % 4 AS h FROM o GROUP BY 1),
 r AS (SELECT s.c, k AS d, m, w FROM s JOIN o ON o.c = s.base AND k <= h UNION ALL SELECT o.c, k - h + least(h, coalesce(b.total, 0)), m, w FROM o JOIN s ON s.c = o.c AND k > h LEFT JOIN (SELECT c, total FROM s) b ON b.c = s.base),
 p AS (SELECT c, d, md5(string_agg(m, ',') OVER (PARTITION BY c ORDER BY d)) AS g, w FROM r UNION ALL SELECT c, 0, '', 0 FROM s),
 q AS (SELECT *, lag(g) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS last FROM p),
 n AS (SELECT g, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS value, string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM q GROUP BY 1),
 k AS (SELECT parent AS g, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
 z AS (SELECT DISTINCT a.g AS top, b.g FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d),
 y AS (SELECT top AS g, count(*) FILTER (k.g IS NULL) AS n_leaves, sum(value) AS saved_tokens FROM z JOIN n USING (g) LEFT JOIN k USING (g) GROUP BY 1)
 SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
 FROM n LEFT JOIN n u ON u.g = n.parent LEFT JOIN k ON k.g = n.g JOIN y ON y.g = n.g""",
}
