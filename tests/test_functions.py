"""Golden cases of the parsers, chunkers and windows."""

import datetime
import random

from pyspark.sql import functions as F

from tessera.functions import chunks, parse, text
from tessera.operators import audit, fusion, gate
from tessera.sources import store
from tessera.streaming import windows


def test_facets():
    got = parse.facets("She left the house in May. The trial court dismissed her suit. Whether she has a right is asked.")
    assert set(got) == {"facts", "outcome", "issue"}


def chunked(sizes, budget, overlap):
    """Chunks in plain loops: [(first, end)]."""
    out, first, k = [], 0, 0
    while k < len(sizes):
        if k > first and sum(sizes[first : k + 1]) > budget:
            out.append((first, k))
            keep = [b for b in range(overlap + 1) if k - b > first or not b]
            first = k - max(b for b in keep if not b or sum(sizes[k - b : k + 1]) <= budget)
        k += 1
    return [*out, (first, k)] if sizes else out


def test_chunks(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, text string")
    got = frame([(1, "", 'Mr. Khan came. He left!\nNo. 5 is here. A. B. spoke. "Why?" Été. x'), (2, "", None), (3, "", " \n ")])
    assert [r.sentence for r in chunks.sentence_rows(got, "id", "text").collect()] == ["Mr. Khan came.", "He left!", "No. 5 is here.", "A. B. spoke.", '"Why?"', "Été.", "x"]
    rng = random.Random(3)
    rows = [(k, "A title", " ".join("w " * rng.randint(1, 30) + f"end{j}." for j in range(rng.randint(0, 30)))) for k in range(200)] + [(200, None, "w " * 200), (201, "T", None), (202, "T", "short text")]
    for budget, overlap in ((50, 2), (40, 1), (35, 0), (60, 3)):
        out = {}
        for r in chunks.chunk_rows(frame(rows), "id", "text", budget, overlap).orderBy("id", "chunk").collect():
            out.setdefault(r.id, []).append((r.text, r.n_tokens))
            assert r.n_tokens <= budget
        for i, _, t in rows[:200]:
            whole = [s + "." for s in t.split(". ")] if t else []
            whole = [s.rstrip(".") + "." for s in whole]
            sizes = [len(s.split()) + 1 for s in whole]
            want = [(" ".join(" ".join(s.split()) for s in whole[a:b]), sum(sizes[a:b])) for a, b in chunked(sizes, budget, overlap)]
            assert [(" ".join(x.split()), n) for x, n in out.get(i, [])] == want
        assert sum(n for _, n in out[200]) == 200 and 201 not in out
    titled = chunks.chunk_rows(frame(rows), "id", "text", 80, 2, "title").where("id >= 200 or id = 0").collect()
    assert all(r.text.startswith("A title\n") for r in titled if r.id == 0) and [r.text for r in titled if r.id == 202] == ["T\nshort text"]


def test_text_columns(spark):
    row = spark.createDataFrame([("  A  b!é ", "12.3.2020", "31.02.2020", None)], "a string, d string, e string, n string")
    got = row.select(
        text.clean_query(F.col("a")).alias("clean"), text.compact(F.col("a")).alias("compact"), text.card_date(F.col("d")).alias("d"), text.card_date(F.col("e")).alias("e"), text.is_blank(F.col("n")).alias("blank"), text.tokens(F.col("n")).alias("tokens"), text.ngrams(text.tokens(F.col("a")), 2).alias("grams"), text.ngrams(text.tokens(F.col("a")), 5).alias("none"),
        text.sigmoid(F.lit(-800.0)).alias("low"), text.nearest_rank(F.array(F.lit(3), F.lit(1), F.lit(2)), 0.5).alias("mid"),
    ).first()
    assert (got.clean, got.compact, got.blank, got.tokens, got.grams, got.none) == ("a b", "ab", True, [], ["a b", "b é"], [])
    assert got.d == datetime.date(2020, 3, 12) and got.e is None and got.low == 0.0 and got.mid == 2


def test_fusion_pins_and_ties(spark):
    rows = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1), (1, "b", 10, 2), (1, "exact", 99, 1)], "qid long, source string, id long, rank long")
    got = fusion.fuse(fusion.collapse(rows)).orderBy("position").collect()
    assert [r.id for r in got] == [99, 10, 11]
    assert got[0].rrf == 0.0 and got[0].pinned and got[0].n_first == 1


def test_gate_judges_the_top_row(spark):
    rows = spark.createDataFrame([(1, 5, 1, 0.1, None, 1, False), (1, 6, 2, 0.9, None, 1, False), (2, 7, 1, 0.3, None, 0, False), (2, 8, 2, 0.1, None, 0, True)], "qid long, id long, position long, relevance double, lead double, n_first long, pinned boolean")
    assert sorted(r.id for r in gate.agreement_gate(rows).collect()) == [7, 8]


def test_sliding_and_lockout_rules():
    s = windows.Sliding(((2, 60),))
    assert [s.admit(t * 1_000_000) for t in (0, 10, 20, 60, 61)] == [True, True, False, True, False]
    lock = windows.Lockout(2, 60, 100)
    assert [lock.admit(t * 1_000_000) for t in (0, 10, 20, 111)] == [True, True, False, True]


def test_stream_admit_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=7 * k)) for k in range(60)]
    df = spark.createDataFrame(rows, "user long, event long, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    limits = ((2, 60), (5, 600))
    want = {(r.key, r.event): r.admitted for r in windows.sliding_admit(df, "user", "ts", "event", limits).collect()}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.stream_admit(stream, "user", "ts", "event", limits).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.event): r.admitted for r in spark.table("admitted").collect()} == want


def test_versioned_store(spark, tmp_path):
    t = store.Versioned(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert t.current() is None and t.missing(rows, "id").count() == 2
    t.rebuild(rows)
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), "id")
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    t.remove(spark.createDataFrame([(1,)], "id long"), "id")
    assert sorted(r.id for r in t.read().collect()) == [2, 3]
    assert t.missing(rows, "id").collect()[0].id == 1


def test_log_dump_restore(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"k":"x","n":1,"a":"p"}\n{"k":"x","n":2,"b":"q"}\n{"k":"y","n":1}\n{"k":"z","n"')
    got = {r.k: (r.a, r.b) for r in store.read_log(spark, f"file://{tmp_path}/log", "k string, n int, a string, b string", "k", "n").collect()}
    assert got == {"x": ("p", "q"), "y": (None, None)}
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    assert store.dump({"t": df}, f"file://{tmp_path}/d").first().rows == 1
    assert store.restore(spark, f"file://{tmp_path}/d", {"t": "id long, v string"})["t"].count() == 1


def test_triage(spark):
    files = spark.createDataFrame([(1, "h", True), (2, "h", True), (3, "k", True), (4, "z", False)], "id long, hash string, valid boolean")
    known = spark.createDataFrame([("k",)], "hash string")
    assert {r.id: r.category for r in audit.triage(files, known).collect()} == {1: "new", 2: "duplicate", 3: "known", 4: "invalid"}


def test_names_and_page_marks(spark):
    from tessera.plans import records

    rows = spark.createDataFrame([("in Ali Khan v. The State it was held",), ("no names v here",)], "text string")
    got = [tuple(r) for r in rows.select(*[F.regexp_extract_all("text", F.lit(records.NAMES), F.lit(k)) for k in (1, 2)]).collect()]
    assert got == [(["Ali Khan"], ["The State"]), ([], [])]
    marks = spark.createDataFrame([("a\n--- PAGE 3 ---\nb\nPage 1 of 9\npage 3 says",)], "text string").select(F.regexp_replace("text", records.PAGE_MARKS, "")).first()[0]
    assert marks == "a\n\nb\n\npage 3 says"
