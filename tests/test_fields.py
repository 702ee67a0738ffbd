"""Expression tables against published rules, and the multi-field index against an independent full-text engine
(FTS5 of the standard library), through upserts, removals and compaction."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import expressions as ex
from tessera.operators.fields import FieldIndex, group_hits, scores
from tessera.sources.store import Versioned, shared_dir


def expressed(spark, *queries, narrative=None):
    df = spark.createDataFrame([(k, *((q, None, []) if isinstance(q, str) else q)) for k, q in enumerate(queries)], "qid long, cleaned string, rewrite string, more array<string>")
    texts = ex.phrasings(F.array("cleaned"), F.array("rewrite"), F.col("more"))
    flag = F.lit(narrative) if narrative is not None else ex.is_narrative(F.col("cleaned"))
    out = {k: [] for k in range(len(queries))}
    for r in ex.expressions(df, "qid", texts, flag).orderBy("qid", "ord").collect():
        out[r.qid].append((r.kind, " ".join(r.parts)))
    return out


def test_expressions(spark):
    story = "my client says the other side argued that the suit was time-barred and that the family court alone had jurisdiction over the dower land but the high court decreed it"
    got = expressed(spark, "c.a. 23-p/2017 under article 185(3) and s.302", "pirzada noor-ul-basar", "the of and", ("brand owner", "trade mark assignment", ["proprietor of mark", None]), story, "what the client says", "", "7-a 2 x 2017 2017")
    assert got[0] == [("near", "23 p 2017"), ("term", "23"), ("term", "2017"), ("term", "article"), ("near", "185 3"), ("term", "185"), ("near", "s 302"), ("term", "302")]
    assert got[1] == [("term", "pirzada"), ("phrase", "noor ul basar")]
    assert got[2] == [] and got[6] == []
    assert got[3] == [("term", w) for w in "brand owner trade mark assignment proprietor".split()]
    words = {w for _, w in got[4]}
    assert not words & {"says", "client", "side"} and {"dower", "decreed", "time barred"} <= words
    assert ("term", "says") in got[5]
    assert got[7] == [("near", "7 a"), ("term", "2017")]


def test_budget(spark):
    filler = " ".join(f"court appeal zzqx{k}" for k in range(70))
    df = spark.createDataFrame([(1, f"c.a. 23-p/2017 {filler} dower nikah"), (2, "court dower")], "qid long, q string")
    rows = ex.expressions(df, "qid", F.array("q"), F.lit(False))
    known = spark.createDataFrame([("court", 90), ("appeal", 80), ("dower", 2), ("nikah", 1), ("zzqx3", 50)], "term string, df long")
    kept = lambda n: [(r.kind, r.parts[0]) for r in ex.budgeted(rows, known, n).where("qid = 1").orderBy("ord").collect()]
    assert kept(64) == [("near", "23"), ("term", "23"), ("term", "2017"), ("term", "court"), ("term", "appeal"), ("term", "zzqx3"), ("term", "dower"), ("term", "nikah")]
    assert kept(5) == [("near", "23"), ("term", "23"), ("term", "2017"), ("term", "dower"), ("term", "nikah")]
    assert kept(2) == [("near", "23"), ("term", "23")]
    assert ex.budgeted(rows, None, 5).where("qid = 1").count() == 5
    assert ex.budgeted(rows, known, 2).where("qid = 2").count() == 2


def test_group_hits():
    import numpy as np

    rng = random.Random(8)
    for _ in range(300):
        places = [np.array(sorted(rng.sample(range(25), rng.randint(1, 8)))) for _ in range(rng.randint(2, 3))]
        phrase = [s for s in range(25) if all(s + k in p for k, p in enumerate(places))]
        assert group_hits("phrase", places, 2)[0].tolist() == phrase
        near = []
        for p in places:
            near.append([x for x in p.tolist() if any(s <= x <= s + 3 and all(((q >= s) & (q <= s + 3)).any() for q in places) for s in range(-3, 26))])
        assert [p.tolist() for p in group_hits("near", places, 2)] == near


WORDS = "running run dogs dog allotment allotted courts court appeal appeals élan elan 23 p 2017 noor ul basar law relational"
COLUMNS = ["title", "body", "notes"]


def make(rng, n):
    words = WORDS.split()
    return " ".join(rng.choice(words) for _ in range(n)) if n else None


def match(kind, parts):
    if kind == "near":
        return f"NEAR({' '.join(chr(34) + p + chr(34) for p in parts)}, 2)"
    return '"' + " ".join(parts) + '"'


@pytest.mark.parametrize("stemmed", [True, False])
def test_index_against_fts5(spark, stemmed):
    db = sqlite3.connect(":memory:")
    tokenizer = "porter unicode61 remove_diacritics 2" if stemmed else "unicode61 remove_diacritics 0"
    db.execute(f"create virtual table t using fts5(title, body, notes, tokenize='{tokenizer}')")
    rng = random.Random(11)
    live = {k: (make(rng, rng.randint(0, 3)), make(rng, rng.randint(0, 40)), make(rng, rng.randint(0, 12))) for k in range(1, 60)}
    live[60] = (None, None, None)
    schema = "id long, title string, body string, notes string, dl int, postings string"
    frame = lambda rows: spark.createDataFrame([(k, *v, 1, "x") for k, v in rows.items()], schema)
    queries = ["court 23-p/2017", "noor-ul-basar appeal", "allotment élan", "running dogs law", "zebra", "court-appeal 23/23 dog-dog", "relational"]
    df = spark.createDataFrame([(k, q) for k, q in enumerate(queries)], "qid long, q string")
    rows = ex.expressions(df, "qid", F.array("q"), F.lit(False))
    asked = {}
    for r in rows.collect():
        asked.setdefault(r.qid, []).append(match(r.kind, r.parts))
    weights = [4.0, 1.0, 1.5]
    index = FieldIndex(spark, shared_dir(spark, "fields"), COLUMNS, stemmed)
    with pytest.raises(FileNotFoundError):
        index.documents()

    def holds():
        db.execute("delete from t")
        db.executemany("insert into t(rowid, title, body, notes) values (?, ?, ?, ?)", [(k, *v) for k, v in live.items()])
        want = set()
        for q, parts in asked.items():
            found = [(round(-s, 6), i) for i, s in db.execute("select rowid, bm25(t, 4.0, 1.0, 1.5) from t where t match ?", (" OR ".join(parts),))]
            want |= {(q, i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:10]}
        got = {(r.qid, r.id, r.score) for r in index.search(index.stems_of(rows), 10, weights).collect()}
        assert {(q, i) for q, i, _ in got} == {(q, i) for q, i, _ in want}
        near = {(q, i): s for q, i, s in want}
        assert all(abs(near[q, i] - s) <= 2e-6 for q, i, s in got)
        documents = {(r.id, r.dl) for r in index.documents().collect()}
        assert documents == {(k, len(re.findall(r"\w+", " ".join(x or "" for x in v)))) for k, v in live.items()}
        stems = [r.stem for d in index.documents().collect() for r in d.postings]
        counts = index.counts().first()
        assert (counts.postings, counts.stems, counts.documents, counts.words) == (len(stems), len(set(stems)), len(live), sum(dl for _, dl in documents))

    index.upsert(frame(live | {None: ("court", "court", "court")}), "id")
    holds()
    changed = {3: ("court", "élan of the law", None), 7: (None, None, "23 of p or 2017 noor ul basar"), 90: ("new", "court court appeal dog dog", "dog dog")}
    index.upsert(frame(changed), "id")
    live |= changed
    holds()
    index.remove(spark.createDataFrame([(1,), (2,), (3,), (777,), (None,)], "id long"), "id")
    for k in (1, 2, 3):
        del live[k]
    holds()
    index.remove(spark.createDataFrame([(1,)], "id long"), "id")
    index.compact()
    holds()
    index.upsert(frame({1: ("back", "again court", "23 p")}), "id")
    live[1] = ("back", "again court", "23 p")
    holds()
    with pytest.raises(ValueError):
        index.upsert(spark.createDataFrame([(1, "a", "b", "c"), (1, "b", "c", "d")], "id long, title string, body string, notes string"), "id")
    holds()


def test_stemmed_search_of_texts_equals_the_index(spark):
    from tessera.operators import lexical

    rng = random.Random(12)
    rows = [(k, make(rng, rng.randint(0, 30))) for k in range(50)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "id long, body string")
    asked = spark.createDataFrame([(1, "runs"), (1, "dog"), (2, "Élan"), (2, "appealing"), (3, "allotments"), (3, "zebra")], "qid long, term string")
    index = FieldIndex(spark, shared_dir(spark, "stems"), ["body"], True)
    index.upsert(docs, "id")
    units = index.stems_of(asked.select("qid", F.lit("term").alias("kind"), F.array(F.lower("term")).alias("parts")))
    want = {(r.qid, r.id, r["rank"], round(r.score, 5)) for r in index.search(units, 8).collect()}
    got = {(r.qid, r.id, r["rank"], round(r.score, 5)) for r in lexical.stemmed_topk(docs, "id", "body", asked, 8).collect()}
    assert got == want and len(got) > 16


def test_failed_write_leaves_the_table(spark, monkeypatch):
    t = Versioned(spark, shared_dir(spark, "versions"))
    assert t.current() is None
    t.rebuild(spark.range(3).toDF("id"))

    def stop(self, version):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Versioned, "point", stop)
        with pytest.raises(OSError):
            t.upsert(spark.range(2, 9).toDF("id"), "id")
    assert t.read().count() == 3 and Versioned(spark, t.path).read().count() == 3
    for k in range(12):
        t.upsert(spark.createDataFrame([(100 + k,)], "id long"), "id")
    assert t.read().count() == 15


def test_queries_that_share_frequent_units_are_not_paired_with_every_document(spark):
    """200 queries ask one of two sets of frequent units and rare ones of their own: the k best are those of brute force, from few rows."""
    rng = random.Random(21)
    n, k, common = 400, 3, ["a", "b", "c"]
    gains = {(u, i): 0.25 * rng.randint(1, 4) for u in common for i in range(n) if rng.random() < 0.6}
    gains |= {(f"own{q}", rng.randrange(n)): 0.5 * rng.randint(1, 5) for q in range(200) for _ in range(3)}
    asked = {q: {"a", "b" if q % 2 else "c", f"own{q}"} for q in range(200)} | {200: {"own7"}, 201: {"none"}}
    df = {u: sum(1 for w, _ in gains if w == u) for u, _ in gains}
    frame = spark.createDataFrame([(u, i, g) for (u, i), g in gains.items()], "unit string, id long, gain double")
    named = spark.createDataFrame([(q, u) for q, units in asked.items() for u in sorted(units)], "qid long, unit string")
    got = scores(frame, named, spark.createDataFrame([*df.items()], "unit string, df long"), n, k, pairs=1000).collect()
    found, want = {}, {}
    for r in got:
        found.setdefault(r.qid, []).append((-round(r.score, 6), r.id))
    for q, units in asked.items():
        sums = {}
        for (u, i), g in gains.items():
            if u in units:
                sums[i] = sums.get(i, 0.0) + g
        want[q] = sorted((-round(s, 6), i) for i, s in sums.items())[:k]
    assert {q: sorted(found.get(q, []))[:k] for q in asked} == want
    assert len(got) <= 200 * (k + 3) + 3


def test_index_and_search_shuffle_no_postings_and_no_pairs(spark, monkeypatch):
    """An index is built without a shuffle of its postings; queries without common sets meet documents in the documents' tasks."""
    from tessera.operators import fields
    from tessera.sources.store import kept

    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(200)) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts)], "id long, text string").repartition(4)
    shuffled = lambda: sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(k) for k in range(s.size())])(spark._jsc.sc().statusStore().executorList(True)))
    index = FieldIndex(spark, shared_dir(spark, "unshuffled"), ["text"], stemmed=False)
    docs = kept(docs, "docs")
    before = shuffled()
    index.upsert(docs, "id")
    assert shuffled() - before < 400 * 100  # ids and stems with their counts, where postings take over 1,000 bytes a document
    asked = spark.createDataFrame([(q, "term", [w]) for q in range(300) for w in {rng.choice(texts[q].split()) for _ in range(6)}], "qid long, kind string, parts array<string>")
    whole = sorted(tuple(r) for r in index.search(asked, 5).collect())
    assert len(whole) == 1500
    monkeypatch.setattr(fields, "PAIRS", 20_000)
    paired = fields.scores
    monkeypatch.setattr(fields, "scores", lambda *rows: paired(*rows, pairs=1000))
    before = shuffled()
    assert sorted(tuple(r) for r in index.search(asked, 5).collect()) == whole
    assert shuffled() - before < 300 * 400 * 10  # over 100,000 pairs; what is shuffled are a document's gains and each task's leading rows


def test_documents_are_inverted_in_bounded_slices(monkeypatch):
    import pyarrow as pa

    from tessera.operators import fields

    rng = random.Random(4)
    lists = [[[rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 7, 40]))] for _ in range(50)] for _ in range(2)]
    batch = pa.record_batch([pa.array(range(50)), *[pa.array(x, pa.list_(pa.string())) for x in lists]], ["id", "f0", "f1"])
    rows = lambda: [list(fields.inverted(2, False)(iter([b]))) for b in (batch, batch.slice(7, 20))]
    canonical = lambda found: [[(r["id"], r["dl"], sorted((p["stem"], p["positions"]) for p in r["postings"])) for b in part for r in b.to_pylist()] for part in found]
    whole = canonical(rows())
    monkeypatch.setattr(fields, "WORDS", 30)
    cut = rows()
    assert canonical(cut) == whole
    assert all(b.num_rows == 1 or sum(b.column("dl").to_pylist()) <= 30 for part in cut for b in part) and len(cut[0]) > 5


def test_few_documents_cross_to_python_at_once(spark, monkeypatch):
    import pyarrow as pa

    from tessera.operators import fields, postings
    from tessera.operators.postings import PostingIndex

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def rows_of_batch(*_):
        def run(batches):
            for b in batches:
                posting = pa.array([[{"stem": "a", "positions": [b.num_rows]}]] * b.num_rows, pa.list_(pa.struct([("stem", pa.string()), ("positions", pa.list_(pa.int64()))])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b.num_rows] * b.num_rows, pa.int64()), posting], ["id", "dl", "postings"])

        return run

    docs = spark.range(0, 3 * fields.BATCH_ROWS, 1, 1).selectExpr("id", "'a' as text")
    before = spark.conf.get(setting)
    monkeypatch.setattr(fields, "inverted", rows_of_batch)
    monkeypatch.setattr(postings, "inverted", rows_of_batch)
    index = FieldIndex(spark, shared_dir(spark, "test-batches"), ["text"], stemmed=False)
    index.upsert(docs, "id")
    assert {r["dl"] for r in index.documents().select("dl").distinct().collect()} == {fields.BATCH_ROWS}
    other = PostingIndex(spark, shared_dir(spark, "test-batches-postings"))
    other.upsert(docs, "id", "text")
    assert {r["positions"][0] for r in other._read("postings").collect()} == {fields.BATCH_ROWS}
    assert spark.conf.get(setting) == before
