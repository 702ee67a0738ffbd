"""A stored index gives what plain loops over the living texts give, through upserts, removals and compaction."""

import math
import re

import pytest

from tessera.operators.postings import PostingIndex
from tessera.sources.store import shared_dir

DOC = "id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best(live, queries, k):
    n, avgdl = len(live), sum(len(words(x)) for x in live.values()) / len(live)
    out = set()
    for qid, asked in queries.items():
        scores = {}
        for term in asked:
            df = sum(term in words(x) for x in live.values())
            raw = math.log((n - df + 0.5) / (df + 0.5))
            for i, x in live.items():
                tf, dl = words(x).count(term), len(words(x))
                if tf:
                    scores[i] = scores.get(i, 0) + max(raw, 0 if raw > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
        order = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k]
        out |= {(qid, r + 1, i, round(scores[i], 6)) for r, i in enumerate(order)}
    return out


def test_index_through_changes(spark):
    index = PostingIndex(spark, shared_dir(spark, "test-postings"))
    with pytest.raises(FileNotFoundError):
        index.documents()
    live = {1: "the law of the land", 2: "land of the Free, of the brave", 3: None, 4: "", 5: "brave law law law", 6: "x the of"}
    queries = {1: ["law", "of"], 2: ["brave", "none"], 3: ["free"]}
    terms = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws], "qid long, term string")

    def holds():
        assert {(r.qid, r["rank"], r.id, round(r.score, 6)) for r in index.bm25_topk(terms, 2).collect()} == best(live, queries, 2)
        assert {(r.id, r.dl) for r in index.documents().collect()} == {(i, len(words(x))) for i, x in live.items()}
        pairs = {i: list(zip(words(x), words(x)[1:])) for i, x in live.items()}
        assert {(r.id, r.hits) for r in index.phrase(["of", "the"]).collect()} == {(i, p.count(("of", "the"))) for i, p in pairs.items() if ("of", "the") in p}
        near = {i: sum({a, b} == {"of", "the"} for d in (1, 2) for a, b in zip(words(x), words(x)[d:])) for i, x in live.items()}
        assert {(r.id, r.hits) for r in index.near("of", "the", 1).collect()} == {(i, h) for i, h in near.items() if h}
        got = index.counts().first()
        assert (got.postings, got.documents) == (sum(len(set(words(x))) for x in live.values()), len(live))

    index.upsert(spark.createDataFrame([*live.items(), (None, "law")], DOC), "id", "text")
    holds()
    changed = {2: "law of free men", 3: "brave new law", 9: "of the of the"}
    index.upsert(spark.createDataFrame([*changed.items()], DOC), "id", "text")
    index.remove(spark.createDataFrame([(1,), (77,)], "id long"), "id")
    live = {**live, **changed}
    del live[1]
    holds()
    index.compact()
    holds()
    index.upsert(spark.createDataFrame([(1, "the law is back")], DOC), "id", "text")
    live[1] = "the law is back"
    holds()
    with pytest.raises(ValueError):
        index.upsert(spark.createDataFrame([(1, "a"), (1, "b")], DOC), "id", "text")
    assert {r.term for r in index.key_terms(terms, 0.3).collect()} == {t for t in {"law", "of", "brave", "none", "free"} if 0 < sum(t in words(x) for x in live.values()) <= 0.3 * len(live)}


def test_words_are_grouped_without_a_shuffle(spark, monkeypatch):
    """What is written sorts rows into buckets and does nothing else between tasks."""
    plans, write = [], PostingIndex._write
    monkeypatch.setattr(PostingIndex, "_write", lambda self, rows, docs: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows, docs))
    index = PostingIndex(spark, shared_dir(spark, "unshuffled"))
    index.upsert(spark.createDataFrame([(1, "b a b"), (2, None), (3, "a")], "id long, text string"), "id", "text")
    assert "Exchange" not in plans[0]
    rows = {(r.id, r.term, tuple(r.positions), r.dl) for r in index.rows(spark.createDataFrame([("a",), ("b",)], "term string")).collect()}
    assert rows == {(1, "b", (0, 2), 3), (1, "a", (1,), 3), (3, "a", (0,), 1)}
