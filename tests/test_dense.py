"""Vector search in several blocks of queries gives what brute force gives for every query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, fusion


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_no_query_is_lost_between_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "QUERIES", block)
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(30, 4)), rng.normal(size=(11, 4))
    score = np.round(asked @ vectors.T, 6)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "id long, v array<double>")
    q = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(asked)], "qid long, q array<double>")
    got = {(r.qid, r.rank, r.id) for r in dense.topk(q, v, 3).collect()}
    assert got == {(k, n + 1, int(i)) for k in range(11) for n, i in enumerate(np.argsort(-score[k])[:3])}

    phrasings = q.selectExpr("qid div 4 as qid", "qid % 4 as phrase", "q")
    got = {(r.qid, r.rank, r.id) for r in dense.multi_phrasing(phrasings, v, 3).collect()}
    best = {k: score[4 * k : 4 * k + 4].max(axis=0) for k in range(3)}
    assert got == {(k, n + 1, int(i)) for k in range(3) for n, i in enumerate(np.argsort(-best[k])[:3])}


@pytest.mark.parametrize("held, asked", [(8, 3), (4096, 2048)])
def test_only_candidates_leave_the_parts(spark, monkeypatch, held, asked):
    """First rows, nodes and liked ones of each group by loops over all pairs; ties, nulls and lists of other lengths included."""
    monkeypatch.setattr(dense, "VECTORS", held)
    monkeypatch.setattr(dense, "QUERIES", asked)
    rng = np.random.default_rng(5)
    lists = [[float(x) for x in rng.integers(-3, 4, 3)] for _ in range(60)]
    lists[7], lists[11], lists[13] = None, [1.0, None, 2.0], [1.0, 2.0]
    v = spark.createDataFrame([(k, k % 3, k // 4, k % 5 == 0, x) for k, x in enumerate(lists)], "id long, doc long, node long, liked boolean, v array<double>")
    q = spark.createDataFrame([(k, lists[k]) for k in range(0, 60, 6)] + [(99, None)], "qid long, q array<double>")
    good = lambda x: x is not None and len(x) == 3 and None not in x
    score = lambda a, b: sum(x * y for x, y in zip(a, b)) if good(a) and good(b) else None
    order = lambda r: (r[1] is None, -(r[1] or 0), r[0])
    best, picked, more = set(), set(), set()
    for qid, a in [(k, lists[k]) for k in range(0, 60, 6)] + [(99, None)]:
        for doc in range(3):
            rows = sorted(((k, score(a, b)) for k, b in enumerate(lists) if k % 3 == doc), key=order)
            best |= {(qid, doc, *r) for r in rows[:2]}
            seen, again = set(), {}
            for k, _ in rows:
                again[k] = k // 4 in seen
                seen.add(k // 4)
            by = sorted(rows, key=lambda r: (again[r[0]], order(r)))
            chosen = by[:3]
            if not any(k % 5 == 0 for k, _ in chosen):
                chosen = by[:2] + ([r for r in by[3:] if r[0] % 5 == 0][:1] or by[2:3])
            picked |= {(qid, doc, *r) for r in chosen}
            more |= {(qid, doc, *r) for r in sorted(rows[2:], key=lambda r: (again[r[0]], order(r)))[:2]}
    as_set = lambda df: {(r.qid, r.doc, r.id, r.score) for r in df.collect()}
    rows = dense.leading(q, v, ["qid"], ["doc"], 2)
    assert as_set(dense.within_group(rows, "doc", 2)) == best
    if held == 4096:
        assert rows.count() == len(best)  # one part: nothing but the result leaves it
    assert as_set(fusion.select_evidence(dense.leading(q, v, ["qid"], ["doc"], 3, ["node"], "liked"), 3, F.col("liked"))) == picked
    assert as_set(dense.top_up(dense.leading(q, v, ["qid"], ["doc"], 4, ["node"]), 2)) == more
    nodes = dense.leading(q, v, ["qid"], ["node"], 1, whole=True)
    assert nodes.count() == 11 * 15 == nodes.select("qid", "node").distinct().count()


def test_rounding_is_half_up():
    x = np.array([[0.0000005, -0.0000005, 0.1234565, 2.5e-7, -0.0, 1e12 + 0.5, np.inf]])
    assert dense.rounded(x).tolist() == [[0.000001, -0.000001, 0.123457, 0.0, 0.0, 1e12 + 0.5, np.inf]]
