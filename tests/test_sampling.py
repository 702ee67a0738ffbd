"""Samples, resamples and near words against plain loops."""

import hashlib
import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest

from tessera.operators import audit, metrics, similar


def loop_quotas(sizes, n):
    total = sum(sizes.values())
    quota = {s: max(1, n * k // total) for s, k in sizes.items()}
    while sum(quota.values()) > n:
        quota[min(quota, key=lambda s: (-quota[s], s))] -= 1
    for s in sorted(sizes, key=lambda s: (-((n * sizes[s] / total) % 1), s))[: n - sum(quota.values())]:
        quota[s] += 1
    return {s: min(q, sizes[s]) for s, q in quota.items()}


@pytest.mark.parametrize("n", [1, 5, 40, 333, 2000])
def test_largest_remainder(spark, n):
    rng = random.Random(n)
    rows = [(k, "hot" if k % 3 == 0 else f"s{rng.randrange(12)}" if k % 7 else "") for k in range(1000)]
    got = audit.choose_sample(spark.createDataFrame(rows, "id long, s string"), "s", "id", n, "x").collect()
    groups = defaultdict(list)
    for k, s in sorted(rows, key=lambda r: hashlib.sha256(f"x{r[0]}".encode()).hexdigest()):
        groups[s].append(k)
    want = loop_quotas({s: len(g) for s, g in groups.items()}, n)
    assert {(r.id, r.s) for r in got} == {(k, s) for s, g in groups.items() for k in g[: want[s]]}
    assert len(got) == min(n, 1000)


def test_sample_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, "a"), (1, "a"), (2, "b")], "id long, s string")
    assert audit.choose_sample(df, "s", "id", 5, "x").count() == 5
    assert audit.choose_sample(df, "s", "id", 3, "x").count() == 3
    assert audit.choose_sample(df.where("false"), "s", "id", 3, "x").count() == 0


def test_bootstrap_against_loops(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, 0.2, 0.5, 1.0]) for _ in range(150)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(900, None)], "qid long, rr double")
    got = {tuple(metrics.bootstrap(df.repartition(p), "rr", resamples=400, seed=7, block=20).first()) for p in (1, 7)}
    # the same draws, one block after the other
    blocks = -(-150 // 20)
    rows = defaultdict(list)
    hashed = df.where("rr is not null").selectExpr("cast(qid as string) key", f"cast(pmod(xxhash64(cast(qid as string)), {blocks}) as int) b", "rr")
    for r in sorted(hashed.collect()):
        rows[r.b].append(r.rr)
    sizes = [len(rows[b]) for b in range(blocks)]
    shares = np.array([metrics._shares(sizes, b, 400, 7) for b in range(blocks)])
    assert (shares.sum(axis=0) == 150).all()  # every resample has n draws
    means = []
    for r in range(400):
        total = 0.0
        for b in range(blocks):
            gen = np.random.Generator(np.random.Philox(key=[7, (1 << 63) + b]))
            drawn = []
            for a in range(0, r + 1, metrics.AT_ONCE):
                counts = shares[b][a : a + metrics.AT_ONCE]
                picks = gen.integers(0, sizes[b], int(counts.sum()))
                if r < a + metrics.AT_ONCE:
                    start = int(counts[: r - a].sum())
                    drawn = picks[start : start + counts[r - a]]
            total += sum(rows[b][i] for i in drawn)
        means.append(total / 150)
    means.sort()
    assert list(next(iter(got))) == [pytest.approx(means[10], abs=2e-6), pytest.approx(means[390], abs=2e-6)]
    assert len(got) == 1
    mean, error = float(np.mean(values)), float(np.std(values) / 150**0.5)
    low, high = next(iter(got))
    assert abs(low - (mean - 1.96 * error)) < error and abs(high - (mean + 1.96 * error)) < error
    assert tuple(metrics.bootstrap(df.where("false"), "rr").first()) == (0.0, 0.0)


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.9])
def test_near_words_lose_no_pair(spark, cutoff):
    rng = random.Random(3)
    base = ["supreme", "court", "pakistan", "islamabad", "mississippi", "aab", "é漢字", "x", "ab"]
    words = set(base)
    for w in base * 12:
        chars = list(w)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(chars))
            rng.choice([lambda: chars.insert(k, rng.choice("abcourt漢")), lambda: chars.__setitem__(k, rng.choice("sumpé")), lambda: len(chars) > 1 and chars.pop(k)])()
        words.add("".join(chars))
    df = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "word string")
    targets = spark.createDataFrame([(w,) for w in base] + [("court",), (None,)], "target string")
    got = {(r.word, r.target): r.ratio for r in similar.similar_words(df, targets, cutoff).collect()}
    assert got == {(w, t): SequenceMatcher(None, w, t).ratio() for w in words for t in base if SequenceMatcher(None, w, t).ratio() >= cutoff}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    close = {(r.word, r.target): r.distance for r in similar.close_words(df, targets, cutoff).collect()}
    assert close == {(w, t): edits(w, t) for w in words for t in base if 1 - edits(w, t) / max(len(w), len(t)) >= cutoff}
    plan = similar.candidates(df, targets, cutoff)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
