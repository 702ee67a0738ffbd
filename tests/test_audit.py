"""Stage figures against plain sorting, without a group held in one array."""

import random

from tessera.operators import audit


def test_stage_stats_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [("hot", float(r.randrange(400))) for _ in range(3000)] + [("few", v) for v in (3.0, 1.0, 1.0, None)] + [("none", None), (None, 5.0), (None, 7.0), (None, 9.0)]
    df = audit.stage_stats(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v")
    assert "collect_list" not in df._jdf.queryExecution().analyzed().toString()
    got = {x.k: (x.n, x.p50, x.p95, x.most) for x in df.collect()}
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(x for g, x in rows if g == k and x is not None)
        want[k] = (len(v), *[v[round(p * (len(v) - 1))] if v else None for p in (0.5, 0.95)], v[-1] if v else None)
    assert got == want
