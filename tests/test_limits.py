"""The limiter and the event markers: rules against plain loops, streams against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import windows

SECOND = 1_000_000
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def loop(calls, rate, period, reserve, wait, background_wait):
    """Second by second: who may go at each second goes, the foreground first; times are whole seconds."""
    spare = rate - max(0, min(reserve, rate - 1))
    out, issued, blocked = {}, [], 0
    queues = {False: [], True: []}
    todo = sorted(calls)
    second = 0
    while todo or queues[False] or queues[True]:
        while todo and todo[0][0] == second:
            queues[todo[0][2]].append([*todo.pop(0), 0])
        for background in (False, True):
            budget, slots = (background_wait, spare) if background else (wait, rate)
            while queues[background]:
                call = queues[background][0]
                at, event, _, retry, attempts = call
                if second - at > budget:
                    out[event] = ("refused", None, attempts)
                elif second >= blocked and sum(second - period < i <= second for i in issued) < slots:
                    issued.append(second)
                    if retry and not attempts:
                        blocked = max(blocked, second + retry)
                        call[4] = 1
                        continue
                    out[event] = ("issued", second, attempts + 1)
                else:
                    break
                queues[background].pop(0)
        second += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(u, START + dt.timedelta(seconds=s), e, b, r) for u, s, e, b, r in rows], "user long, ts timestamp, event long, background boolean, again int")


def calls(seed, users=3, n=60, background=0.5, retry=True):
    rng = random.Random(seed)
    rows, event = [], 0
    for u in range(users):
        for s in sorted(rng.sample(range(400), n)):
            rows.append((u, s, event, rng.random() < background, rng.choice([None, None, None, 20]) if retry else None))
            event += 1
    return rows


def decisions(df):
    return {r.event: (r.outcome, None if r.issued is None else int((r.issued.replace(tzinfo=dt.timezone.utc) - START).total_seconds()), r.attempts) for r in df.collect()}


@pytest.mark.parametrize(("background", "retry"), [(0.0, False), (0.0, True), (1.0, False), (1.0, True)])
def test_limiter_of_one_class_against_loops(spark, background, retry):
    rows = calls(3, background=background, retry=retry)
    got = decisions(windows.limited(frame(spark, rows).repartition(4), "user", "ts", "event", "background", "again", 4, 60, 1, 25, 45))
    want = {}
    for u in range(3):
        want |= loop([(s, e, b, r) for x, s, e, b, r in rows if x == u], 4, 60, 1, 25, 45)
    assert got == want
    assert {x[0] for x in got.values()} == {"issued", "refused"}


def test_limiter_of_two_classes(spark):
    rows = calls(5, retry=False)
    got = decisions(windows.limited(frame(spark, rows), "user", "ts", "event", "background", "again", 4, 60, 1, 25, 45))
    assert len(got) == len(rows)
    for u in range(3):
        mine = [(s, e, b) for x, s, e, b, _ in rows if x == u]
        times = sorted((got[e][1], b) for s, e, b in mine if got[e][0] == "issued")
        for k, (at, b) in enumerate(times):
            before = sum(at - 60 < x <= at for x, _ in times[: k + 1])
            assert before <= 4 and (not b or before <= 3)
        for s, e, b in mine:
            outcome, at, _ = got[e]
            assert outcome == "refused" or 0 <= at - s <= (45 if b else 25)
        order = [got[e][1] for s, e, b in mine if b and got[e][0] == "issued"]
        assert order == sorted(order)
    # with a reserve the foreground is refused less often than without
    refused = lambda reserve: sum(v[0] == "refused" for e, v in decisions(windows.limited(frame(spark, rows), "user", "ts", "event", "background", "again", 4, 60, reserve, 25, 45)).items() if not rows[e][3])
    assert refused(3) < refused(0)


def streamed(spark, tmp_path, df, name, make, order="ts"):
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // 4)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    return spark.table(name), progress


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = calls(7)
    df = frame(spark, rows)
    args = ("user", "ts", "event", "background", "again", 4, 60, 1, 25, 45)
    # a call far behind the others lets the watermark pass all that waits
    late = frame(spark, [(9, 100_000, 9_000, False, None), (9, 200_000, 9_001, False, None)])
    out, progress = streamed(spark, tmp_path, df.unionByName(late), "limited", lambda s: windows.stream_limited(s, *args))
    got = {e: x for e, x in decisions(out).items() if e < 9_000}
    assert got == decisions(windows.limited(df, *args))
    assert out.count() == len(rows) + 2
    assert progress.stateOperators[0].numRowsTotal <= 1  # the users' rules have left the state


def marks():
    rng = random.Random(2)
    return [(f"e{rng.randrange(12)}", s, s, rng.random() < 0.3) for s in sorted(rng.sample(range(5_000), 300))] + [("only", 10, 7_000, True), ("only", 11, 7_001, None), ("only", 12, 7_002, False)]


def test_markers(spark, tmp_path):
    rows = marks()
    df = spark.createDataFrame([(m, START + dt.timedelta(seconds=s), e, f) for m, s, e, f in rows], "id string, ts timestamp, event long, failed boolean")
    until, want = {}, {}
    for m, s, e, failed in sorted(rows, key=lambda r: (r[1], r[2])):
        want[e] = until.get(m, 0) <= s
        if want[e]:
            until[m] = 0 if failed else s + 600
    batch = windows.marked(df.repartition(3), "id", "ts", "event", "failed", 600)
    assert {r.event: r.admitted for r in batch.collect()} == want
    assert want[7_000] and want[7_001] and not want[7_002]
    far = spark.createDataFrame([("far", START + dt.timedelta(days=d), 9_000 + d, False) for d in (9, 10)], df.schema)
    out, progress = streamed(spark, tmp_path, df.unionByName(far), "marked", lambda s: windows.stream_marked(s, "id", "ts", "event", "failed", 600))
    assert {r.event: r.admitted for r in out.collect() if r.event < 9_000} == want
    assert progress.stateOperators[0].numRowsTotal <= 1  # expired marks are forgotten


def test_replaced(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, None, "b"), (4, "a", None), (5, "", "b"), (6, "a", "")], "id long, sub string, own string")
    assert [r.id for r in windows.replaced(df, "sub", "own").collect()] == [1]
