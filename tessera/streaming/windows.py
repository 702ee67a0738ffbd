"""Rates, quotas and event order: windows over batches, and the same rules on streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sliding_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """The number of a key's events in (t - seconds, t] at each event."""
    frame = Window.partitionBy(key).orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("us", micros(F.col(ts))).withColumn("in_window", F.count("*").over(frame)).drop("us")


def daily_quota(events: DataFrame, key: str, ts: str, order: str, limit: int) -> DataFrame:
    """Whether each event is among its key's first ``limit`` of the UTC day."""
    day = Window.partitionBy(key, F.to_date(ts)).orderBy(ts, order)
    return events.withColumn("admitted", F.row_number().over(day) <= limit)


def dedupe(events: DataFrame, key: list[str], ts: str, order: str) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(ts, order))).where("rn = 1").drop("rn")


def late(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Whether an event, in arrival order, is older than one that its key had before."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("late", F.coalesce(F.max(ts).over(before) > F.col(ts), F.lit(False)))


def wait_for_slot(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """How long each event would have to wait so that at most ``limit`` fall in a window: microseconds, 0 for none."""
    back = F.lag("us", limit).over(Window.partitionBy(key).orderBy("us", order))
    return events.withColumn("us", micros(F.col(ts))).withColumn("wait_us", F.greatest(F.coalesce(back + seconds * 1_000_000 - F.col("us"), F.lit(0)), F.lit(0))).drop("us")


class Sliding:
    """Admits an event when fewer than each limit were admitted in its window; refused ones leave no trace."""

    def __init__(self, limits: tuple[tuple[int, int], ...]):
        self.limits, self.times = limits, []

    def admit(self, us: int) -> bool:
        longest = max(seconds for _, seconds in self.limits) * 1_000_000
        self.times = [t for t in self.times if us - t < longest]
        ok = all(sum(us - t < seconds * 1_000_000 for t in self.times) < limit for limit, seconds in self.limits)
        if ok:
            self.times.append(us)
        return ok


    def advance(self, us: int) -> list:
        longest = max(seconds for _, seconds in self.limits) * 1_000_000
        self.times = [t for t in self.times if us - t < longest]
        return []

    def expires(self) -> int | None:
        return self.times[-1] + max(seconds for _, seconds in self.limits) * 1_000_000 if self.times else None


class Lockout:
    """Counts events in a window that starts with its first; at the limit the key is locked for a while."""

    def __init__(self, limit: int, window: int, lock: int):
        self.limit, self.window, self.lock = limit, window * 1_000_000, lock * 1_000_000
        self.count, self.ends, self.until = 0, 0, 0

    def admit(self, us: int) -> bool:
        if us < self.until:
            return False
        if us >= self.ends:
            self.count, self.ends = 0, us + self.window
        self.count += 1
        if self.count >= self.limit:
            self.until = us + self.lock
        return True


class Marker:
    """Marks an event as handled: the same event again is a duplicate as long as the mark lives. A failure takes the mark
    back, so that the next try is handled."""

    def __init__(self, ttl: int):
        self.ttl, self.until = ttl * 1_000_000, None

    def admit(self, us: int, failed: bool) -> bool:
        if self.until is not None and us < self.until:
            return False
        self.until = None if failed else us + self.ttl
        return True

    def advance(self, us: int) -> list:
        if self.until is not None and self.until <= us:
            self.until = None
        return []

    def expires(self) -> int | None:
        return self.until


class Limiter:
    """Calls of two classes over one window of ``period`` seconds with ``rate`` slots.

    A call of the foreground takes the next free slot. One of the background takes a slot only while ``reserve`` slots are left
    beside it, and waits behind what came before it in its class; a later foreground call overtakes it. A call that would
    wait longer than its class's budget is refused. A call with ``retry_after`` fails once: it used its slot, everybody
    pauses for so many seconds, and the call is tried once more within its budget. Calls arrive in order of time.
    """

    def __init__(self, rate: int, period: int, reserve: int, wait: int, background_wait: int):
        self.rate, self.period = max(rate, 1), period * 1_000_000
        self.spare = self.rate - max(0, min(reserve, self.rate - 1))
        self.wait, self.background_wait = wait * 1_000_000, background_wait * 1_000_000
        self.issued: list[int] = []  # the last ``rate`` times, ascending
        self.blocked = 0
        self.pending: list[tuple] = []  # background calls: (arrived, event, retry_after)

    def _slot(self, us: int, slots: int) -> int:
        """The earliest time from ``us`` at which so many slots are not all taken."""
        free = self.issued[-slots] + self.period if len(self.issued) >= slots else us
        return max(us, free, self.blocked, self.issued[-1] if self.issued else us)

    def _take(self, us: int) -> None:
        self.issued = [*self.issued, us][-self.rate :]

    def _call(self, event, arrived: int, retry_after, slots: int, budget: int) -> tuple:
        at, attempts = self._slot(arrived, slots), 0
        if at - arrived > budget:
            return event, "refused", None, attempts
        self._take(at)
        attempts += 1
        if retry_after:
            self.blocked = max(self.blocked, at + int(retry_after * 1_000_000))
            at = self._slot(at, slots)
            if at - arrived > budget:
                return event, "refused", None, attempts
            self._take(at)
            attempts += 1
        return event, "issued", at, attempts

    def advance(self, us: int | None) -> list[tuple]:
        """What becomes of background calls up to a time (None: all)."""
        out = []
        while self.pending:
            arrived, event, retry_after = self.pending[0]
            at = self._slot(arrived, self.spare)
            if us is not None and min(at, arrived + self.background_wait) >= us:
                break
            out.append(self._call(event, arrived, retry_after, self.spare, self.background_wait))
            self.pending.pop(0)
        return out

    def arrive(self, us: int, event, background: bool, retry_after) -> list[tuple]:
        out = self.advance(us)
        if background:
            self.pending.append((us, event, retry_after))
        else:
            out.append(self._call(event, us, retry_after, self.rate, self.wait))
        return out

    def expires(self) -> int | None:
        """When there is something to decide, or nothing left to know."""
        if self.pending:
            arrived = self.pending[0][0]
            return min(self._slot(arrived, self.spare), arrived + self.background_wait) + 1
        return max(self.issued[-1] + self.period, self.blocked) if self.issued else None


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _rows(events: DataFrame, key: str, ts: str, order: str, extra: dict[str, Column] | None = None) -> DataFrame:
    more = [c.alias(name) for name, c in (extra or {}).items()]
    return events.select(F.col(key).alias("key"), micros(F.col(ts)).alias("us"), F.col(order).alias("event"), *more)


def _per_key(events: DataFrame, key: str, ts: str, order: str, make, extra: dict[str, Column] | None = None) -> DataFrame:
    """Runs a rule over each key's events in order. Rows stream by sorted partition, so a key of any size needs
    only the rule's own state; a key is whole in one task, as its order requires."""
    names = list(extra or {})
    rows = _rows(events, key, ts, order, extra).repartition("key").sortWithinPartitions("key", "us", "event")

    def run(frames: Iterator) -> Iterator:
        now, rule = None, None
        for f in frames:
            out = []
            for k, us, *more in zip(f["key"], f["us"], *(f[n] for n in names), strict=True):
                if rule is None or k != now:
                    now, rule = k, make()
                out.append(rule.admit(int(us), *more))
            yield f.assign(admitted=out)[["key", "event", "admitted"]]

    return rows.mapInPandas(run, f"key {_kind(events, key)}, event {_kind(events, order)}, admitted boolean")


def _call_columns(background: str, retry_after: str | None) -> dict[str, Column]:
    return {"background": F.coalesce(F.col(background), F.lit(False)), "retry_after": F.coalesce(F.col(retry_after).cast("double"), F.lit(0.0)) if retry_after else F.lit(0.0)}


CALLS = "outcome string, issued timestamp, attempts int"


def _decided(key, rows: list[tuple]):
    import pandas as pd

    issued = pd.to_datetime([x[2] for x in rows], unit="us", utc=True)
    return pd.DataFrame({"key": pd.Series([key] * len(rows)), "event": [x[0] for x in rows], "outcome": [x[1] for x in rows], "issued": issued, "attempts": pd.Series([x[3] for x in rows], dtype="int32")})


def limited(calls: DataFrame, key: str, ts: str, order: str, background: str, retry_after: str | None, rate: int, period: int, reserve: int, wait: int, background_wait: int) -> DataFrame:
    """(key, event, outcome, issued, attempts): what a ``Limiter`` of each key makes of its calls."""
    rows = _rows(calls, key, ts, order, _call_columns(background, retry_after)).repartition("key").sortWithinPartitions("key", "us", "event")
    make = lambda: Limiter(rate, period, reserve, wait, background_wait)

    def run(frames: Iterator) -> Iterator:
        now, rule = None, None
        for f in frames:
            out, whose = [], []
            for k, us, event, back, retry in f.itertuples(index=False):
                if rule is None or k != now:
                    done = rule.advance(None) if rule else []
                    whose += [now] * len(done)
                    out += done
                    now, rule = k, make()
                done = rule.arrive(int(us), event, bool(back), retry)
                whose += [k] * len(done)
                out += done
            if out:
                yield _decided(None, out).assign(key=whose)
        if rule and (out := rule.advance(None)):
            yield _decided(now, out)

    return rows.mapInPandas(run, f"key {_kind(calls, key)}, event {_kind(calls, order)}, {CALLS}")


def marked(events: DataFrame, key: str, ts: str, order: str, failed: str, ttl: int) -> DataFrame:
    """(key, event, admitted): each event by its id (``key``) once in ``ttl`` seconds, and again after a failure."""
    return _per_key(events, key, ts, order, lambda: Marker(ttl), {"failed": F.coalesce(F.col(failed), F.lit(False))})


def replaced(events: DataFrame, subscription: str, current: str) -> DataFrame:
    """Events about a subscription that the user has replaced since; a missing one on either side replaces nothing."""
    known = F.coalesce(F.col(subscription) != "", F.lit(False)) & F.coalesce(F.col(current) != "", F.lit(False))
    return events.where(known & (F.col(subscription) != F.col(current)))


def sliding_admit(events: DataFrame, key: str, ts: str, order: str, limits: tuple[tuple[int, int], ...]) -> DataFrame:
    """(key, event, admitted) by exact sliding windows of several (limit, seconds)."""
    return _per_key(events, key, ts, order, lambda: Sliding(limits))


def lockout(events: DataFrame, key: str, ts: str, order: str, limit: int, window: int, lock: int) -> DataFrame:
    """(key, event, admitted) by windows from a first event, with a lock."""
    return _per_key(events, key, ts, order, lambda: Lockout(limit, window, lock))


def stream_dedupe(stream: DataFrame, key: str, ts: str, keep: str = "30 days") -> DataFrame:
    """Each event once, on a stream; keys are remembered as long as the watermark allows."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def stream_counts(stream: DataFrame, key: str, ts: str, size: str, late_by: str) -> DataFrame:
    """Counts by key and tumbling window, on a stream; later events than ``late_by`` are dropped."""
    return stream.withWatermark(ts, late_by).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def _stream_rule(stream: DataFrame, key: str, ts: str, order: str, late_by: str, make, step, out: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Runs a rule on a stream: ``step(rule, key, rows)`` gives a micro-batch's result rows, in order of time.

    A rule is a key's state. It is looked at again when the watermark passes what it says it expires at: what it still
    decides is given then, and a rule that has nothing left to know leaves the state. Rows later than ``late_by`` are
    dropped; a micro-batch's rows are taken in order, after those of the ones before it.
    """
    import pickle

    def run(k, frames, state):
        import pandas as pd

        rule = pickle.loads(state.get[0]) if state.exists else make()
        now = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            rows = rule.advance(now)
            if rows:
                yield _decided(k[0], rows)
        else:
            f = pd.concat(list(frames)).sort_values(["us", "event"])
            done = step(rule, k[0], f)
            if done is not None and len(done):
                yield done
        expires = rule.expires()
        if expires is None or (state.hasTimedOut and expires <= now):
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(rule),))
            state.setTimeoutTimestamp(max(-(-expires // 1000), now // 1000 + 1))

    more = [c.alias(name) for name, c in (extra or {}).items()]
    rows = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(order).alias("event"), *more).withWatermark("at", late_by)
    rows = rows.withColumn("us", micros(F.col("at")))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {_kind(stream, key)}, event {_kind(stream, order)}, {out}", "rule binary", "append", "EventTimeTimeout")


def _admit(*names: str):
    def step(rule, k, f):
        import pandas as pd

        return pd.DataFrame({"key": f["key"], "event": f["event"], "admitted": [rule.admit(int(us), *more) for us, *more in zip(f["us"], *(f[n] for n in names))]})

    return step


def stream_admit(stream: DataFrame, key: str, ts: str, order: str, limits: tuple[tuple[int, int], ...], late_by: str = "1 minute") -> DataFrame:
    """The sliding admission rule on a stream: the admitted times of each key are its state, and leave it when the
    longest window has passed."""
    return _stream_rule(stream, key, ts, order, late_by, lambda: Sliding(limits), _admit(), "admitted boolean")


def stream_marked(stream: DataFrame, key: str, ts: str, order: str, failed: str, ttl: int, late_by: str = "1 minute") -> DataFrame:
    """``marked`` on a stream: a mark is an event's state until it expires or is taken back."""
    return _stream_rule(stream, key, ts, order, late_by, lambda: Marker(ttl), _admit("failed"), "admitted boolean", {"failed": F.coalesce(F.col(failed), F.lit(False))})


def stream_limited(stream: DataFrame, key: str, ts: str, order: str, background: str, retry_after: str | None, rate: int, period: int, reserve: int, wait: int, background_wait: int, late_by: str = "1 minute") -> DataFrame:
    """``limited`` on a stream: a background call is decided by the calls that follow it, or by a timer when none do."""

    def step(rule, k, f):
        out = []
        for us, event, back, retry in zip(f["us"], f["event"], f["background"], f["retry_after"]):
            out += rule.arrive(int(us), event, bool(back), retry)
        return _decided(k, out) if out else None

    make = lambda: Limiter(rate, period, reserve, wait, background_wait)
    return _stream_rule(stream, key, ts, order, late_by, make, step, CALLS, _call_columns(background, retry_after))
