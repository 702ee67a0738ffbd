"""Paging through ranked lists for many queries at once, scoring no more than what a page needs.

Scoring a candidate is the dear step (a cross-encoder, a reading of its texts), so it is left to a callback over the rows of
a slice, and a slice is scored only for those queries that still need one: the page isn't full, the request's budget isn't
spent, candidates are left, and relevance has not run out (some row of the last ``TAIL`` of the slice before passed). All
queries take a step together: a request is at most BUDGET / SLICE steps, each a few joins by query, whatever the number
of queries. What a step scored is written to the shared store, so it is scored once.

A session holds what is known of its queries: the ranked lists, how far they were scored, the order of what may be shown, the
verdicts of filtered pages, and what was shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import phrase_hits
from tessera.sources.store import kept

# Rows of a page and of all pages, of a slice, that a request scores (unfiltered, filtered), and the tail.
PAGE, MOST, SLICE, BUDGET, FILTER_BUDGET, TAIL = 10, 100, 10, 30, 40, 5
#: Rows of a category's first window.
CATEGORY_WINDOW = 30
_AT = "struct<slice:bigint,sort:double,position:bigint>"
Score = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Session:
    """ranked: (qid, id, position from 1, ...); state: (qid, n, scanned, tail_pass, n_shown); order: (qid, id, at), what may be
    shown, by ``at``; verdicts: (qid, id, passes) of filtered pages; shown: (qid, id)."""

    ranked: DataFrame
    state: DataFrame
    order: DataFrame
    verdicts: DataFrame
    shown: DataFrame


def by_relevance(cut: float, relevance: str = "relevance") -> Score:
    """Rows pass that are pinned or relevant enough."""
    return lambda rows: rows.withColumn("passes", F.coalesce(F.col("pinned") | (F.col(relevance) >= cut), F.lit(False))).withColumn("sort", F.lit(0.0))


def by_phrases(texts: DataFrame, phrases: list[str]) -> Score:
    """Rows pass whose text (id, text) has one of the phrases; within a slice those with the most distinct ones come first."""

    def score(rows: DataFrame) -> DataFrame:
        asked = rows.select("id").distinct()
        found = texts.join(asked, "id").select("id", F.size(phrase_hits(F.coalesce("text", F.lit("")), phrases)).alias("found"))
        hits = found.groupBy("id").agg(F.max("found").alias("found"))
        rows = rows.join(hits, "id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
        return rows.withColumn("passes", F.col("found") > 0).withColumn("sort", -F.col("found").cast("double")).drop("found")

    return score


def requiring(score: Score, allowed: Score) -> Score:
    """Of the rows that pass, those that ``allowed`` (a filter, such as ``gate.with_key_terms``) keeps."""

    def both(rows: DataFrame) -> DataFrame:
        scored = score(rows)
        kept_rows = allowed(scored.where("passes")).select("qid", "id").distinct().withColumn("held", F.lit(True))
        return scored.join(kept_rows, ["qid", "id"], "left").withColumn("passes", F.col("passes") & F.coalesce("held", F.lit(False))).drop("held")

    return both


def _at(slice_: Column, sort: Column, position: Column) -> Column:
    return F.struct(slice_.cast("long").alias("slice"), sort.cast("double").alias("sort"), position.cast("long").alias("position")).alias("at")


def _first(rows: DataFrame, n: Column | int, order: list) -> DataFrame:
    """The first n rows of each query, with their slot from 1."""
    slot = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return rows.withColumn("slot", slot.cast("long")).where(F.col("slot") <= n)


def _verdict(scored: DataFrame, size: int) -> DataFrame:
    """(qid, scored, tail): how many rows of a slice were scored, and whether one of its last rows passes."""
    last = scored.withColumn("behind", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("position"))))
    return last.groupBy("qid").agg(F.count("*").alias("scored"), F.coalesce(F.max(F.when(F.col("behind") <= TAIL, F.col("passes"))), F.lit(False)).alias("tail"))


def _known(rows: DataFrame, name: str) -> DataFrame:
    return kept(rows, f"paging-{name}")


def opened(ranked: DataFrame, score: Score, window: int = SLICE, page: int = PAGE) -> tuple[DataFrame, Session]:
    """The first page (qid, id, slot) of every query and its session: the first ``window`` rows are scored."""
    ranked = _known(ranked.withColumn("position", F.col("position").cast("long")), "ranked")
    scored = _known(score(ranked.where(F.col("position") <= window)).select("qid", "id", "position", "passes", "sort"), "slice")
    order = scored.where("passes").select("qid", "id", _at(F.lit(0), F.col("sort"), F.col("position")))
    rows = _known(_first(order, page, ["at"]).select("qid", "id", "slot"), "page")
    sizes = ranked.groupBy("qid").agg(F.count("*").alias("n"))
    state = sizes.join(_verdict(scored, window), "qid", "left").join(rows.groupBy("qid").agg(F.count("*").alias("n_shown")), "qid", "left")
    state = state.select("qid", "n", F.coalesce("scored", F.lit(0)).alias("scanned"), F.coalesce("tail", F.lit(False)).alias("tail_pass"), F.coalesce("n_shown", F.lit(0)).alias("n_shown"))
    verdicts = order.select("qid", "id", F.lit(True).alias("passes")).where("false")
    return rows, Session(ranked, _known(state, "state"), _known(order, "order"), _known(verdicts, "verdicts"), rows.select("qid", "id"))


def _room(state: DataFrame) -> DataFrame:
    return state.withColumn("size", F.greatest(F.least(F.lit(PAGE), F.lit(MOST) - F.col("n_shown")), F.lit(0)))


def _after(session: Session, page: DataFrame, state: DataFrame, order: DataFrame, verdicts: DataFrame) -> Session:
    """The session after a page was shown."""
    counted = state.join(page.groupBy("qid").agg(F.count("*").alias("new")), "qid", "left")
    state = counted.select("qid", "n", "scanned", "tail_pass", (F.col("n_shown") + F.coalesce("new", F.lit(0))).alias("n_shown"))
    shown = session.shown.unionByName(page.select("qid", "id"))
    return replace(session, state=_known(state, "state"), order=order, verdicts=verdicts, shown=_known(shown, "shown"))


def next_page(session: Session, score: Score, listed: Score | None = None) -> tuple[DataFrame, Session]:
    """The next page (qid, id, slot) of every query, and its session. ``listed``: a filter on what is waiting already."""
    state, order = session.state, session.order
    unseen = order.join(session.shown, ["qid", "id"], "left_anti")
    unseen = listed(unseen) if listed else unseen
    waiting = _known(_first(unseen.join(_room(state).select("qid", "size"), "qid"), F.col("size"), ["at"]).select("qid", "id", "at"), "waiting")
    for _ in range(BUDGET // SLICE):
        have = waiting.groupBy("qid").agg(F.count("*").alias("have"))
        open_ = _room(state).join(have, "qid", "left").where("coalesce(have, 0) < size and tail_pass and scanned < n").select("qid", "scanned")
        batch = session.ranked.join(open_, "qid").where(F.col("position").between(F.col("scanned") + 1, F.col("scanned") + SLICE))
        scored = _known(score(batch.drop("scanned")).select("qid", "id", "position", "passes", "sort"), "slice")
        if scored.isEmpty():
            break
        verdict = _verdict(scored, SLICE)
        moved = state.join(verdict, "qid", "left")
        state = _known(moved.select("qid", "n", (F.col("scanned") + F.coalesce("scored", F.lit(0))).alias("scanned"), F.coalesce("tail", "tail_pass").alias("tail_pass"), "n_shown"), "state")
        passing = scored.where("passes").select("qid", "id", _at(F.ceil(F.col("position") / SLICE), F.col("sort"), F.col("position")))
        passing = _known(passing.join(order, ["qid", "id"], "left_anti"), "passing")
        order = order.unionByName(passing)
        new = passing.join(session.shown, ["qid", "id"], "left_anti")
        waiting = _known(_first(waiting.unionByName(new).join(_room(state).select("qid", "size"), "qid"), F.col("size"), ["at"]).select("qid", "id", "at"), "waiting")
    page = _known(_first(waiting, PAGE, ["at"]).select("qid", "id", "slot"), "page")
    return page, _after(session, page, state, _known(order, "order"), session.verdicts)


def filtered_page(session: Session, allowed: DataFrame, score: Score) -> tuple[DataFrame, DataFrame, Session]:
    """The next page (qid, id, slot) of each query among the allowed rows (qid, id), whether there may be more (qid, more), and
    the session. Verdicts don't depend on the filter and are kept for every other one; a slice in which nothing passes ends
    the search."""
    state, verdicts = _room(session.state), session.verdicts
    mine = _known(session.ranked.join(allowed.select("qid", "id").distinct(), ["qid", "id"], "left_semi").join(session.state.select("qid", "scanned"), "qid"), "allowed")
    ready = mine.join(session.order, ["qid", "id"]).select("qid", "id", F.col("at"))
    pending = mine.where("position > scanned").join(session.order, ["qid", "id"], "left_anti").drop("scanned")

    def unseen(verdicts: DataFrame) -> DataFrame:
        passed = mine.join(verdicts.where("passes"), ["qid", "id"]).join(session.order, ["qid", "id"], "left_anti")
        later = passed.select("qid", "id", _at(F.lit(1 << 40), F.lit(0.0), F.col("position")))
        return ready.unionByName(later).join(session.shown, ["qid", "id"], "left_anti")

    done = session.state.select("qid").where("false")
    for _ in range(FILTER_BUDGET // SLICE):
        have = unseen(verdicts).groupBy("qid").agg(F.count("*").alias("have"))
        open_ = state.join(have, "qid", "left").where("coalesce(have, 0) < size").join(done, "qid", "left_anti").select("qid")
        left = pending.join(verdicts, ["qid", "id"], "left_anti").join(open_, "qid", "left_semi")
        batch = _first(left, SLICE, ["position"]).drop("slot")
        scored = _known(score(batch).select("qid", "id", "passes"), "slice")
        if scored.isEmpty():
            break
        verdicts = _known(verdicts.unionByName(scored), "verdicts")
        done = _known(done.unionByName(scored.groupBy("qid").agg(F.max("passes").alias("any")).where("not any").select("qid")), "done")
    ranked = unseen(verdicts).join(state.select("qid", "size", "n_shown"), "qid")
    page = _known(_first(ranked, F.col("size"), ["at"]).select("qid", "id", "slot"), "page")
    counts = [rows.groupBy("qid").agg(F.count("*").alias(name)) for rows, name in ((ranked, "unseen"), (page, "new"), (pending.join(verdicts, ["qid", "id"], "left_anti").join(done, "qid", "left_anti"), "pending"))]
    more = state
    for c in counts:
        more = more.join(c, "qid", "left")
    more = more.fillna(0, ["unseen", "new", "pending"])
    more = more.select("qid", ((F.col("size") > 0) & ((F.col("unseen") > F.col("new")) | (F.col("pending") > 0)) & (F.col("n_shown") + F.col("new") < MOST)).alias("more"))
    return page, _known(more, "more"), _after(session, page, session.state, session.order, verdicts)


def has_more(session: Session) -> DataFrame:
    """(qid, more): something waits to be shown, or relevance reaches the end of what was scored and more is left."""
    waiting = session.order.join(session.shown, ["qid", "id"], "left_anti").groupBy("qid").agg(F.count("*").alias("waiting"))
    rows = session.state.join(waiting, "qid", "left")
    return rows.select("qid", ((F.col("n_shown") < MOST) & ((F.coalesce("waiting", F.lit(0)) > 0) | (F.col("tail_pass") & (F.col("scanned") < F.col("n"))))).alias("more"))
