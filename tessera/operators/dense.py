"""Exact vector search: every query meets every vector, and only rows that may be among the results leave the tasks.

Vectors are dealt by a hash into parts of about ``VECTORS`` rows, queries into blocks of about ``QUERIES``; each part meets each
block in one cogroup, whose scores are built for a few queries at a time. Of these scores the first of each query and
group are kept (``leading``), so what is shuffled are vectors, queries and candidates, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tessera.operators.lexical import top

VECTORS, QUERIES = 4096, 2048
#: Pairs whose scores a task holds at once.
PAIRS = 1 << 17
#: From so many rows of a group on they are found by sorting.
SORTED = 9


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half up on the shortest decimals, as Spark rounds."""
    big = x * 10.0**digits
    out = np.rint(big) / 10.0**digits + 0.0
    for at in zip(*np.nonzero(~(np.abs(big - np.floor(big) - 0.5) > 1e-5) | ~(np.abs(x) < 1e9))):
        v = float(x[at])
        out[at] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(v) < 1e15 else v
    return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The length of each list, -1 for null and for lists with nulls, and the rows of each length as a matrix by length."""
    column = column.combine_chunks()
    length = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    flat, parents = pc.list_flatten(column), np.asarray(pc.list_parent_indices(column))
    if flat.null_count:
        length[parents[np.asarray(pc.is_null(flat))]] = -1
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0))
    return length, {n: values[(length == n)[parents]].reshape(-1, n) for n in np.unique(length[length >= 0]).tolist()}


def pair_scores(asked: pa.ChunkedArray, held: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, scores, known) for a few queries at a time: inner products summed in the order of the dimensions; lists of
    unlike lengths, nulls and lists with nulls have no score."""
    nq, q = _lists(asked)
    nv, v = _lists(held)
    v = {n: np.ascontiguousarray(m.T) for n, m in v.items()}
    place = np.zeros(len(nq), np.int64)
    for n in q:
        place[nq == n] = np.arange((nq == n).sum())
    step = max(1, PAIRS // max(1, len(nv)))
    for at in range(0, len(nq), step):
        some = nq[at : at + step]
        score, known = np.zeros((len(some), len(nv))), np.zeros((len(some), len(nv)), bool)
        for n in set(some.tolist()) & set(v):
            rows, columns = some == n, nv == n
            part, x = np.zeros((rows.sum(), columns.sum())), q[n][place[at : at + step][rows]]
            for d in range(n):
                part += x[:, d, None] * v[n][d]
            if rows.all() and columns.all():
                score, known = rounded(part), ~known
            else:
                score[np.ix_(rows, columns)], known[np.ix_(rows, columns)] = rounded(part), True
        yield at, score, known


def _first(key: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Marks the ``most`` greatest keys of each row and stretch of columns; of equal ones the foremost; -inf is none."""
    if len(starts) == 1 and most >= SORTED:
        out = np.zeros(key.shape, bool)
        np.put_along_axis(out, np.argsort(-key, axis=1, kind="stable")[:, :most], True, axis=1)
        return out & (key > -np.inf)
    key, out = key.copy(), np.zeros(key.shape, bool)
    stretch = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, key.shape[1])))
    places = np.arange(key.shape[1])
    for _ in range(min(most, key.shape[1])):
        best = np.maximum.reduceat(key, starts, axis=1)
        at = np.minimum.reduceat(np.where(key == best[:, stretch], places, key.shape[1]), starts, axis=1)
        rows, groups = np.nonzero(best > -np.inf)
        if not len(rows):
            break
        out[rows, at[rows, groups]] = True
        key[rows, at[rows, groups]] = -np.inf
    return out


def _codes(table: pa.Table, columns: list[str]) -> np.ndarray:
    out = np.zeros(table.num_rows, np.int64)
    for c in columns:
        coded = table.column(c).combine_chunks().dictionary_encode("encode")
        out = np.unique(out * (len(coded.dictionary) + 1) + np.asarray(coded.indices), return_inverse=True)[1]
    return out


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _leading(by: list[str], group: list[str], most: int, node: list[str], liked: str | None, names: list[str], schema: pa.Schema):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return schema.empty_table()
        held = held.take(pc.sort_indices(held, sort_keys=[("id", "ascending")], null_placement="at_start"))
        groups = _codes(held, group)
        nodes = _codes(held, [*group, *node])
        order = np.lexsort((np.arange(held.num_rows), nodes, groups))
        held, of_group, of_node = held.take(pa.array(order)), _starts(groups[order]), _starts(nodes[order])
        mark = np.asarray(pc.fill_null(held.column(liked), False)) if liked else None
        found = [[], [], [], [], []]
        for at, score, known in pair_scores(asked.column("q"), held.column("v")):
            # no score is last, no number first, as Spark sorts
            key = np.clip(np.where(known, np.where(np.isnan(score), np.inf, score), -np.inf), np.finfo(float).min, np.finfo(float).max)
            if node:
                first = _first(key, of_node, 1)
                sides = [np.where(first, key, -np.inf), np.where(first, -np.inf, key)]
                chosen = _first(sides[0], of_group, most) | _first(sides[1], of_group, most)
                if liked:
                    chosen |= _first(np.where(mark, sides[0], -np.inf), of_group, 1) | _first(np.where(mark, sides[1], -np.inf), of_group, 1)
            else:
                chosen = _first(key, of_group, most)
            rows, columns = np.nonzero(chosen)
            more = (rows + at, columns, score[rows, columns], known[rows, columns], ~first[rows, columns] if node else np.zeros(0, bool))
            for a, b in zip(found, more):
                a.append(b)
        rows, columns, score, known, repeat = (np.concatenate(x) for x in found)
        asked, held = asked.take(pa.array(rows)), held.take(pa.array(columns))
        out = [asked.column(c) for c in by] + [held.column(c) for c in names] + [pa.array(score, mask=~known)] + ([pa.array(repeat)] if node else [])
        return pa.table([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=schema.names).cast(schema)

    return run


def leading(queries: DataFrame, vectors: DataFrame, by: list[str], group: list[str], most: int, node: list[str] | None = None, liked: str | None = None, whole: bool = False) -> DataFrame:
    """(by, columns of the vectors but v, score): the rows that may be among the first ``most`` of each query (``by``, q) and group of
    vectors (id, v, ...) by (score, id): the first of each part. ``whole``: groups aren't split over parts, so these are the result.

    With ``node`` there is a column ``repeat``, whether a group's node has a better row; kept are the first ``most`` rows that are
    no repeats, the first ``most`` repeats, and the best of either that are ``liked``. Nodes aren't split.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    node = node or []
    parts, blocks = max(1, -(-vectors.count() // VECTORS)), max(1, -(-queries.count() // QUERIES))
    dealt = node or (group if whole else [])
    rest = [c for c in vectors.columns if c != "v"]
    fields = [queries.schema[c] for c in by] + [vectors.schema[c] for c in rest] + [StructField("score", DoubleType())] + ([StructField("repeat", BooleanType())] if node else [])
    schema = StructType(fields)
    deal = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cut = lambda df: df.repartition(parts * blocks, "part", "block").groupBy("part", "block")
    held = vectors.withColumn("part", deal(dealt or ["id", "v"], parts)).withColumn("block", every(blocks))
    asked = queries.select(*by, "q").withColumn("block", deal([*by, "q"], blocks)).withColumn("part", every(parts))
    run = _leading(by, group, most, node, liked, rest, to_arrow_schema(schema))
    return cut(held).cogroup(cut(asked)).applyInArrow(run, schema)


def topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query by (score, id)."""
    return top(leading(queries, vectors, ["qid"], [], k), k, ["qid"], [F.desc("score"), F.asc("id")])


def multi_phrasing(phrasings: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Each phrasing (qid, phrase, q) gives its k nearest; a query's k best by the greatest score of each vector."""
    each = top(leading(phrasings, vectors, ["qid", "phrase"], [], k), k, ["qid", "phrase"], [F.desc("score"), F.asc("id")])
    merged = each.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return top(merged, k, ["qid"], [F.desc("score"), F.asc("id")])


def group_max(scored: DataFrame, group: str, floor: float, k: int) -> DataFrame:
    """(qid, group, score, rank): groups by their best row, above a floor, the best k."""
    best = scored.groupBy("qid", group).agg(F.max("score").alias("score")).where(F.col("score") >= floor)
    return top(best, k, ["qid"], [F.desc("score"), F.asc(group)])


def within_group(scored: DataFrame, group: str, k: int) -> DataFrame:
    """The k best rows of each query and group."""
    return top(scored, k, ["qid", group], [F.desc("score"), F.asc("id")])


def pool_size(n: int, share: float = 0.05, least: int = 200, most: int = 1500) -> int:
    """How many candidates to take of n: a share of them, within bounds."""
    return min(max(int(n * share), least), most)


def best_preferred(scored: DataFrame, by: list[str], preferred: Column) -> DataFrame:
    """One row for each group: preferred rows first, then the best score, then the id."""
    ranked = scored.withColumn("preferred", preferred).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("preferred"), F.desc("score"), F.asc("id"))))
    return ranked.where("rank = 1").drop("rank")


def adaptive_topk(queries: DataFrame, vectors: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """Nearest vectors of each query, as many as the pool size of the table allows."""
    return topk(queries, vectors, pool_size(vectors.count(), share, least, most))


def top_up(scored: DataFrame, need: int, have: int = 2) -> DataFrame:
    """Up to ``need`` more chunks of each query's document beside its best ``have``: of nodes not seen yet first, then any, by score.
    scored: (qid, doc, node, id, score, repeat). A node's best row is the first to be had, so a row left of a seen node is a repeat."""
    best = Window.partitionBy("qid", "doc").orderBy(F.desc("score"), F.asc("id"))
    fresh = scored.withColumn("at", F.row_number().over(best)).where(F.col("at") > have).drop("at")
    return top(fresh, need, ["qid", "doc"], [F.asc("repeat"), F.desc("score"), F.asc("id")]).drop("repeat")
