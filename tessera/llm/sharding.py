"""Resharding of a stored table by a minimum-cost flow.

A sharded table is a folder of Parquet files and a manifest (file, shard, rows, bytes). ``reshard`` takes the
old shards' sizes as supplies and the new shards' capacities as demands, and solves the transport
problem in which a byte that stays costs nothing and a byte that moves costs one (or what ``cost`` says):
no placement of these capacities moves fewer bytes. The flow from shard i to shard j is then a
stretch of shard i's bytes, taken in the order of its files and their rows: what stays comes first, so the moved
blocks are whole files but for those in which a stretch begins or ends. Only files with moved rows are
rewritten; the others are taken over by the new manifest where they lie.

Law: ``bytes``. A document that lies across a bound goes to the side that is then nearer to its capacity, so
a shard differs from its capacity by about one document of those at its bounds.

The driver holds sizes alone: of shards, of files (Spark's own listing holds as many) and of one
document a bound. Texts are written and read by tasks, never shuffled: each task deals its rows out to
the files of their shards. Only the files in which a bound lies are sorted, by row number and within a
file. Files are written by Spark's committer, so those of lost tasks never count, and a reshard that fails leaves the
old manifest and files as they were.

Defined cases: a null text has one byte, as an empty one (bytes of the text plus one); a null id is dealt by the hash
of null; repeated rows and equal ids are rows like others; other columns are kept whatever their names are (the
operator's own are renamed around them); one very long document stays whole, however large its shard becomes; an
empty table gives empty shards and no files.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import inner_name, shared_dir

SHARDS = 8
#: Shards of a table that is laid out for the first time.
OLD_SHARDS = 5
#: Rows of a file table that may be broadcast (a path of the folder, and numbers).
BROADCAST_FILES = 200_000


def min_cost_flow(supplies: list[int], capacities: list[int], cost) -> dict[tuple[int, int], int]:
    """The flow {(i, j): amount} that ships all supplies within the capacities at least cost: successive shortest
    paths with potentials over the bipartite graph. ``cost(i, j)`` is not negative."""
    n, m = len(supplies), len(capacities)
    if sum(supplies) > sum(capacities):
        raise ValueError("the capacities hold less than the supplies")
    left, room = list(supplies), list(capacities)
    flow: dict[tuple[int, int], int] = {}
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    potential = [0] * (n + m)
    while any(left):
        # shortest ways, by reduced costs, from all sources with something left; nodes n.. are the new shards
        far: list[float] = [float("inf")] * (n + m)
        before: list[int | None] = [None] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            if v < n:
                steps = ((n + j, price[v][j]) for j in range(m))
            else:
                steps = ((i, -price[i][v - n]) for i in range(n) if flow.get((i, v - n), 0))
            for w, c in steps:
                reached = d + c + potential[v] - potential[w]
                if reached < far[w]:
                    far[w], before[w] = reached, v
                    heapq.heappush(heap, (reached, w))
        ends = [n + j for j in range(m) if room[j] and far[n + j] < float("inf")]
        end = min(ends, key=lambda w: far[w] + potential[w])
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far)]
        way = [end]
        while before[way[-1]] is not None:
            way.append(before[way[-1]])
        way.reverse()
        amount = min([left[way[0]], room[end - n]] + [flow[b, a - n] for a, b in zip(way, way[1:]) if a >= n])
        for a, b in zip(way, way[1:]):
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount
        left[way[0]] -= amount
        room[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def moved(i: int, j: int) -> int:
    return int(i != j)


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass(frozen=True)
class File:
    path: str
    shard: int
    rows: int
    size: int


@dataclass
class Sharded:
    """A sharded table: its files, and the names of the two columns that they have beside the table's own."""

    spark: SparkSession
    files: list[File]
    schema: object
    size: str
    rewritten: int = 0
    moved_bytes: int = 0

    def sizes(self, shards: int) -> list[int]:
        out = [0] * shards
        for f in self.files:
            out[f.shard] += f.size
        return out

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        """A table about files, to be joined to their rows."""
        table = self.spark.createDataFrame(rows, schema)
        return F.broadcast(table) if len(rows) <= BROADCAST_FILES else table

    def read(self, files: list[File] | None = None) -> tuple[DataFrame, str, str]:
        """(rows, path column, row column): the rows of the files with their file's path and their place in it."""
        files = self.files if files is None else files
        if not files:
            frame = self.spark.createDataFrame([], self.schema)
            path, row = inner_name(frame, "file"), inner_name(frame, "row")
            return frame.withColumn(path, F.lit("")).withColumn(row, F.lit(0).cast("long")), path, row
        frame = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f.path for f in files))
        path, row = inner_name(frame, "file"), inner_name(frame, "row")
        # the folder's name and the file's are unique: both are drawn anew for each write
        return frame.select("*", tail(F.col("_metadata.file_path")).alias(path), F.col("_metadata.row_index").alias(row)), path, row

    def placed(self) -> tuple[DataFrame, str, str]:
        """(rows, shard column, slot column): slots number a shard's rows without gaps from 0."""
        frame, path, row = self.read()
        taken: dict[int, int] = {}
        places = []
        for f in sorted(self.files, key=lambda f: f.path):
            places.append((tail_of(f.path), f.shard, taken.get(f.shard, 0)))
            taken[f.shard] = taken.get(f.shard, 0) + f.rows
        shard, slot = inner_name(frame, "shard"), inner_name(frame, "slot")
        first = inner_name(frame, "first_slot")
        joined = frame.join(self._table(places, f"`{path}` string, `{shard}` int, `{first}` long"), path)
        return joined.withColumn(slot, F.col(f"`{first}`") + F.col(f"`{row}`")).drop(path, row, first), shard, slot


def tail(path):
    """The last three parts of a path: the write's folder, the shard's and the file."""
    return F.substring_index(path, "/", -3)


def tail_of(path: str) -> str:
    return "/".join(path.split("/")[-3:])


def _write(spark: SparkSession, frame: DataFrame, shard: str, size: str, name: str) -> list[File]:
    """Writes rows by the shard they are dealt to, and returns the files with rows and bytes."""
    folder = shared_dir(spark, name)
    frame.write.partitionBy(shard).parquet(folder)
    stored = spark.read.schema(frame.select(f"`{size}`").schema).option("recursiveFileLookup", "true").parquet(folder)
    counted = stored.groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n"), F.sum(f"`{size}`").alias("s"))
    return [File(f"{folder}/{'/'.join(p.split('/')[-2:])}", int(p.split("/")[-2].rpartition("=")[2]), n, s) for p, n, s in counted.toLocalIterator()]


def _spread(values: DataFrame, shards: int, id_column: str):
    return F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(shards)).cast("int")


def laid_out(documents: DataFrame, shards: int = OLD_SHARDS, id_column: str = "doc_id", text_column: str = "text") -> Sharded:
    """Writes a table as shards for the first time, by the hash of the id: every task writes its own rows."""
    spark = documents.sparkSession
    size, shard = inner_name(documents, "size"), inner_name(documents, "shard")
    sized = documents.withColumn(size, F.coalesce(F.octet_length(F.col(f"`{text_column}`").cast("string")), F.lit(0)).cast("long") + 1)
    return Sharded(spark, _write(spark, sized.withColumn(shard, _spread(sized, shards, id_column)), shard, size, "shards"), sized.schema, size)


def _bounds(table: Sharded, cuts: list[tuple[str, int]]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """For each (file, byte of its rows): the row in which it lies, and where this row starts and ends. One row a cut."""
    wanted = {path for path, _ in cuts}
    frame, path, row = table.read([f for f in table.files if f.path in wanted])
    size = table.size
    rows = frame.select(F.col(f"`{path}`").alias("f"), F.col(f"`{row}`").alias("r"), F.col(f"`{size}`").alias("n"))
    rows = rows.withColumn("stop", F.sum("n").over(Window.partitionBy("f").orderBy("r"))).withColumn("start", F.col("stop") - F.col("n"))
    asked = table._table([(tail_of(p), c) for p, c in cuts], "f string, cut long")
    found = rows.join(asked, "f").where("start <= cut and cut < stop").select("f", "cut", "r", "start", "stop").collect()
    full = {tail_of(p): p for p in wanted}
    return {(full[x["f"]], x["cut"]): (x["r"], x["start"], x["stop"]) for x in found}


def reshard(table: Sharded, shards: int = SHARDS, capacities: list[int] | None = None, cost=moved) -> Sharded:
    """The table in new shards of these capacities (bytes; even ones by default), with the fewest bytes moved."""
    old = max([f.shard for f in table.files], default=-1) + 1
    supplies = table.sizes(old)
    capacities = even(sum(supplies), shards) if capacities is None else capacities
    flow = min_cost_flow(supplies, capacities, cost)
    # each old shard's bytes, cut into stretches: what stays, then what goes to each new shard
    stretches = {i: sorted(((j, n) for (k, j), n in flow.items() if k == i), key=lambda x: (x[0] != i, x[0])) for i in range(old)}
    plan: dict[str, list[tuple[int, int]]] = {}  # file: (byte from which, new shard), ascending
    for i in range(old):
        start, ends, reached = 0, [], 0
        for j, n in stretches[i]:
            reached += n
            ends.append((reached, j))
        for f in sorted((f for f in table.files if f.shard == i), key=lambda f: f.path):
            at = [(max(end - n - start, 0), j) for (end, j), (_, n) in zip(ends, stretches[i]) if end > start and end - n < start + f.size]
            plan[f.path] = at
            start += f.size
    cuts = [(path, at) for path, parts in plan.items() for at, _ in parts[1:]]
    found = _bounds(table, cuts) if cuts else {}
    load = [sum(n for (_, j), n in flow.items() if j == k) for k in range(len(capacities))]
    by_file = {f.path: f for f in table.files}
    # the rows across which a cut lies, the largest first: each goes whole to the side with the most room
    rows_from: dict[str, list[tuple[int, int]]] = {}
    crossing = sorted({(stop - start, path, row, start) for (path, _), (row, start, stop) in found.items()}, reverse=True)
    chosen: dict[tuple[str, int], int] = {}
    for size, path, row, start in crossing:
        parts = [*plan[path], (by_file[path].size, -1)]
        shares = [(j, min(b, start + size) - max(a, start)) for (a, j), (b, _) in zip(parts, parts[1:])]
        shares = [(j, n) for j, n in shares if n > 0]
        for j, n in shares:
            load[j] -= n
        best = min((j for j, _ in shares), key=lambda j: (load[j] - capacities[j], j))
        load[best] += size
        chosen[path, row] = best
    for path, parts in plan.items():
        marks = [(0, parts[0][1])]
        for (_, before), (at, j) in zip(parts, parts[1:]):
            row, start, _ = found[path, at]
            whole = chosen[path, row]
            # rows before the crossing one belong to the stretch before, the row to the chosen one, later rows to the stretch after
            marks += [(row, whole), (row + 1, j)]
        final: dict[int, int] = {}
        for row, j in marks:
            final[row] = j  # of several cuts in one row, the last gives what follows it
        rows_from[path] = _runs(sorted(final.items()), by_file[path].rows)
    keep = [f for f in table.files if rows_from[f.path] == [(0, f.shard)]]
    away = [f for f in table.files if rows_from[f.path] != [(0, f.shard)]]
    new: list[File] = []
    if away:
        frame, path, row = table.read(away)
        shard = inner_name(frame, "shard")
        begin, end = inner_name(frame, "begin_row"), inner_name(frame, "end_row")
        steps = [(tail_of(f.path), a, b, j) for f in away for (a, j), (b, _) in zip(rows_from[f.path], [*rows_from[f.path][1:], (f.rows, -1)])]
        moves = table._table(steps, f"`{path}` string, `{begin}` long, `{end}` long, `{shard}` int")
        dealt = frame.join(moves, path).where(F.col(f"`{row}`").between(F.col(f"`{begin}`"), F.col(f"`{end}`") - 1)).drop(path, row, begin, end)
        new = _write(table.spark, dealt, shard, table.size, "reshard")
    return Sharded(table.spark, keep + new, table.schema, table.size, len(away), sum(n for (i, j), n in flow.items() if i != j))


def _runs(marks: list[tuple[int, int]], rows: int) -> list[tuple[int, int]]:
    """(first row, shard), without empty stretches and with equal neighbours joined."""
    out: list[tuple[int, int]] = []
    for row, j in marks:
        if row < rows and (not out or out[-1][1] != j):
            out.append((row, j))
    return out
