"""Small helpers shared by the operators: Arrow columns, internal column names, session settings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_long(df: DataFrame, column: str):
    return F.col(f"`{column}`").cast("long")


#: Rows of an Arrow batch: a batch of long texts must fit beside the others of an executor's tasks.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, so that tasks hold few texts at a time."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is run has Arrow batches of at most so many rows: for rows that are large themselves."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def text_rows(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text) alone, under fixed names, whatever else the table holds."""
    return bounded(df).select(as_long(df, id_column).alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path in the store that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, a folder beside the warehouse stands in if all runs on one machine; a cluster
    without the setting is an error, as its executors would each write to a disk of their own.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared store and reads it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows (stops counting there)."""
    return df.limit(rows + 1).count() <= rows


#: Rows of a table with few columns of fixed width that may be broadcast, and the share of all rows from which a key is hot.
BROADCAST_ROWS, HOT_SHARE = 1_000_000, 100_000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Joins rows to a table with one row a key, whose column ``count`` says how many rows have the key.

    A small table is broadcast. Of a larger one only the hot keys are, at most HOT_SHARE of them by their definition;
    the rest meet in a shuffled join without a hot key.
    """
    if small(table, BROADCAST_ROWS):
        return rows.join(F.broadcast(table), keys, how)
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) > total / HOT_SHARE)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def inner_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or any(c.startswith(name.lower() + "_") for c in taken):
        name += "_"
    return name
