"""Tables in files: scans, versioned writes, upserts, removals, logs, dumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the store that driver and executors share (spark.checkpoint.dir); beside the warehouse where all
    runs on one machine without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared store and reads it back: it is computed once, whatever executors are lost later."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Versioned:
    """A table as folders of versions, and pointers with rising numbers of which the greatest counts: readers see the old
    rows or the new, and a writer that fails at any step leaves the old ones. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def _pointers(self) -> list[str]:
        """Names "number=version", in the order of their numbers."""
        fs, at = _fs(self.spark, f"{self.path}/_versions")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def current(self) -> str | None:
        pointers = self._pointers()
        return pointers[-1].partition("=")[2] if pointers else None

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{version}")

    def rebuild(self, rows: DataFrame) -> None:
        """Writes all rows as a new version, then names it under the next number: an empty file, which is there or isn't."""
        version = f"v-{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.path}/{version}")
        self.point(version)

    def point(self, version: str) -> None:
        """Names a version that is written as the current one."""
        pointers = self._pointers()
        number = int(pointers[-1].partition("=")[0]) + 1 if pointers else 1
        fs, at = _fs(self.spark, f"{self.path}/_versions/{number:012d}={version}")
        if not fs.createNewFile(at):
            raise FileExistsError(at.toString())

    def upsert(self, rows: DataFrame, key: str) -> None:
        """Rows of the given keys are replaced; others stay."""
        self.rebuild(self.read().join(rows.select(key).distinct(), key, "left_anti").unionByName(rows))

    def remove(self, keys: DataFrame, key: str) -> None:
        self.rebuild(self.read().join(keys.select(key).distinct(), key, "left_anti"))

    def synced(self, rows: DataFrame, key: str) -> None:
        """Brings the table to a given set: new and changed rows are put in, rows whose key isn't in the set go."""
        if not rows.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError("a key stands twice in the set")
        self.rebuild(rows)

    def reset(self, rows: DataFrame) -> None:
        """Drops what there is and begins again with these rows, whose columns may be of other kinds; nothing of the former rows counts."""
        self.rebuild(rows)

    def missing(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key isn't in the table yet: what a resumed build has to do."""
        return rows if self.current() is None else rows.join(self.read().select(key).distinct(), key, "left_anti")


def read_log(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A JSON-lines log where the last event of a key wins field by field; torn lines are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    last = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = [c for c in rows.columns if c != key]
    return rows.select(key, *[F.last(c, ignorenulls=True).over(last).alias(c) for c in fields]).distinct()


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file in which every line must parse."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines(df: DataFrame, *beside: str) -> DataFrame:
    """(line, digest): rows as JSON with their fields in the order of their names; ``beside``: columns that stay beside the line."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    return df.select(*beside, line.alias("line")).withColumn("digest", F.sha2("line", 256))


def dump(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes every table as JSON lines; returns the manifest (name, rows)."""
    out = None
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    out.write.json(f"{path}/_manifest")
    return out


def restore(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Reads a dump back; a table whose rows differ from the manifest is an error."""
    counts = {r["name"]: r["rows"] for r in spark.read.schema("name string, rows long").json(f"{path}/_manifest").collect()}
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{name}")
        if df.count() != counts.get(name):
            raise ValueError(f"{name}: rows differ from the manifest")
        out[name] = df
    return out


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of the files of a folder, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
