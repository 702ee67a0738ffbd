"""A stored keyword index of several text fields, and the evaluation of all queries' expressions over it at once.

An index is a folder of batches and a log of those that count (batch, documents and words it adds or takes away). A batch holds
- ``documents``: a row a document with its length and, per stem, where it stands. Texts are read once, for these rows;
- ``postings``: the same by stem (stem, id, positions, dl), in folders by the stem's bucket and sorted by stem;
- ``terms``: by how many documents each stem's document frequency rises or falls.
So a search knows the size of the corpus from the log and document frequencies from the dictionary, counts nothing
again, and reads the buckets of the asked stems alone. A removal, or an upsert of an id that is there, takes the old
document's stems from its own row. A batch counts from the moment the log names it; of several with the same id the
latest holds; ``compact`` writes the living rows as one batch. One writer at a time.

A place is a long: the field's number in the upper half, the word's in the lower, so that no phrase reaches over fields.
Words are stemmed and grouped by stem within the rows of an Arrow batch, and each task sorts its own rows into buckets: no posting
is shuffled to build an index. A stem's rows may be any share of the table: every task has files of its own, and
of a group of words only the rarest one's rows are brought to the others, by (stem, id).

Null ids are left out, null and empty texts are documents without words, an id twice in a batch is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stem as stems
from tessera.functions.text import tokens
from tessera.operators import lexical
from tessera.operators.lexical import K1, B
from tessera.sources.store import Versioned, kept, shared_dir

BUCKETS = 64
#: Rows of a table about asked stems or units that may be broadcast.
BROADCAST_ROWS = 1_000_000
_POSTINGS = "postings array<struct<stem:string,positions:array<bigint>>>"
FIELDS = {"documents": f"dl bigint, {_POSTINGS}", "postings": "stem string, positions array<bigint>, dl bigint, bucket int", "terms": "stem string, df bigint"}


def bucket(stem: Column) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def _near(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if it has at most so many rows (stops counting there)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def analysed(word: str, stemmed: bool) -> str:
    return stems.stem(stems.fold(word)) if stemmed else word


#: Words that are inverted at once; a longer document is taken alone.
WORDS = 200_000
#: Rows of an Arrow batch whose rows hold whole documents' words or places.
BATCH_ROWS = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it Arrow batches have at most BATCH_ROWS rows, however many the session allows; its setting comes back."""
    before = spark.conf.get(_BATCH_SETTING)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def slices(batch: pa.RecordBatch, fields: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of documents with at most WORDS words together, so that memory doesn't grow with the table."""
    words = sum(np.diff(batch.column(1 + f).offsets.to_numpy()).astype(np.int64) for f in range(fields))
    ends, start = np.cumsum(words), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + WORDS, "right")))
        yield batch.slice(start, end - start)
        start = end


def inverted(fields: int, stemmed: bool):
    """(id, words of each field) to (id, dl, postings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for batch in batches for part in slices(batch, fields)):
            n = rows.num_rows
            flat, doc, place = [], [], []
            for f in range(fields):
                column = rows.column(1 + f)
                lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
                flat.append(column.flatten())
                doc.append(np.repeat(np.arange(n), lengths))
                place.append((np.int64(f) << 32) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
            doc, place = np.concatenate(doc), np.concatenate(place)
            words = pa.concat_arrays(flat).dictionary_encode()
            names = pa.array([analysed(w, stemmed) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
            code = names.indices.to_numpy()[words.indices.to_numpy()]
            order = np.lexsort((place, code, doc))
            doc, code, place = doc[order], code[order], place[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))) if len(doc) else np.zeros(0, np.int64)
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(place, pa.int64()))
            entries = pa.StructArray.from_arrays([names.dictionary.take(pa.array(code[first])), positions], ["stem", "positions"])
            bounds = np.searchsorted(doc[first], np.arange(n + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries)
            length = np.bincount(doc, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(length), lists], ["id", "dl", "postings"])

    return run


def group_hits(kind: str, places: list[np.ndarray], distance: int) -> list[np.ndarray]:
    """Where a group of words stands: for a phrase the starts, for a near group each word's places that take part.

    Words are near when all of them stand within a window of ``distance`` + 2 places.
    """
    if kind == "phrase":
        return [reduce(np.intersect1d, [p - k for k, p in enumerate(places)])]
    span = distance + 1
    starts = np.unique(np.concatenate(places))
    whole = reduce(np.logical_and, [np.searchsorted(p, starts) < np.searchsorted(p, starts + span, "right") for p in places])
    starts = starts[whole]
    return [p[np.searchsorted(starts, p - span) < np.searchsorted(starts, p, "right")] for p in places]


def weighed(weights: list[float]):
    def of(places: np.ndarray) -> float:
        return float(np.asarray(weights)[places >> 32].sum())

    return of


def group_counts(weights: list[float], distance: int):
    """(unit, id, dl, kind, places) to (unit, part, id, dl, tf): one row for a phrase, one for each word of a near group."""
    of = weighed(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            index, part, tf = [], [], []
            words = rows.column("places").values
            of_row, of_word, flat = (np.asarray(x) for x in (rows.column("places").offsets, words.offsets, words.values))
            for k, kind in enumerate(rows.column("kind").to_pylist()):
                places = [flat[of_word[j] : of_word[j + 1]] for j in range(of_row[k], of_row[k + 1])]
                for j, hits in enumerate(group_hits(kind, places, distance)):
                    if len(hits):
                        index.append(k)
                        part.append(j)
                        tf.append(of(hits))
            taken = rows.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("unit"), pa.array(part, pa.int32()), taken.column("id"), taken.column("dl"), pa.array(tf, pa.float64())], ["unit", "part", "id", "dl", "tf"])

    return run


class FieldIndex:
    """``fields``: the text columns, in order; ``stemmed``: Porter stems without diacritics, or words as they are."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], stemmed: bool = True):
        self.spark, self.path, self.fields, self.stemmed = spark, path.rstrip("/"), fields, stemmed
        self.log = Versioned(spark, f"{self.path}/log")

    # batches

    def _batches(self) -> list:
        return [] if self.log.current() is None else sorted(self.log.read().collect(), key=lambda r: r["seq"])

    def _read(self, kind: str) -> DataFrame:
        batches = self._batches()
        if not batches:
            raise FileNotFoundError(self.path)
        schema = FIELDS[kind] if kind == "terms" else f"id {self._id_type(batches[0]['batch'])}, {FIELDS[kind]}"
        rows = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{b['batch']}").withColumn("seq", F.lit(b["seq"])) for b in batches]
        return reduce(DataFrame.unionByName, rows)

    def _id_type(self, batch: str) -> str:
        return self.spark.read.parquet(f"{self.path}/documents/{batch}").schema["id"].dataType.simpleString()

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows that no later batch has replaced or removed: they meet only the ids that later batches touched."""
        batches = self._batches()
        if len(batches) == 1:
            return rows
        later = self._read("documents").where(F.col("seq") > batches[0]["seq"]).groupBy("id").agg(F.max("seq").alias("last"))
        return rows.join(_near(later), "id", "left").where("last is null or last = seq").drop("last")

    def documents(self) -> DataFrame:
        """(id, dl, postings) of the documents in the index."""
        return self._living(self._read("documents")).where("dl is not null").drop("seq")

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.partitionBy(*by).parquet(f"{self.path}/{name}", compression="zstd")

    def _commit(self, batch: str, new: DataFrame | None, old: DataFrame | None, keep: bool = True) -> None:
        """Writes the batch's postings and terms from its documents (``new``) and those they replace (``old``), and names it in
        the log. ``keep``: whether the batches before it count on."""
        of = lambda df, sign: df.select(F.explode("postings.stem").alias("stem"), F.lit(sign).alias("by"))
        sides = [of(df, sign) for df, sign in ((new, 1), (old, -1)) if df is not None]
        if new is not None:
            rows = new.select("id", "dl", F.explode("postings").alias("p")).select("id", "dl", "p.*", bucket(F.col("p.stem")).alias("bucket"))
        else:
            rows = self.spark.createDataFrame([], f"id {self._id_type(batch)}, {FIELDS['postings']}")
        self._write(rows.sortWithinPartitions("bucket", "stem"), f"postings/{batch}", "bucket")
        terms = reduce(DataFrame.unionByName, sides).groupBy("stem").agg(F.sum("by").alias("df")).where("df <> 0")
        self._write(terms, f"terms/{batch}")
        figures = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first() if df is not None else (0, 0) for df in (new, old)]
        before = self._batches()
        row = (before[-1]["seq"] + 1 if before else 1, batch, figures[0][0] - figures[1][0], figures[0][1] - figures[1][1])
        rows = [tuple(b) for b in before] if keep else []
        self.log.rebuild(self.spark.createDataFrame([*rows, row], "seq long, batch string, docs long, words long").coalesce(1))

    def _replaced(self, ids: DataFrame) -> DataFrame | None:
        return self.documents().join(_near(ids), "id", "left_semi") if self._batches() else None

    def upsert(self, docs: DataFrame, id_column: str) -> None:
        """Adds documents; those whose id is in the index already are replaced."""
        batch = uuid.uuid4().hex
        rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), *[tokens(F.col(f).cast("string")).alias(f"f{k}") for k, f in enumerate(self.fields)])
        kind = rows.schema["id"].dataType.simpleString()
        with small_batches(self.spark):
            self._write(rows.mapInArrow(inverted(len(self.fields), self.stemmed), f"id {kind}, {FIELDS['documents']}"), f"documents/{batch}")
        new = self.spark.read.parquet(f"{self.path}/documents/{batch}")
        if not new.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("an id stands twice in a batch")
        self._commit(batch, new, self._replaced(new.select("id")))

    def remove(self, ids: DataFrame, id_column: str) -> None:
        """Documents that are in the index go; other ids change nothing."""
        batch = uuid.uuid4().hex
        gone = ids.select(F.col(id_column).alias("id")).where("id is not null").distinct()
        gone = gone.join(self.documents().select("id"), "id", "left_semi")
        empty = F.expr(f"cast(null as {_POSTINGS.partition(' ')[2]})").alias("postings")
        gone.select("id", F.lit(None).cast("long").alias("dl"), empty).write.parquet(f"{self.path}/documents/{batch}")
        self._commit(batch, None, self._replaced(self.spark.read.schema(f"id {self._id_type(self._batches()[0]['batch'])}").parquet(f"{self.path}/documents/{batch}")))

    def compact(self) -> None:
        """Writes the living rows as one batch."""
        batch = uuid.uuid4().hex
        self._write(self.documents(), f"documents/{batch}")
        self._commit(batch, self.spark.read.parquet(f"{self.path}/documents/{batch}"), None, keep=False)

    # what is known without a count

    def figures(self) -> tuple[int, int]:
        """Documents and words of the index, from the log."""
        batches = self._batches()
        return sum(b["docs"] for b in batches), sum(b["words"] for b in batches)

    def dictionary(self) -> DataFrame:
        """(stem, df)."""
        return self._read("terms").groupBy("stem").agg(F.sum("df").alias("df")).where("df > 0")

    def counts(self) -> DataFrame:
        """One row: posting rows, stems, documents and words."""
        n, words = self.figures()
        return self.dictionary().agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.count("*").alias("stems")).select("*", F.lit(n).cast("long").alias("documents"), F.lit(words).cast("long").alias("words"))

    # search

    def stems_of(self, rows: DataFrame) -> DataFrame:
        """The rows with their ``parts`` turned into the index's stems."""
        if not self.stemmed:
            return rows.withColumn("term", F.get("parts", F.lit(0)))

        @F.arrow_udf("array<string>")
        def run(parts: pa.Array) -> pa.Array:
            return pa.array([[analysed(w, True) for w in p] for p in parts.to_pylist()], pa.list_(pa.string()))

        return rows.withColumn("parts", run("parts")).withColumn("term", F.get("parts", F.lit(0)))

    def postings(self, asked: DataFrame) -> DataFrame:
        """(stem, id, positions, dl) of the distinct ``stem`` values."""
        asked = _near(asked.select("stem").distinct())
        buckets = [r["bucket"] for r in asked.select(bucket(F.col("stem")).alias("bucket")).distinct().collect()]
        return self._living(self._read("postings").where(F.col("bucket").isin(buckets)).join(asked, "stem")).drop("seq", "bucket")

    def unit_counts(self, units: DataFrame, weights: list[float], distance: int) -> tuple[DataFrame, DataFrame]:
        """((unit, part, id, dl, tf), (unit, part, df)) of the distinct units (unit, kind, parts)."""
        known = self.dictionary()
        parts = units.select("unit", "kind", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "stem")).join(known, "stem")
        parts = kept(parts, "units")  # small, and read for every step that follows
        single = parts.where("n = 1").select("unit", "part", "stem")
        if len(set(weights)) == 1:
            tf = F.size("positions") * F.lit(float(weights[0]))
        else:
            by_field = F.array(*[F.lit(float(w)) for w in weights])
            tf = F.aggregate(F.transform("positions", lambda p: F.get(by_field, F.shiftright(p, 32).cast("int"))), F.lit(0.0), lambda a, w: a + w)
        rows = self.postings(parts)
        hits = rows.select("stem", "id", "dl", tf.alias("tf")).join(_near(single), "stem").select("unit", "part", "id", "dl", "tf")
        df = parts.where("n = 1 or kind = 'near'").select("unit", "part", "df")
        groups = parts.where("n > 1")
        if not groups.isEmpty():
            # the rarest word of a group leads: its rows are brought to the rows of the others by (stem, id)
            whole = groups.groupBy("unit", "kind", "n").agg(F.collect_list(F.struct("part", "stem")).alias("words"), F.min(F.struct("df", "part")).getField("part").alias("lead")).where(F.size("words") == F.col("n"))
            lead = _near(whole.select("unit", "kind", "n", "lead", "words", F.filter("words", lambda w: w["part"] == F.col("lead"))[0]["stem"].alias("stem")))
            of_groups = rows.join(_near(groups.select("stem").distinct()), "stem", "left_semi")
            led = of_groups.join(lead, "stem").select("unit", "kind", "n", "id", "dl", "lead", F.col("positions").alias("own"), "words")
            others = led.select("unit", "kind", "n", "id", F.explode(F.filter("words", lambda w: w["part"] != F.col("lead"))).alias("w")).select("unit", "kind", "n", "id", "w.*")
            met = others.join(of_groups.select("stem", "id", "positions"), ["stem", "id"]).select("unit", "kind", "n", "id", "part", "positions")
            mine = led.select("unit", "kind", "n", "id", F.col("lead").alias("part"), F.col("own").alias("positions"), "dl")
            both = met.withColumn("dl", F.lit(None).cast("long")).unionByName(mine)
            places = both.groupBy("unit", "kind", "n", "id").agg(F.max("dl").alias("dl"), F.array_sort(F.collect_list(F.struct("part", "positions"))).alias("places")).where(F.size("places") == F.col("n"))
            found = places.select("unit", "kind", "id", "dl", F.col("places.positions").alias("places"))
            kind = found.schema["id"].dataType.simpleString()
            with small_batches(self.spark):
                found = kept(found.mapInArrow(group_counts(weights, distance), f"unit string, part int, id {kind}, dl long, tf double"), "group-hits")
            hits = hits.unionByName(found)
            df = df.unionByName(found.join(F.broadcast(groups.where("kind = 'phrase'").select("unit").distinct()), "unit", "left_semi").groupBy("unit", "part").agg(F.count("*").alias("df")))
        return hits, df

    def search(self, expressions: DataFrame, k: int, weights: list[float] | None = None, distance: int = 2) -> DataFrame:
        """(qid, id, score, rank): the k best documents of each query by (score at 6 digits, id).

        ``expressions``: (qid, kind, parts) with parts as the index has them (``stems_of``). Each word or phrase scores by
        BM25 with the fields' weights in its count; the words of a near group each score by the places that take part. An idf
        that isn't positive is 1e-6.
        """
        weights = weights or [1.0] * len(self.fields)
        if len(weights) != len(self.fields):
            raise ValueError("one weight a field")
        n, words = self.figures()
        named = expressions.select("qid", "parts", F.when(F.size("parts") == 1, "term").otherwise(F.col("kind")).alias("kind"))
        named = kept(named.withColumn("unit", F.concat_ws(" ", "kind", F.array_join("parts", " "))), "asked")
        hits, df = self.unit_counts(named.select("unit", "kind", "parts").distinct(), weights, distance)
        raw = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = df.select("unit", "part", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"))
        average = words / n if n else 1.0
        gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average or 1.0)))
        gains = hits.join(idf, ["unit", "part"]).select("unit", "id", gain.alias("gain"))
        scored = scores(gains, named.select("qid", "unit"), df, n, k).withColumn("score", F.round("score", 6))
        return lexical.top(scored, k, ["qid"], [F.desc("score"), F.asc("id")])


#: Pairs of queries and documents that are built without a look at sets, and in a task of those that are more.
PAIRS = 1_000_000


def scores(gains: DataFrame, named: DataFrame, df: DataFrame, n: int, k: int, pairs: int = PAIRS) -> DataFrame:
    """(qid, id, score): the sums of a query's gains, of all documents that may be among its k best by (score at 6 digits, id).

    A unit that many queries ask and many documents hold would pair them all. Where queries ask the same set of such units,
    the set's sums are built once: a document that holds none of a query's other units scores the set's sum for it, so only
    the set's k best of these can be among the query's k best (no gain is negative). Where the sets don't save three
    quarters of the pairs, or these are few, every query is paired with every document it meets.

    Pairs that are more are never shuffled: a document's gains come together in one task, which sums them for all queries.
    """
    sums = lambda rows, key: rows.groupBy(key, "id").agg(F.sum("gain").alias("score"))
    asked = named.groupBy("unit").agg(F.count("*").alias("nq")).join(df.groupBy("unit").agg(F.max("df").alias("df")), "unit")
    if (asked.agg(F.sum(F.col("nq") * F.col("df"))).first()[0] or 0) <= pairs:
        return sums(gains.join(_near(named), "unit"), "qid")
    tasks = max(int(gains.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * named.select("qid").distinct().count() // PAIRS))
    gains = gains.repartition(tasks, "id")
    common = kept(asked.where((F.col("nq") > 1) & (F.col("nq") * F.col("df") >= n)).select("unit", "df"), "common")
    sets = named.join(_near(common), "unit").groupBy("qid").agg(F.array_sort(F.collect_list("unit")).alias("units"), F.sum("df").alias("df"))
    sets = kept(sets.groupBy("units").agg(F.min("qid").alias("set"), F.collect_list("qid").alias("qids"), F.max("df").alias("df")), "sets")
    cost = sets.agg(F.sum(F.col("df") * F.size("qids")).alias("pairs"), F.sum("df").alias("once")).first()
    if cost["pairs"] is None or 4 * cost["once"] > cost["pairs"]:
        return sums(gains.join(_near(named), "unit"), "qid")
    shared = kept(sums(gains.join(_near(sets.select("set", F.explode("units").alias("unit"))), "unit"), "set"), "shared")
    own = kept(sums(gains.join(_near(named.join(_near(common), "unit", "left_anti")), "unit"), "qid"), "own")
    members = sets.select("set", F.explode("qids").alias("qid"))
    first = lexical.top(shared.withColumn("rounded", F.round("score", 6)), k, ["set"], [F.desc("rounded"), F.asc("id")])
    first = first.join(_near(members), "set").select("qid", "id", "score").join(_near(own.select("qid", "id")), ["qid", "id"], "left_anti")
    met = own.join(_near(members), "qid").select("set", "id", "qid", F.col("score").alias("own"))
    both = shared.join(_near(met), ["set", "id"]).select("qid", "id", (F.col("own") + F.col("score")).alias("both"))
    whole = own.join(_near(both), ["qid", "id"], "left").select("qid", "id", F.coalesce("both", "score").alias("score"))
    return whole.unionByName(first)


VERSION = 1


def stored(docs: DataFrame, id_column: str, fields: list[str], stemmed: bool = False) -> FieldIndex:
    """The index of a table in files: built when it is first asked for, found by name from then on.

    The name holds the files' paths, sizes and times, so that a changed table gets an index of its own. The index counts once its
    build has ended; of two builds at the same time the first to end is kept.
    """
    spark = docs.sparkSession
    files = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in sorted(docs.inputFiles())]
    listed: dict[str, object] = {}
    for folder in {f.getParent().toString(): f.getParent() for f in files}.values():
        listed |= {s.getPath().toString(): s for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    found = [listed.get(f.toString()) for f in files]
    facts = [VERSION, id_column, fields, stemmed, [(f.toString(), s and s.getLen(), s and s.getModificationTime()) for f, s in zip(files, found)]]
    name = hashlib.sha256(repr(facts).encode()).hexdigest()[:32]
    base = shared_dir(spark, name)
    named = Versioned(spark, base.rpartition("/")[0] + f"/indexes/{name}")
    if named.current() is None:
        index = FieldIndex(spark, f"{named.path}/{uuid.uuid4().hex}", fields, stemmed)
        index.upsert(docs, id_column)
        try:
            named.point(index.path.rpartition("/")[2])
        except FileExistsError:
            pass
    return FieldIndex(spark, f"{named.path}/{named.current()}", fields, stemmed)
