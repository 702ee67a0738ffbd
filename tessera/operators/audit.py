"""Audits over several stores, triage of new files, histograms, ids, stage figures, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import last_year
from tessera.sources.store import kept


def store_audit(docs: DataFrame, stores: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """(id, n_<store>.., status, gaps): for every document how many rows each store holds, and whether it is
    complete (all stores), searchable (the required ones) or neither."""
    out = docs.select("id")
    for name, rows in stores.items():
        out = out.join(rows.groupBy("id").agg(F.count("*").alias(f"n_{name}")), "id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    has = {s: F.col(f"n_{s}") > 0 for s in stores}
    all_of = lambda names: F.array(*[has[s] for s in names])
    full = F.forall(all_of(list(stores)), lambda x: x)
    some = F.forall(all_of(required), lambda x: x)
    gaps = F.concat_ws(",", *[F.when(~has[s], F.lit(s)) for s in stores])
    return out.withColumn("status", F.when(full, "complete").when(some, "searchable").otherwise("partial")).withColumn("gaps", gaps)


def orphans(docs: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """(store, id): ids that a store holds without a document."""
    out = None
    for name, rows in stores.items():
        lost = rows.select("id").distinct().join(docs, "id", "left_anti").select(F.lit(name).alias("store"), "id")
        out = lost if out is None else out.unionByName(lost)
    return out


def triage(files: DataFrame, known: DataFrame) -> DataFrame:
    """(id, hash, category): new, duplicate (a file of the same content came first), known, or invalid."""
    first = files.groupBy(F.col("hash").alias("same")).agg(F.min("id").alias("first"))
    rows = files.join(known.select("hash").distinct().withColumn("known", F.lit(True)), "hash", "left").join(first, F.col("hash").eqNullSafe(F.col("same")))
    chosen = F.when(~F.col("valid"), "invalid").when(F.col("known"), "known").when(F.col("first") != F.col("id"), "duplicate").otherwise("new")
    return rows.select("id", "hash", chosen.alias("category"))


def histogram(df: DataFrame, keys: list[str], measure: Column) -> DataFrame:
    """(key, value, n, total): counts by each of several keys in one pass over the data."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("s"), measure.alias("m"))
    return flat.groupBy("s.key", "s.value").agg(F.count("*").alias("n"), F.sum("m").alias("total"))


def next_id(df: DataFrame, column: str, first: int = 1001) -> DataFrame:
    """(next): one more than the greatest number at the end of an id."""
    number = F.expr(f"try_cast(split_part(`{column}`, '#', 2) as bigint)")
    return df.agg(F.coalesce(F.max(number) + 1, F.lit(first)).cast("long").alias("next_id"))


def stage_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, total, mean, nearest-rank p50 and p95, and the greatest value, for each stage."""
    figures = df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))
    # ranks come from counts of ranges of values, then of values within the one range that holds the rank: no task holds a group
    held = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("x")).groupBy("g", "x").agg(F.count("*").alias("c"))
    held = kept(held.repartitionByRange("g", "x").withColumn("part", F.spark_partition_id()), "ranges")
    parts = held.groupBy("g", "part").agg(F.sum("c").alias("c"))
    parts = parts.withColumn("below", F.sum("c").over(Window.partitionBy("g").orderBy("part")) - F.col("c"))
    ranks = figures.select(F.col(by).alias("rg"), "n").select("rg", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.bround(F.lit(p) * (F.col("n") - 1), 0).cast("long").alias("at")) for p in (0.5, 0.95)])).alias("r")).select("rg", "r.*")
    where = parts.join(F.broadcast(ranks), F.expr("g <=> rg and at >= below and at < below + c")).select(F.col("g").alias("wg"), F.col("part").alias("wpart"), "p", "at", "below")
    found = held.join(F.broadcast(where), F.expr("g <=> wg and part = wpart")).select("g", "p", "x", "c", "at", "below")
    found = found.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy("g", "p").orderBy("x"))).where("upto > at and upto - c <= at")
    found = found.groupBy("g").agg(F.max(F.when(F.col("p") == 0.5, F.col("x"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("x"))).alias("p95"))
    return figures.join(found, F.col(by).eqNullSafe(F.col("g")), "left").select(by, "n", "total", "mean", "p50", "p95", "most")


def year_range(df: DataFrame, text: Column, latest: int) -> DataFrame:
    """(first_year, last_year) of the years that texts end on, future ones left out."""
    return df.select(last_year(text).alias("y")).where(F.col("y") <= latest).agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key (a log where the last event wins)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def keep_newest(df: DataFrame, by: str, n: int, order: list, exempt: Column) -> DataFrame:
    """The n newest rows of each group; exempt rows come first."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(exempt), *order))).where(F.col("rn") <= n)


def dedupe_first(df: DataFrame, norm: Column, order: list) -> DataFrame:
    """One row for each normalised text: the first in (ascending) order. Copies of a text are aggregated before they are shuffled."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(norm.alias("norm")).agg(first).select("row.*")


def quotas(sizes: DataFrame, n: int) -> DataFrame:
    """(stratum, size, quota): n rows dealt to strata (stratum, size) by their shares: the whole part, at least one; what is
    too much goes from the largest quotas, what is left to the largest remainders. Ties go by the stratum."""
    total = sizes.agg(F.sum("size").alias("all"))
    rows = sizes.crossJoin(F.broadcast(total)).withColumn("exact", F.lit(n) * F.col("size") / F.col("all"))
    rows = rows.withColumn("quota", F.greatest(F.lit(1), F.floor("exact")).cast("long")).withColumn("rest", F.col("exact") - F.floor("exact"))
    dealt = rows.agg(F.sum("quota")).first()[0] or 0
    if dealt > n:
        # a quota's units, the highest first, are taken away one by one: n and a unit a stratum at most
        units = rows.select("stratum", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("unit"))
        gone = units.orderBy(F.desc("unit"), "stratum").limit(dealt - n).groupBy(F.col("stratum").alias("whose")).agg(F.count("*").alias("gone"))
        rows = rows.join(gone, F.col("stratum").eqNullSafe(F.col("whose")), "left").select("stratum", "size", (F.col("quota") - F.coalesce("gone", F.lit(0))).alias("quota"))
    elif dealt < n:
        more = rows.orderBy(F.desc("rest"), "stratum").limit(n - dealt).select(F.col("stratum").alias("lucky"), F.lit(1).alias("more"))
        rows = rows.join(more, F.col("stratum").eqNullSafe(F.col("lucky")), "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0)))
    return rows.select("stratum", "size", F.least("quota", "size").alias("quota"))


def choose_sample(df: DataFrame, stratum: str, id_column: str, n: int, salt: str) -> DataFrame:
    """A stratified sample of n rows (all, where there are fewer): of each stratum its quota, in hash order.

    No stratum is sorted whole: only rows whose hash lies under a bound, which lets through the quota and a margin, are
    ordered; strata where too few lie under it are tried again with a wider margin.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(stratum).alias("stratum"), F.col(id_column).alias("id"), digest.alias("digest"))
    rows = rows.withColumn("u", F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / float(1 << 52))
    wanted = quotas(df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("size")), n)
    wanted = kept(wanted.where("quota > 0").select(F.col("stratum").alias("s"), "size", "quota"), "quotas")
    order = Window.partitionBy("s").orderBy("digest", "id")
    out, margin = None, 6.0
    while not wanted.isEmpty():
        bound = (F.col("quota") + margin * (F.sqrt("quota") + 3)) / F.col("size")
        near = kept(rows.join(wanted, F.col("stratum").eqNullSafe(F.col("s"))).where(F.col("u") <= bound), "sample")
        counts = near.groupBy("s").agg(F.count("*").alias("found"))
        short = wanted.join(counts.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").where("coalesce(found, 0) < quota").select("s", "size", "quota")
        short = kept(short, "short")
        full = near.join(short.select(F.col("s").alias("t")), F.col("s").eqNullSafe(F.col("t")), "left_anti")
        chosen = full.withColumn("rn", F.row_number().over(order)).where("rn <= quota").select("row.*")
        out = chosen if out is None else out.unionByName(chosen)
        wanted, margin = short, margin * 8
    return df.where("false") if out is None else out
