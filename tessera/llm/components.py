"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import saved


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id of the links (a, b) with the least id it reaches.

    Each step is a partial aggregate (the least neighbour of each id) and a join to it, so an id with
    very many links neither gathers in one task nor emits pairs. Steps are written to the shared
    folder. Null ends and self-links are dropped.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = _sign(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, sign = sign, _sign(edges)
        if sign == last:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
