"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and two sums over them, to see whether a step changed anything."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.bit_xor(h)).first())


def components(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``pairs`` (a, b). Steps are written to
    the shared folder; nothing but their checksums reaches the driver. Hubs with very many edges
    meet one row (their minimum) in a join, which Spark can split."""
    edges = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        before, edges = edges, written(small, "edges")
        removed(before)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
