"""The stream registry as tables: last writer wins, liveness by time, keyset pages; and rankings
for eviction, one memory domain (node) at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(updates: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The newest row of each key, with when it was first seen."""
    order = F.struct(*version)
    rest = [c for c in updates.columns if c != key]
    out = updates.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(version[0]).alias("created_at"), F.count(F.lit(1)).alias("n_updates"))
    return out.select(key, "r.*", "created_at", "n_updates")


def live(streams: DataFrame, heartbeats: DataFrame, key: str, at: str, ttl: str) -> tuple[DataFrame, DataFrame]:
    """Streams with a heartbeat within the time to live before the newest of all, and the expired ones."""
    now = heartbeats.agg(F.max(at).alias("_now"))
    fresh = heartbeats.crossJoin(F.broadcast(now)).filter(F.col(at) > F.col("_now") - F.expr(f"INTERVAL {ttl}")).select(key).distinct()  # one row
    return streams.join(fresh, key, "left_semi"), streams.join(fresh, key, "left_anti")


def replayed(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds applied to a log of writes (a column op: set, update or delete): a set always applies, an update and a delete only if
    the key is there at that point, which is so if the last set or applied delete before was a set. A delete of a key that is not
    there changes nothing, so the last set or delete of any kind tells."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last(F.when(F.col("op") == "set", F.lit(True)).when(F.col("op") == "delete", F.lit(False)), ignorenulls=True).over(before), F.lit(False))
    return log.withColumn("applied", (F.col("op") == "set") | there)


def current(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The rows that a log leaves: for each key that is there, the newest value that is not null of each column since its last delete,
    when it was set, and how many writes applied since."""
    rows = replayed(log, key, order).filter("applied")
    by = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("life", F.sum((F.col("op") == "delete").cast("int")).over(by))
    last = F.max("life").over(Window.partitionBy(key))
    rows = rows.withColumn("newest", last).filter((F.col("life") == F.col("newest")) & (F.col("op") != "delete"))
    at = F.struct(*order)
    held = [F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values]
    return rows.groupBy(key).agg(*held, F.min(order[0]).alias("created_at"), F.count(F.lit(1)).alias("n_writes"))


def got(streams: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key, by a filter that reaches the scan; none if it is not there."""
    return streams.filter(F.col(key) == F.lit(value))


def page(streams: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The next ``n`` rows by key: a filter that reaches the scan, then a top-n."""
    return streams.filter(F.col(key) > after).orderBy(key).limit(n)


def evicted(streams: DataFrame, target: Column, order: list[Column], node: str = "node", size: str = "memory") -> DataFrame:
    """The first streams of each node, by ``order``, until they free the target."""
    by = Window.partitionBy(node).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return streams.withColumn("freed_before", F.coalesce(F.sum(size).over(by), F.lit(0))).filter(F.col("freed_before") < target)


def hybrid_score(node: str = "node") -> Column:
    """0.4 age + 0.4 size + 0.2 priority, each as a share of the node's largest."""
    of = Window.partitionBy(node)
    return F.round(0.4 * F.col("age") / F.max("age").over(of) + 0.4 * F.col("memory") / F.max("memory").over(of) + 0.2 * F.col("priority") / 10.0, 9)
