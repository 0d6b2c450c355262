"""Structured Streaming twins of batch operators: the same rows in micro-batches, with watermarks
that bound the state. Sources of any kind work as long as they have the columns named."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.sources.session import shared_folder, shipped


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with the time column that watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, so that the table may be one file as well as a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withColumn("stream_id", F.col("user_id"))


def lateness(spark: SparkSession, sf_dir: str) -> str:
    """A delay for which no row of the events table is late, in whatever order its files are read."""
    first, last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(*[F.unix_seconds(f(F.col("ts").cast("timestamp"))) for f in (F.min, F.max)]).first()
    return f"{(last or 0) - (first or 0) + 1} seconds"


def rate_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per stream and tumbling window."""
    return events.withWatermark("at", late).groupBy("stream_id", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id")).alias("ids")).select("stream_id", F.unix_seconds("w.start").alias("window_s"), "n", "ids")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, as long as its copies come within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def idle_sessions(events: DataFrame, gap: str = "8 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user, ended by a pause."""
    return events.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).select("user_id", F.unix_micros("w.start").alias("started_us"), "n", "first_id")


def gap_counts(events: DataFrame) -> DataFrame:
    """Numbers skipped in each stream, whatever the order in which they come: the state has the ranges that are still
    missing between the lowest and the highest number, and lost falls when a batch fills some."""
    shipped(events.sparkSession)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids = np.unique(pd.concat(list(batches))["event_id"].dropna().to_numpy(np.int64))
        low, high, starts, ends = state.get if state.exists else (None, None, [], [])
        starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
        if low is not None:
            ids = np.unique(np.concatenate((ids, starts - 1, ends + 1, [low, high])))
        if not len(ids):
            return
        p, q = ids[:-1], ids[1:]
        missing = q > p + 1
        if low is not None:  # between two numbers that were known all is seen, but for the ranges
            at = np.searchsorted(starts, p + 1, "right") - 1
            inside = (at >= 0) & (ends[at] >= p + 1) if len(starts) else np.zeros(len(p), bool)
            missing &= (p >= high) | (q <= low) | inside
        starts, ends = p[missing] + 1, q[missing] - 1
        high = int(ids[-1])
        state.update((int(ids[0]), high, starts.tolist(), ends.tolist()))
        yield pd.DataFrame({"stream_id": [key[0]], "high": [high], "lost": [int((ends - starts + 1).sum())]})

    return events.select("stream_id", "event_id").groupBy("stream_id").applyInPandasWithState(count, "stream_id long, high long, lost long", "low long, high long, starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, then returns its rows. Output and offsets go to the
    shared checkpoint folder."""
    return watched(stream, mode)[0]


def watched(stream: DataFrame, mode: str = "append", provider: str | None = None) -> tuple[DataFrame, list[int]]:
    """The same, with the number of rows of state after each batch. ``provider`` names the state store for this stream."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/part={number}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if provider:
        spark.conf.set(name, provider)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        if provider:
            spark.conf.set(name, before) if before else spark.conf.unset(name)
    query.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]
    return spark.read.parquet(f"{at}/out/part=*"), held
