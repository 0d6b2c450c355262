"""Audio and video: correlation by time, drift and its statistics, track timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drift(video: DataFrame, audio: DataFrame, video_clock: int = 90_000, audio_clock: int = 48_000) -> DataFrame:
    """At each audio sample the latest video frame up to it (an as-of join by filling forward over
    the union of both), the drift of their timelines and the lag of arrival, in microseconds."""
    v = video.select("stream_id", "capture_us", F.lit(0).alias("side"), F.col("event_id").alias("order"), F.col("pts").alias("video_pts"), F.col("capture_us").alias("video_us"), F.lit(None).cast("long").alias("audio_pts"), F.lit(None).cast("long").alias("event_id"))
    a = audio.select("stream_id", "capture_us", F.lit(1).alias("side"), F.col("event_id").alias("order"), F.lit(None).cast("long").alias("video_pts"), F.lit(None).cast("long").alias("video_us"), "audio_pts", "event_id")
    by = Window.partitionBy("stream_id").orderBy("capture_us", "side", "order")
    rows = v.unionByName(a).withColumn("video_pts", F.last("video_pts", True).over(by)).withColumn("video_us", F.last("video_us", True).over(by))
    rows = rows.filter("side = 1 and video_pts is not null and video_pts <> 0 and audio_pts <> 0")
    gap = F.expr(f"(video_pts * 1000000 div {video_clock}) - (audio_pts * 1000000 div {audio_clock})")
    return rows.select("stream_id", "event_id", "capture_us", "video_pts", "audio_pts", gap.alias("drift_us"), (F.col("video_us") - F.col("capture_us")).alias("lag_us"))


def drift_statistics(samples: DataFrame, last: int = 100, limit_us: int = 40_000) -> DataFrame:
    """Mean and variance (of whole milliseconds, cut towards zero) over the last samples, and whether
    the tracks are in sync."""
    w = Window.partitionBy("stream_id").orderBy("capture_us", "event_id").rowsBetween(1 - last, 0)
    ms = F.expr("drift_us div 1000")
    rows = samples.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("sum", F.sum("drift_us").over(w)).withColumn("s1", F.sum(ms).over(w)).withColumn("s2", F.sum(ms * ms).over(w))
    rows = rows.withColumn("avg_us", F.expr("sum div n")).withColumn("avg_ms", F.expr("avg_us div 1000"))
    variance = (F.col("s2") - 2 * F.col("avg_ms") * F.col("s1") + F.col("n") * F.col("avg_ms") * F.col("avg_ms")) / F.col("n")
    return rows.select("stream_id", "event_id", "avg_us", F.round(variance, 6).alias("variance_ms2"), (F.abs("avg_us") <= limit_us).alias("in_sync"))


def timeline(track: DataFrame, clock: int = 90_000) -> DataFrame:
    """Presentation time of each row: the wall time of the last base plus the time since it. A jump
    of over ten seconds sets a new base, one of over a second is counted."""
    by = Window.partitionBy("stream_id").orderBy("arrival_idx")
    rows = track.withColumn("jump", F.abs(F.col("pts") - F.lag("pts").over(by)))
    rows = rows.withColumn("base", F.sum((F.col("jump") > 10 * clock).cast("int")).over(by)).fillna(0, ["base"])
    of = Window.partitionBy("stream_id", "base").orderBy("arrival_idx")
    rows = rows.withColumn("base_us", F.first("capture_us").over(of)).withColumn("base_pts", F.first("pts").over(of))
    rows = rows.withColumn("present_us", F.expr(f"base_us + (pts - base_pts) * 1000000 div {clock}"))
    rows = rows.withColumn("back", F.col("dts") < F.lag("dts").over(by))
    return rows.withColumn("jumps", F.coalesce(F.sum((F.col("jump") > clock).cast("int")).over(by), F.lit(0))).withColumn("dts_errors", F.coalesce(F.sum(F.col("back").cast("int")).over(by), F.lit(0)))


def rescaled(pts: Column, num_a: int, den_a: int, num_b: int, den_b: int) -> Column:
    """A time in units of num_a/den_a in units of num_b/den_b, halves away from zero."""
    return F.round(pts * (num_a * den_b) / (den_a * num_b)).cast("long")


def residue(pts: Column, num_a: int, den_a: int, num_b: int, den_b: int) -> Column:
    exact = pts * (num_a * den_b) / (den_a * num_b)
    return exact - F.round(exact)
