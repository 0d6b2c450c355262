"""Groups of pictures: segmentation, roll-up, retention, shedding, lookup and repair.

Frames are rows with stream_id, arrival_idx, event_id, frame_type, pts, dts and size, one packet a
frame; a keyframe opens a new group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("I", "IDR", "CRA", "BLA")


def arrival() -> WindowSpec:
    """A stream's rows in order of arrival."""
    return Window.partitionBy("stream_id").orderBy("arrival_idx")


def in_gop() -> WindowSpec:
    return Window.partitionBy("stream_id", "gop_id").orderBy("arrival_idx")


def is_key(kind: str = "frame_type") -> Column:
    return F.col(kind).isin(*KEYS)


def segmented(packets: DataFrame) -> DataFrame:
    """Adds gop_id (0 before the first keyframe) and pos, the place in the group."""
    frames = packets.withColumn("gop_id", F.sum(is_key().cast("int")).over(arrival()))
    return frames.withColumn("pos", (F.row_number().over(in_gop()) - 1).cast("long"))


def rollup(frames: DataFrame, clock: int = 90_000) -> DataFrame:
    """One row per group: sizes, counts by type, span, bit rate and the pattern of types."""
    def n(*kinds: str) -> Column:
        return F.count_if(F.col("frame_type").isin(*kinds))

    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arrival_idx", "frame_type"))), lambda x: F.when(x["frame_type"].isin(*KEYS), "I").otherwise(x["frame_type"])), "")
    out = frames.groupBy("stream_id", "gop_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("size").alias("total_size"), n(*KEYS).alias("i_frames"), n("P").alias("p_frames"), n("B").alias("b_frames"),
        F.min("dts").alias("start_dts"), F.max("dts").alias("end_dts"), F.min("pts").alias("start_pts"), F.max("pts").alias("end_pts"), F.max("arrival_idx").alias("last_idx"), letters.alias("pattern"))
    out = out.withColumn("duration", F.col("end_pts") - F.col("start_pts"))
    return out.withColumn("bitrate", F.when(F.col("duration") > 0, F.expr(f"total_size * 8 * {clock} div duration")).otherwise(F.lit(0).cast("long")))


def by_age(groups: DataFrame, newest_first: bool = True) -> DataFrame:
    """Adds rank, 1 for the newest (or oldest) group of each stream."""
    order = F.desc("gop_id") if newest_first else F.asc("gop_id")
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("stream_id").orderBy(order)).cast("long"))


def recent_statistics(groups: DataFrame, last: int = 10) -> DataFrame:
    """Averages and type shares over the newest groups of each stream."""
    total = F.sum("frames")
    return by_age(groups).filter(F.col("rank") <= last).groupBy("stream_id").agg(
        F.round(F.avg("frames"), 6).alias("avg_frames"), F.round(F.avg("duration"), 6).alias("avg_duration"),
        *[F.round(F.sum(f"{k}_frames") / total, 6).alias(f"{k}_ratio") for k in "ipb"])


def completion(groups: DataFrame, clock: int = 90_000) -> DataFrame:
    """Whether a group is complete (half a second, or 120 frames) and closed (two seconds, or 120 frames)."""
    many = F.col("frames") >= 120
    return groups.withColumn("complete", (F.col("duration") >= clock // 2) | many).withColumn("closed", (F.col("duration") >= 2 * clock) | many)


def droppable(frames: DataFrame) -> DataFrame:
    """Adds can_drop: B frames always, keyframes never, P frames unless a B frame comes next."""
    after = F.lead("frame_type").over(in_gop())
    return frames.withColumn("can_drop", F.when(is_key(), False).when(F.col("frame_type") == "B", True).when(F.col("frame_type") == "P", ~F.coalesce(after == "B", F.lit(False))).otherwise(False))


def sheds_frame(kind: Column, can_drop: Column, position: Column, pressure: Column) -> Column:
    """Whether a live frame is dropped at this queue pressure."""
    inside = (position > 0) & can_drop
    limit = F.when(inside & (kind == "B"), 0.5).when(inside & (kind == "P"), 0.7).when(kind == "B", 0.6).when(kind == "P", 0.8).when(kind.isin("I", "IDR"), 0.95).otherwise(0.7)
    return ~(kind.isin(*KEYS) & (pressure < 0.95)) & (pressure > limit)


def sheds_group(pressure: Column, rate: Column, size: Column, least_rate: int) -> Column:
    """Whether whole groups are dropped: at extreme pressure, when the rate is low or at its minimum."""
    return (pressure >= 0.9) & ((rate <= least_rate) | ((size > 0) & ((rate / size < 3.0) | (pressure >= 0.95))))


def shed(frames: DataFrame, pressure: Column) -> DataFrame:
    """Buffered frames that pressure drops, by the age of their group: adds dropped."""
    old = Window.partitionBy("stream_id").orderBy("gop_id")
    rows = frames.withColumn("p", pressure).withColumn("age", F.dense_rank().over(old)).withColumn("groups", F.max("age").over(Window.partitionBy("stream_id")))
    b, p, oldest = F.col("frame_type") == "B", F.col("frame_type") == "P", F.col("age") == 1
    # a P frame of the oldest group goes if nothing but P frames and the next reference follow it
    dropped = (
        F.when(F.col("p") < 0.5, F.lit(False)).when(F.col("p") < 0.7, b & (F.col("age") <= 2)).when(F.col("p") < 0.85, b | (p & oldest))
        .when(F.col("p") < 0.95, oldest & ~is_key()).otherwise(F.when(F.col("groups") > 1, oldest).otherwise(~is_key()))
    )
    return rows.withColumn("dropped", dropped)


def retained(groups: DataFrame, most: int = 10, most_bytes: int = 50 << 20, span: int = 30 * 90_000) -> DataFrame:
    """Groups that a bounded buffer holds at the end: the newest ones within all three limits."""
    back = Window.partitionBy("stream_id").orderBy(F.desc("gop_id"))
    rows = by_age(groups).withColumn("held", F.sum("total_size").over(back)).withColumn("newest", F.max("start_pts").over(Window.partitionBy("stream_id")))
    return rows.filter((F.col("rank") <= most) & ((F.col("held") <= most_bytes) | (F.col("rank") == 1)) & (F.col("start_pts") > F.col("newest") - span))


def without_tail(frames: DataFrame, bad: Column) -> DataFrame:
    """Frames before the first bad one of their group."""
    first = F.min(F.when(bad, F.col("pos"))).over(Window.partitionBy("stream_id", "gop_id"))
    return frames.withColumn("first_bad", first).filter(F.col("first_bad").isNull() | (F.col("pos") < F.col("first_bad"))).drop("first_bad")


def keyframe_at(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """For each (stream_id, target): the last keyframe with pts up to it, by a backward fill over
    the union of both, so neither side is broadcast and no range join is needed."""
    keys = frames.filter(is_key()).select("stream_id", F.col("pts").alias("t"), F.lit(0).alias("side"), F.col("pts").alias("key_pts"), F.col("event_id").alias("key_event"), F.lit(None).cast("long").alias("target"))
    asks = targets.select("stream_id", F.col("target").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("key_pts"), F.lit(None).cast("long").alias("key_event"), "target")
    by = Window.partitionBy("stream_id").orderBy("t", "side")
    rows = keys.unionByName(asks)
    for c in ("key_pts", "key_event"):
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(by))
    return rows.filter("side = 1").select("stream_id", "target", "key_pts", "key_event")


def similar(partial: DataFrame, whole: DataFrame, least: float = 0.5, within: int = 10) -> DataFrame:
    """For each partial group the most similar whole one among the ``within`` groups before it."""
    a = partial.select("stream_id", F.col("gop_id").alias("partial_id"), F.col("frames").alias("n"), F.col("duration").alias("d"))
    b = whole.select("stream_id", "gop_id", "frames", "duration")
    # candidates by the group number itself, so the join stays an equi-join
    near = a.withColumn("gop_id", F.explode(F.sequence(F.col("partial_id") - within, F.col("partial_id") - 1))).join(b, ["stream_id", "gop_id"])
    count = 1 - F.abs(F.col("n") - F.col("frames")) / F.greatest("n", "frames")
    span = F.when((F.col("d") > 0) & (F.col("duration") > 0), 1 - F.abs(F.col("d") - F.col("duration")) / F.greatest("d", "duration")).otherwise(0.0)
    scored = near.withColumn("score", F.round((count + span) / 2, 6)).filter(F.col("score") >= least)
    best = Window.partitionBy("stream_id", "partial_id").orderBy(F.desc("score"), F.desc("gop_id"))
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("stream_id", "partial_id", "gop_id", "score")


def missing_frames(frames: DataFrame) -> DataFrame:
    """Decode times at which a frame should be (every 3000 ticks) and is not, with the frames around
    them and the point between these."""
    by = Window.partitionBy("stream_id").orderBy("dts")
    gaps = frames.select("stream_id", "dts", F.lead("dts").over(by).alias("next_dts"), "size", F.lead("size").over(by).alias("next_size")).filter("next_dts - dts > 3000")
    rows = gaps.withColumn("missing", F.explode(F.expr("sequence(dts + 3000, next_dts - 3000, 3000L)")))
    return rows.select("stream_id", F.col("missing").alias("missing_dts"), F.col("dts").alias("before_dts"), F.col("next_dts").alias("after_dts"), F.expr("(size + next_size) div 2").alias("size"))
