"""Sequence numbers, timestamps and arrival: loss, reordering, wrap-around, jitter.

All operators take packets with stream_id, arrival_idx and the columns they name, and work per
stream in order of arrival.
"""

from __future__ import annotations

from math import ceil, exp, gcd, log

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def arrival() -> WindowSpec:
    """A stream's rows in order of arrival."""
    return Window.partitionBy("stream_id").orderBy("arrival_idx")


def before() -> WindowSpec:
    return arrival().rowsBetween(Window.unboundedPreceding, -1)


def signed(delta: Column, bits: int) -> Column:
    """A difference modulo 2^bits as the nearest signed number."""
    half = 1 << (bits - 1)
    return F.pmod(delta + half, F.lit(1 << bits)) - half


def sequence_steps(packets: DataFrame, most: int = 100) -> DataFrame:
    """Adds delta (signed distance to the packet before) and what it means: first, duplicate, next,
    loss, reordered or reset."""
    delta = signed(F.col("seq").cast("long") - F.lag("seq").over(arrival()), 16)
    kind = (
        F.when(F.col("delta").isNull(), "first").when(F.col("delta") == 0, "duplicate").when(F.col("delta") == 1, "next")
        .when((F.col("delta") > 1) & (F.col("delta") < most), "loss").when((F.col("delta") < 0) & (F.col("delta") > -most), "reordered").otherwise("reset")
    )
    return packets.withColumn("delta", delta).withColumn("step", kind)


def extended(packets: DataFrame) -> DataFrame:
    """Adds ext, the sequence number with its wraps counted in, and high, the highest before."""
    delta = signed(F.col("seq").cast("long") - F.lag("seq").over(arrival()), 16)
    ext = F.first(F.col("seq").cast("long")).over(arrival()) + F.sum(F.coalesce(F.col("d"), F.lit(0))).over(arrival())
    return packets.withColumn("d", delta).withColumn("ext", ext).withColumn("high", F.max("ext").over(before())).drop("d")


def loss_statistics(packets: DataFrame) -> DataFrame:
    """Loss against the highest sequence number seen: a late packet makes up for a loss."""
    ahead = F.col("ext") - F.col("high")
    gap = F.when(ahead > 1, ahead - 1).otherwise(0)
    late = (ahead < 0) & (ahead > -100)
    out = extended(packets).groupBy("stream_id").agg(
        F.sum(F.when(ahead.isNull() | (ahead > 0) | late, 1).otherwise(0)).alias("received"),
        (F.sum(F.when(ahead > 0, ahead).otherwise(0)) + 1).alias("expected"),
        F.sum(gap).alias("lost"), F.sum(F.when(ahead > 1, 1).otherwise(0)).alias("loss_events"), F.max(gap).alias("max_consecutive"),
        F.sum(F.when(late, 1).otherwise(0)).alias("recovered"), (F.expr("max(ext) div 65536") - F.expr("min(ext) div 65536")).alias("cycles"),
    )
    return out.withColumn("unrecoverable", F.col("lost") - F.col("recovered")).withColumn("loss_rate", F.round(F.col("lost") / F.col("expected"), 6))


def lost_sequences(packets: DataFrame) -> DataFrame:
    """One row for each sequence number skipped when it was due."""
    jumps = extended(packets).filter(F.col("ext") - F.col("high") > 1)
    return jumps.select("stream_id", F.explode(F.sequence(F.col("high") + 1, F.col("ext") - 1)).alias("lost_ext")).withColumn("lost_seq", F.pmod("lost_ext", F.lit(65536)))


def unwrapped(packets: DataFrame, column: str, bits: int, to: str) -> DataFrame:
    """Adds ``to``: a counter of so many bits made continuous, from its first value on."""
    span = 1 << bits
    step = F.lag(column).over(arrival()) - F.col(column)
    turn = F.when(step > span // 2, 1).when(step < -(span // 2), -1).otherwise(0)
    return packets.withColumn("turn", turn).withColumn(to, F.col(column) + F.sum("turn").over(arrival()) * span).drop("turn")


#: Rows of a block over which a recurrence is folded at once, at least, and at most before a mean is refused.
BLOCK, LONGEST = 1024, 4_000_000


def smoothed(rows: DataFrame, value: Column, keep: float, start: Column | None = None) -> DataFrame:
    """stream_id, last and most: the last and the highest state of a weighted mean, keep * state + (1 - keep) * value, over
    each stream's rows in order of arrival, from ``start`` (a value of the first row; 0 unless given) on. Rows are folded by
    blocks: a first fold from 0 gives what a block adds, so the state in which the next one starts. A block has so many rows that
    ``keep`` to their power no longer counts in double precision, so nothing from before the last but one is needed; a mean
    that forgets more slowly than ``LONGEST`` rows allow is refused."""
    block = max(BLOCK, ceil(-40 / log(keep))) if 0 < keep < 1 else BLOCK
    if not 0 <= keep < 1 or block > LONGEST:
        raise ValueError(f"keep must be from 0 to {exp(-40 / LONGEST):.6f}, not {keep}")
    held = rows.withColumn("x", value.cast("double")).withColumn("block", F.expr(f"(row_number() over (partition by stream_id order by arrival_idx) - 1) div {block}"))
    blocks = held.groupBy("stream_id", "block").agg(F.array_sort(F.collect_list(F.struct("arrival_idx", "x"))).alias("xs"))
    first = F.when(F.col("block") == 0, start if start is not None else F.lit(0.0)).otherwise(F.lit(0.0))

    def step(a: Column, v: Column) -> Column:
        return a * keep + v["x"] * (1 - keep)

    by = Window.partitionBy("stream_id").orderBy("block")
    ends = blocks.withColumn("first", first).withColumn("end", F.aggregate("xs", F.col("first"), step))
    state = F.lag("end").over(by) + F.coalesce(F.lag("end", 2).over(by) * keep**block, F.lit(0.0))
    zero = F.struct(F.coalesce(state, "first").alias("j"), F.lit(float("-inf")).alias("most"))

    def both(a: Column, v: Column) -> Column:
        j = step(a["j"], v)
        return F.struct(j.alias("j"), F.greatest(a["most"], j).alias("most"))

    ends = ends.withColumn("zero", zero).withColumn("r", F.aggregate("xs", F.col("zero"), both))
    return ends.groupBy("stream_id").agg(F.max_by("r.j", "block").alias("last"), F.max("r.most").alias("most"))


def jitter(packets: DataFrame, clock: int = 90_000) -> DataFrame:
    """Interarrival jitter of RFC 3550 over each stream in order of arrival, in clock units."""
    common = gcd(clock, 1_000_000)  # so that microseconds of the epoch times the clock stay in 64 bits
    transit = F.expr(f"capture_us * {clock // common} div {1_000_000 // common}") - F.col("ts")
    steps = unwrapped(packets, "rtp_ts", 32, "ts").withColumn("transit", transit).withColumn("d", F.abs(F.col("transit") - F.lag("transit").over(arrival())))
    made = smoothed(steps.filter("d is not null"), F.col("d"), 15 / 16)
    return made.select("stream_id", F.round("last", 4).alias("jitter"), F.round("most", 4).alias("max_jitter"))


def playout(packets: DataFrame, delay_us: int = 50_000, clock: int = 90_000) -> DataFrame:
    """When the jitter buffer releases each packet, and whether it came too late for that."""
    base = F.first("capture_us").over(arrival())
    at = base + F.expr(f"(ts - first_ts) * 1000000 div {clock}") + delay_us
    rows = unwrapped(packets, "rtp_ts", 32, "ts").withColumn("first_ts", F.first("ts").over(arrival())).withColumn("playout_us", at)
    return rows.withColumn("late", F.col("capture_us") > F.col("playout_us"))


def continuity(packets: DataFrame) -> DataFrame:
    """Continuity counters (modulo 16) per stream: packets, repeats and breaks."""
    cc = F.pmod(F.col("seq"), F.lit(16))
    step = F.pmod(cc - F.lag(cc).over(arrival()), F.lit(16))
    rows = packets.withColumn("step", step)
    return rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("step") == 0).alias("repeats"), F.count_if(F.col("step") > 1).alias("breaks"))


def counted_within(rows: DataFrame, at: str, span: int, counts: dict[str, Column], key: str = "stream_id") -> DataFrame:
    """Adds each of ``counts`` summed over the rows of the key with ``at`` in [at - span, at]: the running sum up to the row
    less the one at the start of its span, which is found in one order with the rows themselves, so no frame is folded
    again for each row."""
    upto = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    known = rows.withColumns({f"_upto_{c}": F.sum(v.cast("long")).over(upto) for c, v in counts.items()} | {f"_one_{c}": v.cast("long") for c, v in counts.items()})
    asks = known.withColumn("_t", F.col(at) - span).withColumn("_side", F.lit(0)).withColumns({f"_one_{c}": F.lit(0).cast("long") for c in counts})
    adds = known.select(key, *[f"_one_{c}" for c in counts], F.col(at).alias("_t"), F.lit(1).alias("_side"))
    before = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asks.unionByName(adds, allowMissingColumns=True).withColumns({c: F.col(f"_upto_{c}") - F.sum(f"_one_{c}").over(before) for c in counts})
    return both.filter("_side = 0").select(*rows.columns, *counts)


def sliding_bitrate(packets: DataFrame, span_us: int = 10_000_000) -> DataFrame:
    """Bits a second over the span before each packet, from the running byte counter. The first packet of the span is
    found by a fill over packets and starts of spans in one order."""
    rows = packets.withColumn("total", F.sum("size").over(Window.partitionBy("stream_id").orderBy("capture_us", "arrival_idx")))
    held = F.struct(F.col("capture_us").alias("at"), F.col("total").alias("bytes"))
    asks = rows.withColumn("_t", F.col("capture_us") - span_us).withColumn("_side", F.lit(0))
    adds = rows.select("stream_id", "arrival_idx", F.col("capture_us").alias("_t"), F.lit(1).alias("_side"), held.alias("_held"))
    back = Window.partitionBy("stream_id").orderBy(F.desc("_t"), F.desc("_side"), F.desc("arrival_idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asks.unionByName(adds, allowMissingColumns=True).withColumn("_held", F.last("_held", ignorenulls=True).over(back)).filter("_side = 0")
    took = F.col("capture_us") - F.col("_held.at")
    rate = F.when(took > 0, F.expr("(total - _held.bytes) * 8000000 div (capture_us - _held.at)")).otherwise(F.lit(0).cast("long"))
    return both.withColumn("bitrate", rate).select(*packets.columns, "bitrate")


def sessions(events: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """Sessions of a key: a row ends one if nothing follows it within the gap."""
    by = Window.partitionBy(key).orderBy(at, "event_id")
    new = F.coalesce((F.col(at) - F.lag(at).over(by)) > gap_s * 1_000_000, F.lit(True))
    rows = events.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(by))
    return rows.groupBy(key, "session").agg(F.min(at).alias("started_us"), F.max(at).alias("ended_us"), F.count(F.lit(1)).alias("n"))
