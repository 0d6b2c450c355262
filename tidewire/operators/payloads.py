"""Units out of packet payloads: whole ones, several in one packet, and those that were cut into fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.units import FRAME_BYTES, UNIT_BYTES, av1_payload, obu_kind, xs_payload

from .sequences import arrival, before


def units(packets: DataFrame) -> DataFrame:
    """stream_id, arrival_idx and units (in hexadecimal) of every packet that completes some, for packets with seq and held
    (see ``functions.parsing``). A fragment that starts a unit drops the one before; a gap in the sequence numbers, counted
    over all packets without error, drops the unit that is open; a repeated fragment is left out."""
    last = F.last(F.when(F.col("held.error").isNull(), F.col("seq")), ignorenulls=True).over(before())
    rows = packets.withColumn("gap", F.pmod(F.col("seq") - last, F.lit(65536)))
    whole = rows.filter(F.size("held.units") > 0).select("stream_id", "arrival_idx", F.col("held.units").alias("units"))

    opened = F.sum(F.col("held.starts").cast("int")).over(arrival())
    parts = rows.withColumn("unit", opened).filter(F.col("held.part") & (F.col("unit") > 0))
    inside = Window.partitionBy("stream_id", "unit").orderBy("arrival_idx")
    again = ~F.col("held.starts") & (F.col("gap") == 0)
    lost = ~F.col("held.starts") & (F.coalesce("gap", F.lit(2)) > 1)
    parts = parts.withColumn("lost", F.max(lost).over(inside)).withColumn("over", F.coalesce(F.max(F.col("held.ends")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    parts = parts.filter(~F.col("lost") & ~F.col("over") & ~again)
    # the fragments of one unit
    made = parts.groupBy("stream_id", "unit").agg(F.max("arrival_idx").alias("arrival_idx"), F.bool_or("held.ends").alias("done"), F.array_sort(F.collect_list(F.struct("arrival_idx", "held.body"))).alias("bodies"))
    joined = F.array(F.array_join(F.transform("bodies", lambda b: b["body"]), ""))
    return whole.unionByName(made.filter("done").select("stream_id", "arrival_idx", joined.alias("units")))


def _joined(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["body"])), ""))


def _parts(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Rows of parts (of ``group``, with begins, part and body) up to the size bound, a loss or the part that ends it."""
    inside = Window.partitionBy("stream_id", group).orderBy("arrival_idx")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("broken", F.max(F.col("gap") & ~F.col("begins")).over(inside)).withColumn("over", F.coalesce(F.max(F.col("ends") & F.col("part")).over(earlier), F.lit(False)))
    return rows.withColumn("bytes", F.sum(F.when(F.col("part"), F.length("body")).otherwise(0)).over(inside)).withColumn("alive", F.col("part") & ~F.col("broken") & ~F.col("over") & (F.col("bytes") <= most))


def av1_units(packets: DataFrame, most: int = UNIT_BYTES) -> DataFrame:
    """stream_id, unit, arrival_idx, place, kind and obu: the units of AV1 payloads (packets with seq and data), one a row, with the
    temporal unit that each belongs to and the packet that completes it. A unit cut over packets is dropped by a gap in the
    sequence numbers, by a new start, or beyond ``most`` bytes; a packet that goes on with a unit whose start is not there holds
    nothing; a packet with sizes that do not fit gives none of its units. A temporal unit begins with a packet that says so or
    with a delimiter. Packets without bytes are as if they were not there."""
    rows = packets.select("stream_id", "arrival_idx", "seq", av1_payload(F.col("data")).alias("held")).filter("held IS NOT NULL")
    rows = rows.select("stream_id", "arrival_idx", "held.*", F.coalesce(F.pmod(F.col("seq") - F.lag("seq").over(arrival()), F.lit(65536)) != 1, F.lit(False)).alias("gap"))
    rows = rows.withColumn("begins", F.col("goes_on") & ~F.col("continues")).withColumn("ends", F.col("continues") & ~F.col("goes_on")).withColumn("part", F.col("continues") | F.col("goes_on"))
    rows = _parts(rows.withColumn("run", F.sum(F.col("begins").cast("int")).over(arrival())), "run", most)
    rows = rows.withColumn("alive", F.col("alive") & (F.col("run") > 0))
    # a packet behind a gap that would go on with an open unit is not looked at, not even for the temporal unit that it begins
    inside = Window.partitionBy("stream_id", "run").orderBy("arrival_idx").rowsBetween(Window.unboundedPreceding, -1)
    was_open = (F.col("run") > 0) & ~F.coalesce(F.max(F.col("gap") & ~F.col("begins")).over(inside), F.lit(False)) & ~F.col("over")
    rows = rows.withColumn("begun", F.sum((F.col("new") & ~(F.col("continues") & F.col("gap") & was_open)).cast("int")).over(arrival()))
    whole = rows.select("stream_id", "arrival_idx", "begun", F.posexplode("units").alias("place", "obu"))
    # the parts of one unit, of bounded size
    made = rows.filter("alive").groupBy("stream_id", "run").agg(F.max("arrival_idx").alias("arrival_idx"), F.max("begun").alias("begun"), F.bool_or("ends").alias("done"), F.array_sort(F.collect_list(F.struct("arrival_idx", "body"))).alias("parts"))
    cut = made.filter("done").select("stream_id", "arrival_idx", "begun", F.lit(0).alias("place"), _joined(F.col("parts")).alias("obu"))
    ordered = Window.partitionBy("stream_id").orderBy("arrival_idx", "place")
    found = whole.unionByName(cut).withColumn("kind", obu_kind(F.col("obu")))
    begins = (F.coalesce(F.col("kind"), F.lit(0)) == DELIMITER) | F.coalesce(F.col("begun") != F.lag("begun").over(ordered), F.lit(True))
    found = found.withColumn("begins", begins)
    return found.select("stream_id", F.sum(F.col("begins").cast("int")).over(ordered).alias("unit"), "arrival_idx", "place", "kind", "obu")


#: Fixed value: the type of an AV1 temporal delimiter.
DELIMITER = 2


def xs_frames(packets: DataFrame, most: int = FRAME_BYTES) -> DataFrame:
    """stream_id, arrival_idx, frame, profile, packets and data: the frames of JPEG XS payloads (packets with seq and h, in
    hexadecimal). A frame begins with a packet that says so or has another frame number than the packet before (0 before the
    first one), and ends with one that says so. A lost packet drops the frame inside which it falls, to its end; so do more
    than ``most`` bytes. Payloads without a whole header are as if they were not there; those without data hold nothing."""
    rows = packets.select("stream_id", "arrival_idx", "seq", xs_payload(F.col("h")).alias("held")).filter("held IS NOT NULL").select("stream_id", "arrival_idx", "seq", "held.*")
    rows = rows.withColumn("gap", F.coalesce(F.pmod(F.col("seq") - F.lag("seq").over(arrival()), F.lit(65536)) != 1, F.lit(False)))
    rows = rows.withColumn("begins", F.col("first") | (F.col("frame") != F.coalesce(F.lag("frame").over(arrival()), F.lit(0))))
    rows = rows.withColumn("part", F.length("body") > 0).withColumn("ends", F.col("last")).withColumn("body", F.unhex("body")).withColumn("run", F.sum(F.col("begins").cast("int")).over(arrival()))
    rows = rows.withColumn("profile", F.last("profile", ignorenulls=True).over(arrival()))
    made = _parts(rows, "run", most).filter("alive").groupBy("stream_id", "run").agg(F.max("arrival_idx").alias("arrival_idx"), F.max("frame").alias("frame"), F.max_by("profile", "arrival_idx").alias("profile"), F.count(F.lit(1)).alias("packets"), F.bool_or("ends").alias("done"), F.array_sort(F.collect_list(F.struct("arrival_idx", "body"))).alias("parts"))
    return made.filter("done").select("stream_id", "arrival_idx", "frame", "profile", "packets", _joined(F.col("parts")).alias("data"))
