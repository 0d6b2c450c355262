"""Parameter sets and the frames that need them: what a frame's first slice requires, whether it is known by then, encoder
sessions with the sets that they brought, the best match among them, and what stands in where there is none.

Frames have stream_id, arrival_idx and units (array<binary>, H.264). Sets of a frame count as known to its own slices. What was known
at a frame is a union of sets and frames with a forward fill, keyed by the set's number as well as the stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.parsing import number
from tidewire.functions.units import h264_fields

from .boundaries import H264_PPS, H264_SLICES, H264_SPS
from .sequences import arrival, before

#: Profiles and levels that stand in for one another; quality and chance of success of what stands in.
PROFILES, LEVELS = (66, 77, 88, 100), (30, 31, 32, 40, 41, 42, 50, 51, 52)
APPROXIMATE, COMPATIBLE_SPS, COMPATIBLE_PPS, GENERIC = (0.7, 0.75), 0.8, 0.9, (0.3, 0.5)
#: Fixed value: sessions before the current one that are looked at.
EARLIER = 3


def _read(frames: DataFrame) -> DataFrame:
    return frames.select("stream_id", "arrival_idx", "units", h264_fields(F.col("units")).alias("fields"))


def _sets(read: DataFrame, kind: int) -> DataFrame:
    """The sets of a kind that can be read, with the place in their frame and their bytes."""
    rows = read.select("stream_id", "arrival_idx", F.posexplode(F.arrays_zip("fields", "units")).alias("place", "u"))
    return rows.filter((F.col("u.fields.kind") == kind) & F.col("u.fields.problem").isNull()).select("stream_id", "arrival_idx", "place", F.col("u.fields.pps").alias("pps"), F.col("u.fields.sps").alias("sps"), F.col("u.units").alias("unit"))


def _known(needs: DataFrame, sets: DataFrame, key: list[str], value: Column, to: str) -> DataFrame:
    """``needs`` with the last ``value`` of the sets of the same key up to each frame, as ``to``."""
    columns = ["stream_id", "arrival_idx", *key]
    told = sets.select(*columns, F.col("place"), value.alias(to))
    asked = needs.withColumn(to, F.lit(None).cast(told.schema[to].dataType)).withColumn("place", F.lit(None).cast("int"))
    inside = Window.partitionBy("stream_id", *key).orderBy("arrival_idx", F.col("place").asc_nulls_last())
    both = asked.unionByName(told, allowMissingColumns=True).withColumn(to, F.last(to, ignorenulls=True).over(inside))
    return both.filter("place IS NULL").select(*needs.columns, to)


def requirements(frames: DataFrame) -> DataFrame:
    """stream_id, arrival_idx, slice_type, pps, sps and status of each frame: what its first slice needs. Status: ready; fallback (the
    set named by the picture set is missing, but the stream has another one); missing pps; missing sps; no slice; or
    unreadable, with the field that can't be read."""
    read = _read(frames)
    first = F.get(F.filter("fields", lambda u: u["kind"].isin(*H264_SLICES)), F.lit(0))
    needs = read.select("stream_id", "arrival_idx", first.alias("first")).select("stream_id", "arrival_idx", F.col("first").isNull().alias("none"), "first.problem", F.when(F.col("first.slice_type") <= 9, F.col("first.slice_type")).alias("slice_type"), F.when(F.col("first.problem").isNull(), F.col("first.pps")).alias("pps"))
    needs = _known(needs, _sets(read, H264_PPS), ["pps"], F.col("sps"), "sps")
    sps = _sets(read, H264_SPS).drop("pps")
    needs = _known(needs, sps, ["sps"], F.lit(True), "there")
    needs = _known(needs, sps, [], F.lit(True), "other")
    status = F.when(F.col("none"), "no slice").when(F.col("problem").isNotNull(), F.concat(F.lit("unreadable "), F.col("problem"))).when(F.col("sps").isNull(), "missing pps").when(F.col("there"), "ready").when(F.col("other"), "fallback").otherwise("missing sps")
    return needs.select("stream_id", "arrival_idx", "slice_type", "pps", "sps", status.alias("status"))


def decodable(status: Column) -> Column:
    return status.isin("ready", "fallback")


def sessions(frames: DataFrame) -> DataFrame:
    """stream_id, arrival_idx, session, changed and quality of each frame, with qualities of the sessions before it (newest first). A
    session begins with a frame whose sets (its first ones, as bytes) differ from those of the frame that began the last one;
    its quality is the share of the two sets that the frame brought."""
    fields = _read(frames)

    def first(kind: int) -> Column:
        found = F.filter(F.arrays_zip("fields", "units"), lambda u: (u["fields"]["kind"] == kind) & u["fields"]["problem"].isNull())
        return F.hex(F.get(found, F.lit(0))["units"])

    rows = fields.select("stream_id", "arrival_idx", first(H264_SPS).alias("s"), first(H264_PPS).alias("p"))
    told = F.col("s").isNotNull() | F.col("p").isNotNull()
    config = F.substring(F.sha2(F.concat(F.lit("sps:"), F.coalesce("s", F.lit("")), F.lit("pps:"), F.coalesce("p", F.lit(""))), 256), 1, 16)
    rows = rows.withColumn("config", F.when(told, config))
    rows = rows.withColumn("changed", told & ~F.coalesce(F.col("config") == F.last("config", ignorenulls=True).over(before()), F.lit(False)))
    rows = rows.withColumn("session", F.sum(F.col("changed").cast("int")).over(arrival()))
    quality = (F.col("s").isNotNull().cast("int") + F.col("p").isNotNull().cast("int")) / 2.0
    # one row a session, with those before it
    by = Window.partitionBy("stream_id").orderBy("session")
    begun = rows.filter("changed").select("stream_id", "arrival_idx", "session", quality.alias("quality"))
    begun = begun.withColumn("earlier", F.array(*[F.lag("quality", k).over(by) for k in range(1, EARLIER + 1)]))
    held = F.struct("quality", "earlier")
    both = rows.select("stream_id", "arrival_idx", "session", "config", "changed", F.lit(None).cast("struct<quality:double,earlier:array<double>>").alias("held")).unionByName(begun.select("stream_id", "arrival_idx", "session", F.lit(None).cast("string").alias("config"), F.lit(None).cast("boolean").alias("changed"), held.alias("held")))
    filled = both.withColumn("held", F.last("held", ignorenulls=True).over(Window.partitionBy("stream_id").orderBy("arrival_idx", F.col("changed").asc_nulls_first())))
    return filled.filter("changed IS NOT NULL").select("stream_id", "arrival_idx", "session", "changed", "held.quality", "held.earlier")


def matches(frames: DataFrame) -> DataFrame:
    """stream_id, arrival_idx, session, quality and age of the best match: the current session (age 0), or one of the last three if it
    has a strictly better share of the sets, the newest of equals; quality 0 and age null before any set."""
    rows = sessions(frames)
    candidates = [F.struct(F.coalesce("quality", F.lit(0.0)).alias("quality"), F.lit(0).alias("less"))]
    candidates += [F.struct(F.coalesce(F.get("earlier", F.lit(k - 1)), F.lit(0.0)).alias("quality"), F.lit(-k).alias("less")) for k in range(1, EARLIER + 1)]
    best = reduce(lambda a, b: F.when(b["quality"] > a["quality"], b).otherwise(a), candidates)
    return rows.select("stream_id", "arrival_idx", "session", best.alias("best")).select("stream_id", "arrival_idx", "session", "best.quality", F.when(F.col("best.quality") > 0, -F.col("best.less")).alias("age"))


def fallbacks(frames: DataFrame) -> DataFrame:
    """stream_id, arrival_idx, strategy, quality and success for frames whose slice can be read but whose sets are not all known: the
    best of what may stand in. Compatible: both sets have number 0, the stream's last sequence set has a profile and level of
    the list, and there is a picture set; approximate: any set of each kind; generic: the codec's plain sets."""
    read, needed = _read(frames), requirements(frames)
    missing = needed.filter(F.col("status").isin("missing pps", "missing sps", "fallback"))
    sps, pps = _sets(read, H264_SPS).drop("pps", "sps"), _sets(read, H264_PPS).drop("pps", "sps")
    h = F.hex("unit")
    rows = _known(missing, sps, [], F.struct(number(h, 1, 1).alias("profile"), number(h, 3, 1).alias("level")), "last_sps")
    rows = _known(rows, pps, [], F.lit(True), "some_pps")
    zero = (F.col("pps") == 0) & (F.coalesce("sps", F.lit(0)) == 0)
    both = F.col("last_sps").isNotNull() & F.coalesce("some_pps", F.lit(False))
    fits = both & zero & F.col("last_sps.profile").isin(*PROFILES) & F.col("last_sps.level").isin(*LEVELS)
    compatible = F.struct(F.lit((COMPATIBLE_SPS + COMPATIBLE_PPS) / 2).alias("quality"), F.lit("compatible").alias("strategy"), F.lit(1.0).alias("success"))
    approximate = F.struct(F.lit(APPROXIMATE[0]).alias("quality"), F.lit("approximate").alias("strategy"), F.lit(APPROXIMATE[1]).alias("success"))
    generic = F.struct(F.lit(GENERIC[0]).alias("quality"), F.lit("generic").alias("strategy"), F.lit(GENERIC[1]).alias("success"))
    ranked = F.array_max(F.array(F.when(fits, compatible), F.when(both, approximate), generic))
    return rows.select("stream_id", "arrival_idx", ranked.alias("best")).select("stream_id", "arrival_idx", "best.strategy", "best.quality", "best.success")


def coverage(frames: DataFrame) -> DataFrame:
    """stream_id, picture_sets, covered and coverage: of the numbers of picture sets that a stream has brought, those whose last set names
    a sequence set that the stream has brought too."""
    read = _read(frames)
    pps = _sets(read, H264_PPS).groupBy("stream_id", "pps").agg(F.max_by("sps", F.struct("arrival_idx", "place")).alias("sps"))
    sps = _sets(read, H264_SPS).select("stream_id", "sps").distinct().withColumn("there", F.lit(True))
    found = pps.join(sps, ["stream_id", "sps"], "left").groupBy("stream_id").agg(F.count(F.lit(1)).alias("picture_sets"), F.count("there").alias("covered"))
    return found.withColumn("coverage", F.col("covered") / F.col("picture_sets"))
