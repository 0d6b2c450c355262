"""Where frames begin and end, told from the units in their packets, for four codecs. What a packet means depends on the units
before it; that is the last value that one of them has set, so it comes from windows and no packet waits for another.

Packets have stream_id, arrival_idx, codec (H264, HEVC, AV1, JPEGXS) and data; those of H.264 and HEVC hold either units behind
start codes or one unit of the payload format, whole or a fragment. Data that is null, or too short for a header or marker, gives
neither start nor end and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.parsing import number
from tidewire.functions.units import unit_kinds

from .sequences import before

#: Fixed values, H.264 unit types: slices, supplementary information, the sets, delimiter, fragments; those that begin a frame.
H264_SLICES, H264_IDR, H264_SEI, H264_SPS, H264_PPS, H264_AUD, H264_FRAGMENT = (1, 2, 3, 4, 5), 5, 6, 7, 8, 9, 28
H264_STARTS = (H264_IDR, H264_SPS, H264_PPS, H264_AUD)
#: Fixed values, HEVC: the last slice type, random access points, the sets and the delimiter, fragments.
HEVC_SLICE, HEVC_ACCESS, HEVC_SETS, HEVC_FRAGMENT = 31, (16, 23), (32, 33, 34, 35), 49
#: Fixed values, AV1 unit types.
AV1_SEQUENCE, AV1_DELIMITER, AV1_HEADER, AV1_TILES, AV1_FRAME = 1, 2, 3, 4, 6
#: Fixed values, JPEG XS: markers of start and end, and of the picture header.
XS_START, XS_END, XS_PICTURE = 0x10, 0x11, 0x15


def _last(update: Column, without: Column) -> Column:
    return F.coalesce(F.last(update, ignorenulls=True).over(before()), without)


def _told(rows: DataFrame, starts: Column, ends: Column) -> DataFrame:
    return rows.select("stream_id", "arrival_idx", F.coalesce(starts, F.lit(False)).alias("starts"), F.coalesce(ends, F.lit(False)).alias("ends"))


def _headed(packets: DataFrame, codec: str, body: int) -> DataFrame:
    """Packets of a codec with coded (they have start codes), kinds (their units, null at damage), and of the others kind, with opens
    and closes for fragments (both false inside of one)."""
    h = F.hex("data")
    rows = packets.filter(F.col("codec") == codec).withColumn("kinds", unit_kinds(F.col("data"), F.col("codec"))).withColumn("kinds", F.transform("kinds", lambda u: u["kind"]))
    head = number(h, 0, 1)
    kind = F.when(F.length("data") >= body, (head if codec == "H264" else F.shiftright(head, 1)).bitwiseAND(31 if codec == "H264" else 63))
    coded = (number(h, 0, 3) == 1) | (number(h, 0, 4) == 1)
    return rows.select("stream_id", "arrival_idx", F.coalesce(coded, F.lit(False)).alias("coded"), "kinds", kind.alias("own"), number(h, body, 1).alias("fragment"))


def h264(packets: DataFrame) -> DataFrame:
    """starts and ends of each H.264 packet. A delimiter, a set, an IDR slice, or a slice behind something else begins a frame;
    a delimiter, a set or supplementary information behind a slice ends one (and begins the next). A packet with start codes
    that holds what begins a frame holds a whole one."""
    rows = _headed(packets, "H264", 1)
    part = ~F.col("coded") & (F.col("own") == H264_FRAGMENT)
    fine = part & F.col("fragment").isNotNull() & (F.col("fragment").bitwiseAND(0x20) == 0)
    opens, closes = fine & (F.col("fragment") >= 128), fine & (F.col("fragment").bitwiseAND(64) != 0)
    single = ~F.col("coded") & ~part
    # the unit that this packet begins, if it begins one, and what later packets see as the last unit
    begun = F.when(single, F.col("own")).when(opens, F.col("fragment").bitwiseAND(31))
    seen = F.when(single, F.col("own")).when(opens | closes, F.col("fragment").bitwiseAND(31))
    rows = rows.withColumn("begun", begun).withColumn("seen", seen).withColumn("last", _last(F.col("seen"), F.lit(0)))
    slice_behind = F.col("begun").isin(*H264_SLICES) & ~F.col("last").isin(*H264_SLICES) & (F.col("last") != 0)
    own = F.coalesce(F.col("begun").isin(*H264_STARTS) | slice_behind, F.lit(False))
    heads = F.filter("kinds", lambda k: k.isin(*H264_STARTS))
    held = F.coalesce(F.size(heads) > 0, F.lit(False)) & F.col("coded")
    # a delimiter as the last of the units that begin a frame leaves none open
    update = F.when(held, F.element_at(heads, -1) != H264_AUD).when(own, F.lit(True))
    rows = rows.withColumn("own", own).withColumn("held", held).withColumn("update", update).withColumn("open", _last(F.col("update"), F.lit(False)) | F.col("own"))
    ends = F.col("open") & F.col("last").isin(*H264_SLICES) & F.col("begun").isin(H264_SEI, H264_AUD, H264_SPS, H264_PPS)
    ends = F.coalesce(ends, F.lit(False))
    return _told(rows, F.col("own") | ends | F.col("held"), ends | F.col("held"))


def hevc(packets: DataFrame) -> DataFrame:
    """The same of HEVC. Any unit that is no slice ends a frame behind a slice; of fragments each that opens a slice begins a frame.
    Among units with start codes a set or delimiter behind a slice ends a frame."""
    rows = _headed(packets, "HEVC", 2)
    part = ~F.col("coded") & (F.col("own") == HEVC_FRAGMENT)
    opens, closes = part & (F.col("fragment") >= 128), part & (F.col("fragment").bitwiseAND(64) != 0)
    single, unit = ~F.col("coded") & ~part, F.col("fragment").bitwiseAND(63)
    kinds = F.col("kinds")
    seen = F.when(single, F.col("own")).when(opens | closes, unit).when(F.col("coded"), F.try_element_at(kinds, F.lit(-1)))
    rows = rows.withColumn("single", single).withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("begun", F.when(single, F.col("own")).when(opens, unit)).withColumn("seen", seen)
    rows = rows.withColumn("behind", _last(F.col("seen"), F.lit(0)) <= HEVC_SLICE)

    def access(k: Column) -> Column:
        return k.between(*HEVC_ACCESS)

    k = F.col("begun")
    begins = F.when(F.col("single"), k.isin(*HEVC_SETS) | access(k) | (k <= HEVC_SLICE) & ~F.col("behind")).otherwise(k.isNotNull() & ((k == HEVC_SETS[-1]) | (k <= HEVC_SLICE)))
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(False)))
    # of the units with start codes: slices open, sets and delimiters close
    steps = F.filter(kinds, lambda u: (u <= HEVC_SLICE) | u.isin(*HEVC_SETS))
    held = F.coalesce(F.exists(kinds, lambda u: u.isin(*HEVC_SETS) | access(u)), F.lit(False)) & F.col("coded")
    sets = F.coalesce(F.exists(kinds, lambda u: u.isin(*HEVC_SETS)), F.lit(False)) & F.col("coded")
    # one unit: what is no slice closes a frame behind a slice, if one is open or begins right here
    leaves = F.col("single") & (k > HEVC_SLICE) & F.col("behind")
    update = F.when(F.col("coded"), F.try_element_at(steps, F.lit(-1)) <= HEVC_SLICE).when(leaves, F.lit(False)).when(F.col("begins"), F.lit(True))
    rows = rows.withColumn("held", held).withColumn("sets", sets).withColumn("update", update).withColumn("open", _last(F.col("update"), F.lit(False)))
    inner = F.coalesce(F.exists(F.transform(steps, lambda u, i: u.isin(*HEVC_SETS) & (i > 0) & (F.get(steps, i - 1) <= HEVC_SLICE)), lambda x: x), F.lit(False)) & F.col("coded")
    opened = F.col("open") | F.col("begins")
    cut = F.col("opens") & opened & F.col("behind") & F.coalesce(k.isin(*HEVC_SETS), F.lit(False))
    ends = F.when(F.col("coded"), F.col("sets") & F.col("open") | inner).when(F.col("single"), opened & F.col("behind") & (k > HEVC_SLICE)).otherwise(cut)
    return _told(rows, F.col("begins") | cut | F.col("held"), ends)


def _by_unit(packets: DataFrame, codec: str, more: Column | None = None) -> DataFrame:
    rows = packets.filter(F.col("codec") == codec).withColumn("units", F.transform(unit_kinds(F.col("data"), F.col("codec")), lambda u: u["kind"]))
    units = F.coalesce("units", F.array().cast("array<int>"))
    return rows.select("stream_id", "arrival_idx", F.posexplode_outer(F.concat(units, more) if more is not None else units).alias("place", "kind"))


def _by_packet(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream_id", "arrival_idx").agg(F.coalesce(F.bool_or("starts"), F.lit(False)).alias("starts"), F.coalesce(F.bool_or("ends"), F.lit(False)).alias("ends"))


def _units_before() -> Window:
    return Window.partitionBy("stream_id").orderBy("arrival_idx", "place").rowsBetween(Window.unboundedPreceding, -1)


def av1(packets: DataFrame) -> DataFrame:
    """The same of AV1: delimiters and sequence headers begin a frame and end one that is open (a sequence header only before the
    frame's header); the first header begins one; a frame, or tiles behind a header, end it."""
    kind = F.col("kind")
    rows = _by_unit(packets, "AV1")
    header = F.when(kind == AV1_HEADER, F.lit(True)).when(kind.isin(AV1_DELIMITER, AV1_TILES, AV1_FRAME), F.lit(False))
    rows = rows.withColumn("headed", F.coalesce(F.last(header, ignorenulls=True).over(_units_before()), F.lit(False)))
    update = F.when(kind.isin(AV1_DELIMITER, AV1_SEQUENCE) | (kind == AV1_HEADER) & ~F.col("headed"), F.lit(True)).when((kind == AV1_FRAME) | (kind == AV1_TILES) & F.col("headed"), F.lit(False))
    rows = rows.withColumn("open", F.coalesce(F.last(update, ignorenulls=True).over(_units_before()), F.lit(False)))
    starts = kind.isin(AV1_DELIMITER, AV1_SEQUENCE) | kind.isin(AV1_HEADER, AV1_FRAME) & ~F.col("headed")
    ends = (kind == AV1_FRAME) | (kind == AV1_TILES) & F.col("headed") | (kind == AV1_DELIMITER) & F.col("open") | (kind == AV1_SEQUENCE) & F.col("open") & ~F.col("headed")
    return _by_packet(rows.withColumn("starts", starts).withColumn("ends", ends))


def jpegxs(packets: DataFrame, closes: Column) -> DataFrame:
    """The same of JPEG XS: a start marker, or a picture header outside of a frame, begins one; an end marker, a further start, or a
    packet flagged as a frame's end (``closes``) ends the one that is open."""
    kind = F.col("kind")
    rows = _by_unit(packets, "JPEGXS", F.when(closes & (F.length("data") > 1), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    update = F.when(kind.isin(XS_START, XS_PICTURE), F.lit(True)).when(kind.isin(XS_END, -1), F.lit(False))
    rows = rows.withColumn("open", F.coalesce(F.last(update, ignorenulls=True).over(_units_before()), F.lit(False)))
    return _by_packet(rows.withColumn("starts", (kind == XS_START) | (kind == XS_PICTURE) & ~F.col("open")).withColumn("ends", kind.isin(XS_START, XS_END, -1) & F.col("open")))


def detected(packets: DataFrame, closes: Column) -> DataFrame:
    """stream_id, arrival_idx, starts and ends of packets of all four codecs."""
    return h264(packets).unionByName(hevc(packets)).unionByName(av1(packets)).unionByName(jpegxs(packets, closes))


def av1_frame_type(units: Column) -> Column:
    """The type of a frame from its units (see ``unit_kinds``): the first sequence header, frame header or frame tells; a frame shown
    again is P."""
    first = F.get(F.filter(units, lambda u: u["kind"].isin(AV1_SEQUENCE, AV1_HEADER, AV1_FRAME)), F.lit(0))
    told = F.get(F.lit(["IDR", "P", "I", "P"]), F.shiftright(first["head"], 5).bitwiseAND(3))
    return F.when(first["kind"] == AV1_SEQUENCE, "SPS").when(first["head"] < 128, told).otherwise("P")


def h264_frame_type(fields: Column) -> Column:
    """The type of a frame from its units (see ``h264_fields``): IDR only with an intra slice in an IDR unit, I for an IDR unit whose
    slices can't be read, else by the first slice type that can, else SPS or PPS if there are only sets, else P."""
    def has(kind: int) -> Column:
        return F.exists(fields, lambda u: u["kind"] == kind)

    def slice_type(u: Column) -> Column:
        # an IDR unit of its header alone counts as an intra slice
        return F.when((u["kind"] == H264_IDR) & (u["problem"] == "length"), F.lit(2)).when(u["slice_type"] <= 9, u["slice_type"])

    known = F.filter(F.transform(F.filter(fields, lambda u: u["kind"].isin(*H264_SLICES)), slice_type), lambda t: t.isNotNull())
    intra = F.exists(fields, lambda u: (u["kind"] == H264_IDR) & u["slice_type"].isin(2, 7))
    kind = F.get(F.lit(["P", "B", "I", "P", "I"]), F.get(known, F.lit(0)) % 5)
    none = F.size(known) == 0
    return F.when(F.coalesce(intra, F.lit(False)), "IDR").when(has(H264_IDR) & none, "I").when(none & has(H264_SPS), "SPS").when(none & has(H264_PPS), "PPS").otherwise(F.coalesce(kind, F.lit("P")))


#: HEVC types that H.264 lacks, H.264 types of payloads, AV1 types.
HEVC_ONLY, H264_ANY, AV1_ANY = (32, 49), (1, 29), (1, 8)


def payload_codec(data: Column, payload_type: Column, known: Column) -> Column:
    """The codec of a payload (binary): what a session description says of its payload type (``known``, a map), else what its first
    bytes look like: HEVC by types that H.264 lacks and a temporal id, H.264 by any of its types, AV1 by what is left; null if it is
    none or has fewer than two bytes."""
    h = F.hex(data)
    head, second = number(h, 0, 1), number(h, 1, 1)
    hevc = F.shiftright(head, 1).bitwiseAND(63).between(*HEVC_ONLY) & (second.bitwiseAND(7) > 0)
    obu = F.shiftright(head, 3).bitwiseAND(15).between(*AV1_ANY) & (F.length(data) >= 4)
    looks = F.when(hevc, "HEVC").when(head.bitwiseAND(31).between(*H264_ANY), "H264").when(obu, "AV1")
    return F.coalesce(F.try_element_at(known, payload_type), F.when((head < 128) & second.isNotNull(), looks))
