"""Queries over the bytes of four codecs: depacketizing, frame boundaries, frame types, slices and the sets that they need. The
packet rows are written as bytes first, many of them damaged; what was written is what the SQL side knows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import parsing, wire
from tidewire.functions.units import chunked_crc, frame_problem, h264_fields, unit_kinds
from tidewire.functions.wire import hexed
from tidewire.operators import boundaries, parameters, payloads
from tidewire.sources.projections import packets
from tidewire.sources.session import shipped

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add

_Q = "((seq + 36) % 65536)"
_GAP = "coalesce((seq - lag(seq) OVER w + 65536) % 65536 <> 1, false)"


def _which(cases: list, q: Column) -> Column:
    out = F.when(q == 0, cases[0])
    for k, c in enumerate(cases[1:], 1):
        out = out.when(q == k, c)
    return out


@add(206, sql=WITH + f""", x AS (SELECT stream_id, arrival_idx, seq, event_id AS e, {_Q} % 8 AS q, printf('%08X', event_id) AS b FROM packets WHERE event_id % 31 <> 0),
g AS (SELECT *, {_GAP} AS gap, sum(CASE WHEN q = 2 THEN 1 ELSE 0 END) OVER w AS run FROM x WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
p AS (SELECT *, bool_or(gap AND q <> 2) OVER w AS broken, coalesce(bool_or(q = 5) OVER v, false) AS over, NOT coalesce(bool_or(gap AND q <> 2) OVER v, false) AND run > 0 AS kept FROM g
 WINDOW w AS (PARTITION BY stream_id, run ORDER BY arrival_idx), v AS (PARTITION BY stream_id, run ORDER BY arrival_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(CASE WHEN q = 0 OR q = 5 AND e % 4 = 0 AND NOT (gap AND kept AND NOT over) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS begun FROM p),
u AS (SELECT stream_id, arrival_idx, begun, i - 1 AS place, units[i] AS obu FROM (SELECT *, CASE WHEN q = 0 THEN ['10', '08' || b] WHEN q = 1 AND e % 7 <> 0 THEN ['30' || b, '28' || b] WHEN q = 6 THEN [CASE WHEN e % 2 = 0 THEN '90' ELSE '10' END]
 WHEN q = 7 AND e % 5 <> 0 THEN ['', '20' || b, '78' || b] END AS units FROM n), unnest(range(1, len(units) + 1)) AS t(i)
 UNION ALL SELECT stream_id, max(arrival_idx), max(begun), 0, '30' || string_agg(b, '' ORDER BY arrival_idx) FROM n WHERE q BETWEEN 2 AND 5 AND run > 0 AND NOT broken AND NOT over GROUP BY stream_id, run HAVING bool_or(q = 5)),
k AS (SELECT *, CASE WHEN obu IN ('', '90') THEN NULL ELSE CAST(strpos('0123456789ABCDEF', obu[1]) - 1 AS INT) * 2 + CASE WHEN obu[2] = '8' THEN 1 ELSE 0 END END AS kind FROM u),
s AS (SELECT *, coalesce(kind = 2, false) OR coalesce(begun <> lag(begun) OVER w, true) AS begins FROM k WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx, place))
SELECT stream_id, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx, place) AS BIGINT) AS unit, arrival_idx, CAST(place AS INT) AS place, CAST(kind AS INT) AS kind, obu FROM s""")
def av1_units(spark, sf_dir):
    """AV1 payloads: with a count, with sizes (of one or two bytes), units cut over four packets, delimiters, empty and forbidden
    units, sizes that do not fit, and packets without bytes."""
    shipped(spark)
    q, e = F.pmod(F.col("seq") + 36, F.lit(8)), F.col("event_id")
    b = hexed(e, 8)
    listed = F.concat(F.lit("00"), F.when(e % 3 == 0, "8500").otherwise("05"), F.lit("30"), b, F.when(e % 7 == 0, "09").otherwise("05"), F.lit("28"), b)
    three = F.when(e % 5 == 0, F.concat(F.lit("307F"), b)).otherwise(F.concat(F.lit("30000520"), b, F.lit("78"), b))
    cases = [F.concat(F.lit("28011008"), b), listed, F.concat(F.lit("4030"), b), F.concat(F.lit("C0"), b), F.concat(F.lit("C0"), b), F.concat(F.when(e % 4 == 0, "88").otherwise("80"), b), F.when(e % 2 == 0, "1090").otherwise("1010"), three]
    data = F.unhex(F.when(e % 31 == 0, "").otherwise(_which(cases, q)))
    made = payloads.av1_units(packets(spark, sf_dir).select("stream_id", "arrival_idx", "seq", data.alias("data")))
    return made.withColumn("obu", F.hex("obu"))


@add(207, sql=WITH + f""", x AS (SELECT stream_id, arrival_idx, seq, event_id AS e, {_Q} % 4 AS q, ({_Q} // 4 * 4099) % 16777216 AS f, printf('%08X', event_id) AS b FROM packets WHERE event_id % 13 <> 0),
g AS (SELECT *, {_GAP} AS gap, q = 0 AND e % 19 <> 0 OR f <> coalesce(lag(f) OVER w, 0) AS begins, last_value(CASE WHEN e % 3 = 0 THEN 16 * (1 + e % 4) + 10 END IGNORE NULLS) OVER w AS profile FROM x WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
r AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS run FROM g),
p AS (SELECT *, bool_or(gap AND NOT begins) OVER w AS broken, coalesce(bool_or(q = 3 AND e % 11 <> 0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM r WINDOW w AS (PARTITION BY stream_id, run ORDER BY arrival_idx))
SELECT stream_id, max(arrival_idx) AS arrival_idx, CAST(max(f) AS BIGINT) AS frame, CAST(arg_max(coalesce(profile, -1), arrival_idx) AS BIGINT) AS profile, count(*) AS packets, string_agg(b, '' ORDER BY arrival_idx) AS data
 FROM p WHERE NOT broken AND NOT over AND e % 11 <> 0 GROUP BY stream_id, run HAVING bool_or(q = 3)""")
def xs_frames(spark, sf_dir):
    """JPEG XS payloads: frames of four packets, some with an extended header, without their first flag, without data, or too short."""
    n, e = F.pmod(F.col("seq") + 36, F.lit(65536)), F.col("event_id")
    q, more = n % 4, e % 3 == 0
    flags = F.when((q == 0) & (e % 19 != 0), 128).otherwise(0) + F.when(q == 3, 64).otherwise(0) + F.when(more, 4).otherwise(0)
    head = F.concat(hexed(flags.cast("long"), 2), hexed((F.floor(n / 4) * 4099 % (1 << 24)).cast("long"), 6), F.when(more, F.concat(F.lit("0001"), hexed(16 * (1 + e % 4) + 10, 2), F.lit("40"))).otherwise(""))
    h = F.when(e % 13 == 0, F.when(more, F.substring(head, 1, 12)).otherwise(F.substring(head, 1, 6))).otherwise(F.concat(head, F.when(e % 11 == 0, "").otherwise(hexed(e, 8))))
    made = payloads.xs_frames(packets(spark, sf_dir).select("stream_id", "arrival_idx", "seq", h.alias("h")))
    return made.withColumn("profile", F.coalesce("profile", F.lit(-1))).withColumn("data", F.hex("data"))


# Frame boundaries: what each of ten packets of a codec is written as.
_H264 = ["09F0", ("67420A", "68CE38"), "68CE38", "6588", "419A", "0605", ("7C85", "7C81"), "7C41", ("0000000109F000000001419A", "00000167420A0000000168CE380000016588"), ("7CA5", "7C", "")]
_HEVC = ["460150", ("400101", "420101"), "440101", "2601AF", "0201D0", "4E0105", ("620193", "620181"), "620141", ("00000001460150000000010201D0", "0000010201D0000001460150"), ("02", "6201", "0001E0")]
_AV1 = ["12000A02AABB1A0110", "2201CC", "320120", "1A0150", "1200", "0A01AA", "2201CC320120", ("9200", "1A02AA"), ("3460AA", "34600A"), "7A0100320120"]
_XS = ["FF10FF150004AAAA", "0102", "FF11", "FF150004AAAA", "FF10", "01FF", "FF11FF10", "FF120004BBBBFF11", "AA", ("FF", "")]


def _data(cases: list) -> Column:
    e = F.col("event_id")
    return _which([F.get(F.lit(list(c)), (F.floor(e / 10) % len(c)).cast("int")) if isinstance(c, tuple) else F.lit(c) for c in cases], e % 10)


def _coded(spark, sf_dir):
    s = F.col("stream_id") % 4
    data = F.when(s == 0, _data(_H264)).when(s == 1, _data(_HEVC)).when(s == 2, _data(_AV1)).otherwise(_data(_XS))
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", "event_id", F.get(F.lit(["H264", "HEVC", "AV1", "JPEGXS"]), s.cast("int")).alias("codec"), F.unhex(data).alias("data"))


_K = WITH + ", k AS (SELECT stream_id, arrival_idx, event_id AS e, event_id % 10 AS q, event_id // 10 % 2 AS two, event_id // 10 % 3 AS three FROM packets WHERE stream_id % 4 = {s})"
_V = "(PARTITION BY stream_id ORDER BY arrival_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@add(210, sql=_K.format(s=0) + f""",
t AS (SELECT *, CASE q WHEN 0 THEN 9 WHEN 1 THEN 7 + two WHEN 2 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 1 WHEN 5 THEN 6 WHEN 6 THEN CASE WHEN two = 0 THEN 5 ELSE 1 END END AS begun, CASE WHEN q = 7 THEN 1 END AS closed FROM k),
l AS (SELECT *, coalesce(last_value(coalesce(begun, closed) IGNORE NULLS) OVER {_V}, 0) AS last FROM t),
o AS (SELECT *, coalesce(begun IN (5, 7, 8, 9) OR begun BETWEEN 1 AND 5 AND NOT last BETWEEN 0 AND 5, false) AS own FROM l),
p AS (SELECT *, own OR coalesce(last_value(CASE WHEN q = 8 THEN two = 1 WHEN own THEN true END IGNORE NULLS) OVER {_V}, false) AS open FROM o),
e AS (SELECT *, coalesce(open AND last BETWEEN 1 AND 5 AND begun IN (6, 7, 8, 9), false) AS cut FROM p)
SELECT stream_id, arrival_idx, own OR cut OR q = 8 AS starts, cut OR q = 8 AS ends FROM e""")
def h264_boundaries(spark, sf_dir):
    """Where frames of H.264 begin and end: single units, fragments (also reserved and cut-off ones), and units behind start codes."""
    shipped(spark)
    return boundaries.h264(_coded(spark, sf_dir))


@add(211, sql=_K.format(s=1) + f""",
t AS (SELECT *, CASE q WHEN 0 THEN 35 WHEN 1 THEN 32 + two WHEN 2 THEN 34 WHEN 3 THEN 19 WHEN 4 THEN 1 WHEN 5 THEN 39 WHEN 6 THEN CASE WHEN two = 0 THEN 19 ELSE 1 END WHEN 9 THEN CASE WHEN three = 2 THEN 0 END END AS begun, CASE WHEN q = 7 THEN 1 WHEN q = 8 THEN CASE WHEN two = 0 THEN 1 ELSE 35 END END AS closed FROM k),
l AS (SELECT *, coalesce(last_value(coalesce(begun, closed) IGNORE NULLS) OVER {_V}, 0) <= 31 AS behind FROM t),
b AS (SELECT *, coalesce(CASE WHEN q = 6 THEN true ELSE begun BETWEEN 32 AND 35 OR begun BETWEEN 16 AND 23 OR begun <= 31 AND NOT behind END, false) AS own FROM l),
o AS (SELECT *, coalesce(last_value(CASE WHEN q = 8 THEN two = 0 WHEN q <> 6 AND begun > 31 AND behind THEN false WHEN own THEN true END IGNORE NULLS) OVER {_V}, false) AS open FROM b)
SELECT stream_id, arrival_idx, own OR q = 8 AS starts, CASE WHEN q = 8 THEN open OR two = 1 ELSE coalesce(q <> 6 AND (open OR own) AND behind AND begun > 31, false) END AS ends FROM o""")
def hevc_boundaries(spark, sf_dir):
    """The same of HEVC, whose packets may be too short for a header."""
    shipped(spark)
    return boundaries.hevc(_coded(spark, sf_dir))


_BY_UNIT = """, u AS (SELECT *, unnest(units) AS kind, unnest(range(len(units))) AS place FROM c), {rules}
SELECT c.stream_id, c.arrival_idx, coalesce(bool_or(starts), false) AS starts, coalesce(bool_or(ends), false) AS ends FROM c LEFT JOIN f ON f.stream_id = c.stream_id AND f.arrival_idx = c.arrival_idx GROUP BY ALL"""
_W = "(PARTITION BY stream_id ORDER BY arrival_idx, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@add(211, sql=_K.format(s=2) + ", c AS (SELECT *, CASE q WHEN 0 THEN [2, 1, 3] WHEN 1 THEN [4] WHEN 2 THEN [6] WHEN 3 THEN [3] WHEN 4 THEN [2] WHEN 5 THEN [1] WHEN 6 THEN [4, 6] WHEN 8 THEN [6] WHEN 9 THEN [15] ELSE [] END AS units FROM k)" + _BY_UNIT.format(rules=f"""
h AS (SELECT *, coalesce(last_value(CASE WHEN kind = 3 THEN true WHEN kind IN (2, 4, 6) THEN false END IGNORE NULLS) OVER {_W}, false) AS headed FROM u),
o AS (SELECT *, coalesce(last_value(CASE WHEN kind IN (1, 2) OR kind = 3 AND NOT headed THEN true WHEN kind = 6 OR kind = 4 AND headed THEN false END IGNORE NULLS) OVER {_W}, false) AS open FROM h),
f AS (SELECT *, kind IN (1, 2) OR kind IN (3, 6) AND NOT headed AS starts, kind = 6 OR kind = 4 AND headed OR kind = 2 AND open OR kind = 1 AND open AND NOT headed AS ends FROM o)"""))
def av1_boundaries(spark, sf_dir):
    """The same of AV1: units with and without sizes, extensions, forbidden bits, cut-off units, and padding."""
    shipped(spark)
    return boundaries.av1(_coded(spark, sf_dir))


@add(211, sql=_K.format(s=3) + ", c AS (SELECT *, CASE q WHEN 0 THEN [16, 21] WHEN 2 THEN [17] WHEN 3 THEN [21] WHEN 4 THEN [16] WHEN 6 THEN [17, 16] WHEN 7 THEN [18, 17] ELSE [] END || CASE WHEN e % 7 = 0 AND q < 8 THEN [-1] ELSE [] END AS units FROM k)" + _BY_UNIT.format(rules=f"""
o AS (SELECT *, coalesce(last_value(CASE WHEN kind IN (16, 21) THEN true WHEN kind IN (17, -1) THEN false END IGNORE NULLS) OVER {_W}, false) AS open FROM u),
f AS (SELECT *, kind = 16 OR kind = 21 AND NOT open AS starts, kind IN (16, 17, -1) AND open AS ends FROM o)"""))
def xs_boundaries(spark, sf_dir):
    """The same of JPEG XS: its markers, and packets flagged as the end of a frame."""
    shipped(spark)
    return boundaries.jpegxs(_coded(spark, sf_dir), F.col("event_id") % 7 == 0)


@add(53, sql=_K.format(s=2) + " SELECT stream_id, arrival_idx, CASE q WHEN 0 THEN 'SPS' WHEN 2 THEN 'P' WHEN 3 THEN 'I' WHEN 5 THEN 'SPS' WHEN 6 THEN 'P' WHEN 8 THEN CASE two WHEN 0 THEN 'P' ELSE 'IDR' END ELSE 'P' END AS frame_type FROM k")
def av1_frame_types(spark, sf_dir):
    """Frame types from the headers of AV1 units."""
    shipped(spark)
    rows = _coded(spark, sf_dir).filter("codec = 'AV1'")
    return rows.select("stream_id", "arrival_idx", boundaries.av1_frame_type(unit_kinds(F.col("data"), F.col("codec"))).alias("frame_type"))


# Frames of H.264 units: what each of twelve is written as. (first macroblock, slice type, picture set) of a slice.
def _frames(spark, sf_dir):
    """Frames (units) with sets of changing numbers and slices that need them; some slices can't be read, some codes need escapes."""
    e = F.col("event_id")
    k = F.floor(e / 12)
    ue, one = wire.exp_golomb_bits, F.lit("1")

    def unit(head: str, bits: Column) -> Column:
        return F.concat(F.lit(head), parsing.bits_to_hex(F.concat(bits, one)))

    def slice_of(head: str, first: Column, kind: Column, pps: Column) -> Column:
        return unit(head, F.concat(ue(first), ue(kind), ue(pps)))

    profile = F.when(k % 2 == 0, "42001F").when(k % 3 == 0, "2C001F").otherwise("64000A")
    sps = F.concat(F.lit("67"), profile, parsing.bits_to_hex(F.concat(ue(k % 3), one)))
    pps = unit("68", F.concat(ue(k % 4), ue(k % 3)))
    zero = F.lit(0)
    cases = [
        F.array(sps, pps, slice_of("65", zero, zero + 7, k % 4)), F.array(slice_of("41", zero, zero + 5, zero)), F.array(slice_of("01", zero, zero + 1, zero + 1)),
        F.array(unit("68", F.concat(ue(zero + 5), ue(zero + 3)))), F.array(slice_of("41", zero, zero, zero + 2)), F.array(slice_of("41", zero, zero + 11, zero)),
        F.array(F.lit("0605FF"), F.lit("09F0")), F.array(slice_of("41", zero, zero, zero + 300)), F.array(F.lit("41")), F.array(sps), F.array(F.lit("0605"), slice_of("41", zero, zero, F.when(k % 5 == 0, 5).otherwise(3))),
        F.array(slice_of("41", F.lit((1 << 22) - 1), zero, zero), slice_of("41", zero, zero, zero + 300)),
    ]
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", F.posexplode(_which(cases, e % 12)).alias("place", "u")).withColumn("u", wire.escaped(F.unhex("u"))).groupBy("stream_id", "arrival_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "u"))), lambda x: x["u"]).alias("units"))


_F = WITH + """, x AS (SELECT stream_id, arrival_idx, event_id % 12 AS q, event_id // 12 AS k FROM packets),
n AS (SELECT *, CASE q WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 1 WHEN 4 THEN 0 WHEN 7 THEN 0 WHEN 10 THEN 0 WHEN 11 THEN 0 END AS slice_type, CASE q WHEN 0 THEN k % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 10 THEN CASE WHEN k % 5 = 0 THEN 5 ELSE 3 END WHEN 11 THEN 0 END AS pps,
 CASE WHEN q IN (0, 9) THEN k % 3 END AS sps_set, CASE q WHEN 0 THEN k % 4 WHEN 3 THEN 5 END AS pps_set, CASE q WHEN 0 THEN k % 3 WHEN 3 THEN 3 END AS refers FROM x),
s AS (SELECT n.*, (SELECT arg_max(p.refers, p.arrival_idx) FROM n p WHERE p.stream_id = n.stream_id AND p.arrival_idx <= n.arrival_idx AND p.pps_set = n.pps) AS sps FROM n),
t AS (SELECT s.*, EXISTS (SELECT 1 FROM n p WHERE p.stream_id = s.stream_id AND p.arrival_idx <= s.arrival_idx AND p.sps_set = s.sps) AS there, EXISTS (SELECT 1 FROM n p WHERE p.stream_id = s.stream_id AND p.arrival_idx <= s.arrival_idx AND p.sps_set IS NOT NULL) AS other FROM s),
r AS (SELECT *, CASE WHEN q IN (3, 6, 9) THEN 'no slice' WHEN q = 5 THEN 'unreadable slice type' WHEN q = 7 THEN 'unreadable pps' WHEN q = 8 THEN 'unreadable length' WHEN sps IS NULL THEN 'missing pps' WHEN there THEN 'ready' WHEN other THEN 'fallback' ELSE 'missing sps' END AS status FROM t)
"""
_SESSIONS = """, c AS (SELECT *, CASE WHEN q = 0 THEN 's' || k % 3 || CASE WHEN k % 2 = 0 THEN 'a' WHEN k % 3 = 0 THEN 'b' ELSE 'c' END || 'p' || k % 4 || k % 3 WHEN q = 3 THEN 'p5' WHEN q = 9 THEN 's' || k % 3 || CASE WHEN k % 2 = 0 THEN 'a' WHEN k % 3 = 0 THEN 'b' ELSE 'c' END END AS config FROM r),
d AS (SELECT *, config IS NOT NULL AND config IS DISTINCT FROM last_value(config IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY arrival_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS changed FROM c),
e AS (SELECT *, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS BIGINT) AS session FROM d)
"""


@add(100, sql=_F + "SELECT stream_id, arrival_idx, CAST(slice_type AS INT) AS slice_type, CAST(pps AS BIGINT) AS pps, CAST(sps AS BIGINT) AS sps, status FROM r")
def slice_requirements(spark, sf_dir):
    """The picture and sequence sets that each frame's first slice needs, and whether they are known."""
    shipped(spark)
    return parameters.requirements(_frames(spark, sf_dir))


@add(51, sql=WITH + "SELECT stream_id, arrival_idx, CASE event_id % 12 WHEN 0 THEN 'IDR' WHEN 2 THEN 'B' WHEN 3 THEN 'PPS' WHEN 9 THEN 'SPS' ELSE 'P' END AS frame_type FROM packets")
def h264_frame_types(spark, sf_dir):
    """Frame types from slices, and of frames that hold sets only."""
    shipped(spark)
    return _frames(spark, sf_dir).select("stream_id", "arrival_idx", boundaries.h264_frame_type(h264_fields(F.col("units"))).alias("frame_type"))


@add(152, sql=_F + _SESSIONS + "SELECT stream_id, session, count(*) AS frames, count(*) FILTER (WHERE status IN ('ready', 'fallback')) AS decodable, count(*) FILTER (WHERE status IN ('ready', 'fallback')) / count(*) AS rate FROM e GROUP BY stream_id, session")
def decodability_rates(spark, sf_dir):
    """The share of frames that could be decoded with what was known, a stream and encoder session."""
    shipped(spark)
    frames = _frames(spark, sf_dir)
    rows = parameters.requirements(frames).join(parameters.sessions(frames).select("stream_id", "arrival_idx", "session"), ["stream_id", "arrival_idx"])
    n = F.count_if(parameters.decodable(F.col("status")))
    return rows.groupBy("stream_id", "session").agg(F.count(F.lit(1)).alias("frames"), n.alias("decodable"), (n / F.count(F.lit(1))).alias("rate"))


@add(110, sql=_F + _SESSIONS + """, q AS (SELECT stream_id, session, CASE WHEN q = 0 THEN 1.0 ELSE 0.5 END AS quality FROM e WHERE changed),
m AS (SELECT e.stream_id, e.arrival_idx, e.session, max(ROW(q.quality, q.session)) AS best FROM e LEFT JOIN q ON q.stream_id = e.stream_id AND q.session BETWEEN e.session - 3 AND e.session GROUP BY ALL)
SELECT stream_id, arrival_idx, session, CAST(coalesce(best[1], 0) AS DOUBLE) AS quality, CAST(session - best[2] AS INT) AS age FROM m""")
def parameter_matches(spark, sf_dir):
    """The best of the current and the last three sessions for each frame, by the sets that they brought."""
    shipped(spark)
    return parameters.matches(_frames(spark, sf_dir))


@add(111, sql=_F + """, l AS (SELECT r.*, (SELECT arg_max(p.k, p.arrival_idx) FROM n p WHERE p.stream_id = r.stream_id AND p.arrival_idx <= r.arrival_idx AND p.sps_set IS NOT NULL) AS last, EXISTS (SELECT 1 FROM n p WHERE p.stream_id = r.stream_id AND p.arrival_idx <= r.arrival_idx AND p.pps_set IS NOT NULL) AS any_pps FROM r WHERE status IN ('missing pps', 'missing sps', 'fallback'))
SELECT stream_id, arrival_idx, CASE WHEN fits THEN 'compatible' WHEN two_sets THEN 'approximate' ELSE 'generic' END AS strategy, CAST(CASE WHEN fits THEN 0.85 WHEN two_sets THEN 0.7 ELSE 0.3 END AS DOUBLE) AS quality, CAST(CASE WHEN fits THEN 1 WHEN two_sets THEN 0.75 ELSE 0.5 END AS DOUBLE) AS success
 FROM (SELECT *, last IS NOT NULL AND any_pps AS two_sets, last IS NOT NULL AND any_pps AND pps = 0 AND coalesce(sps, 0) = 0 AND last % 2 = 0 AS fits FROM l) t""")
def parameter_fallbacks(spark, sf_dir):
    """What stands in for the sets of frames that lack them."""
    shipped(spark)
    return parameters.fallbacks(_frames(spark, sf_dir))


@add(76, 77, sql=WITH + """SELECT stream_id, arrival_idx, CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN event_id % 211 = 1 THEN 'units' WHEN event_id % 5 = 1 THEN 'forbidden' WHEN event_id % 5 = 2 THEN 'empty' END AS problem FROM packets""")
def unit_validity(spark, sf_dir):
    """Frames of units that are empty, too many, or have the forbidden bit."""
    e = F.col("event_id")
    good = F.unhex(F.concat(F.lit("41"), hexed(e, 8)))
    second = F.when(e % 5 == 1, F.unhex(F.lit("C101"))).when(e % 5 == 2, F.unhex(F.lit(""))).otherwise(good)
    units = F.when(e % 7 == 0, F.array().cast("array<binary>")).when(e % 211 == 1, F.array_repeat(good, 1001)).otherwise(F.array(good, second))
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", frame_problem(units).alias("problem"))


@add(68, 69, sql=WITH + """, t AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS b(i)),
x AS (SELECT stream_id, arrival_idx, hex(encode(event_type || event_id || repeat(event_type, CAST(event_id % 9 AS INT)))) AS x FROM packets)
SELECT stream_id, arrival_idx, CAST(xor(4294967295, list_reduce(list_transform(range(1, CAST(length(x) AS BIGINT), 2), lambda i: CAST(strpos('0123456789ABCDEF', x[i]) - 1 AS BIGINT) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) AS BIGINT) AS crc FROM x, t""")
def chunked_checksums(spark, sf_dir):
    """The CRC-32 of payloads from those of their chunks, none of which sees the others."""
    shipped(spark)
    chunks = F.array(F.col("event_type"), F.col("event_id").cast("string"), F.expr("repeat(event_type, cast(event_id % 9 as int))"))
    parts = F.transform(chunks, lambda c: F.struct(F.crc32(c.cast("binary")).alias("crc"), F.octet_length(c).cast("long").alias("size")))
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", chunked_crc(parts).alias("crc"))


@add(44, sql=WITH + """, x AS (SELECT stream_id, arrival_idx, event_id % 256 AS a, event_id // 3 % 256 AS b, 1 + event_id % 5 AS n, 96 + event_id % 13 AS pt FROM packets)
SELECT stream_id, arrival_idx, CASE pt WHEN 97 THEN 'H264' WHEN 100 THEN 'HEVC' ELSE CASE WHEN n < 2 OR a >= 128 THEN NULL WHEN a // 2 % 64 BETWEEN 32 AND 49 AND b % 8 > 0 THEN 'HEVC' WHEN a % 32 BETWEEN 1 AND 29 THEN 'H264' WHEN n >= 4 AND a // 8 % 16 BETWEEN 1 AND 8 THEN 'AV1' END END AS codec FROM x""")
def payload_codecs(spark, sf_dir):
    """Codecs of payloads of one to five bytes, by their payload type where a session names it, else by their first bytes."""
    e = F.col("event_id")
    data = F.unhex(F.concat(hexed(e % 256, 2), F.when(e % 5 > 0, hexed((F.floor(e / 3) % 256).cast("long"), 2)).otherwise(""), F.repeat(F.lit("00"), (e % 5 - 1).cast("int"))))
    known = F.create_map(F.lit(97), F.lit("H264"), F.lit(100), F.lit("HEVC"))
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", boundaries.payload_codec(data, (F.lit(96) + e % 13).cast("int"), known).alias("codec"))


@add(151, sql=_F + """, p AS (SELECT stream_id, pps_set, arg_max(refers, arrival_idx) AS sps FROM n WHERE pps_set IS NOT NULL GROUP BY ALL), k AS (SELECT DISTINCT stream_id, sps_set FROM n WHERE sps_set IS NOT NULL)
SELECT p.stream_id, count(*) AS picture_sets, count(k.sps_set) AS covered, count(k.sps_set) / count(*) AS coverage FROM p LEFT JOIN k ON k.stream_id = p.stream_id AND k.sps_set = p.sps GROUP BY p.stream_id""")
def parameter_coverage(spark, sf_dir):
    """The share of each stream's picture sets whose sequence set is there."""
    shipped(spark)
    return parameters.coverage(_frames(spark, sf_dir))
