"""Queries over packets in their binary form, which is made from the packet rows first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import wire
from tidewire.operators import gops
from tidewire.sources.projections import packets, table
from tidewire.sources.session import shipped

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add(74, sql=WITH + "SELECT stream_id, arrival_idx, true AS sync, false AS error, event_id % 3 = 0 AS starts, stream_id % 4096 + 256 AS pid, CAST(1 AS BIGINT) AS control, CAST(seq % 16 AS BIGINT) AS counter FROM packets")
def transport_headers(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("data", wire.ts_header(F.col("stream_id") % 4096 + 256, (F.col("seq") % 16).cast("long"), F.col("event_id") % 3 == 0))
    return rows.select("stream_id", "arrival_idx", *[v.alias(k) for k, v in wire.ts_fields(F.col("data")).items()])


@add(27, 28, sql=WITH + "SELECT stream_id, arrival_idx, pts, CASE WHEN frame_type = 'B' THEN pts ELSE dts END AS dts FROM packets")
def elementary_timestamps(spark, sf_dir):
    """PTS and DTS of PES headers; without a DTS it is the PTS."""
    has = F.col("frame_type") != "B"
    header = F.when(has, F.concat(F.unhex(F.lit("C0")), wire.timestamp_bytes(F.col("pts"), 3), wire.timestamp_bytes(F.col("dts"), 1))).otherwise(F.concat(F.unhex(F.lit("80")), wire.timestamp_bytes(F.col("pts"), 2)))
    rows = packets(spark, sf_dir).withColumn("h", header)
    both = F.shiftright(wire.byte(F.col("h"), 0), 6) == 3
    return rows.select("stream_id", "arrival_idx", wire.timestamp(F.col("h"), 1).alias("pts"), F.when(both, wire.timestamp(F.col("h"), 6)).otherwise(wire.timestamp(F.col("h"), 1)).alias("dts"))


@add(65, 66, sql=WITH + "SELECT stream_id, arrival_idx, pts AS value, CAST(greatest(1, ceil(length(bin(pts)) / 7.0)) AS INTEGER) AS n_bytes FROM packets")
def leb128_numbers(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("data", wire.leb128(F.col("pts")))
    return rows.select("stream_id", "arrival_idx", wire.leb128_value(F.col("data")).alias("value"), F.length("data").alias("n_bytes"))


@add(55, sql=WITH + "SELECT stream_id, arrival_idx, size AS ue, CASE WHEN size % 2 = 1 THEN (size + 1) // 2 ELSE -(size // 2) END AS se FROM packets")
def exp_golomb_numbers(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("bits", F.concat(wire.exp_golomb_bits(F.col("size")), F.bin("event_id"))).withColumn("ue", wire.exp_golomb(F.col("bits")))
    return rows.select("stream_id", "arrival_idx", "ue", wire.signed_golomb(F.col("ue")).alias("se"))


@add(62, 63, 64, sql=WITH + "SELECT stream_id, arrival_idx, true AS restored, CAST(12 AS INTEGER) AS n FROM packets")
def emulation_prevention(spark, sf_dir):
    shipped(spark)
    data = F.unhex(F.concat(wire.hexed(F.col("stream_id"), 8), wire.hexed(F.col("event_id") % 4, 8), wire.hexed(F.col("arrival_idx"), 8)))
    rows = packets(spark, sf_dir).withColumn("data", data).withColumn("back", wire.unescaped(wire.escaped("data")))
    return rows.select("stream_id", "arrival_idx", (F.col("back") == F.col("data")).alias("restored"), F.length("back").alias("n"))


@add(32, 50, 51, sql=WITH + "SELECT stream_id, arrival_idx, CAST(CASE WHEN frame_type = 'IDR' THEN 3 ELSE 1 END AS INTEGER) AS n_units, frame_type, frame_type = 'IDR' AS has_parameter_sets FROM packets")
def nal_units(spark, sf_dir):
    """Annex B streams cut into units, and the frame type from their types: a keyframe slice is 5, a
    reference slice has importance, parameter sets are 7 and 8."""
    shipped(spark)
    body = F.concat(F.lit("88"), wire.hexed(F.col("event_id") + 0x11111111, 8))  # no zero bytes, so no start code
    code = F.lit("00000001")
    text = F.when(F.col("frame_type") == "IDR", F.concat(code, F.lit("6742001F"), code, F.lit("68CE3880"), code, F.lit("65"), body)).when(F.col("frame_type") == "P", F.concat(code, F.lit("41"), body)).otherwise(F.concat(code, F.lit("01"), body))
    rows = packets(spark, sf_dir).withColumn("units", wire.nal_units(F.unhex(text)))
    heads = F.transform("units", lambda u: F.conv(F.hex(F.substring(u, 1, 1)), 16, 10).cast("int"))
    rows = rows.withColumn("kinds", F.transform(heads, lambda h: h.bitwiseAND(31))).withColumn("ref", F.transform(heads, lambda h: h.bitwiseAND(0x60)))
    kind = F.when(F.array_contains("kinds", 5), "IDR").when(F.exists("ref", lambda r: r > 0), "P").otherwise("B")
    return rows.select("stream_id", "arrival_idx", F.size("units").alias("n_units"), kind.alias("frame_type"), (F.array_contains("kinds", 7) & F.array_contains("kinds", 8)).alias("has_parameter_sets"))


@add(203, sql=WITH + """, x AS (SELECT *, n % 5 = 0 AS s, n % 5 = 4 AS e FROM (SELECT *, (seq + 36) % 65536 AS n FROM packets) t), i AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER w AS unit, (seq - lag(seq) OVER w + 65536) % 65536 AS step FROM x WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
u AS (SELECT stream_id, unit, count(*) AS fragments, CAST(sum(size) AS BIGINT) AS bytes, bool_or(e) AND bool_and(s OR step = 1) AS complete FROM i WHERE unit > 0 GROUP BY stream_id, unit)
SELECT stream_id, CAST(unit AS BIGINT) AS unit, fragments, bytes, complete FROM u""")
def fragment_reassembly(spark, sf_dir):
    """Fragmented units: a start fragment opens one, which is complete if every further fragment
    follows without a gap and one ends it."""
    n = F.pmod(F.col("seq") + 36, F.lit(65536))
    rows = packets(spark, sf_dir).withColumn("s", n % 5 == 0).withColumn("e", n % 5 == 4)
    rows = rows.withColumn("unit", F.sum(F.col("s").cast("int")).over(gops.arrival())).withColumn("step", F.pmod(F.col("seq") - F.lag("seq").over(gops.arrival()), F.lit(65536)))
    units = rows.filter("unit > 0").groupBy("stream_id", "unit")
    return units.agg(F.count(F.lit(1)).alias("fragments"), F.sum("size").alias("bytes"), (F.bool_or("e") & F.bool_and(F.col("s") | (F.col("step") == 1))).alias("complete"))


# Static payload types and their clock rates; codecs and their clock rates.
CLOCK_BY_TYPE = {0: 8000, 3: 8000, 4: 8000, 5: 8000, 6: 8000, 7: 8000, 8: 8000, 9: 8000, 10: 44100, 11: 44100, 12: 8000, 13: 8000, 14: 90000}
CLOCK_BY_CODEC = {"H264": 90000, "HEVC": 90000, "AV1": 90000, "AAC": 48000, "OPUS": 48000, "G711": 8000, "L16": 44100}
_CASE = "CASE pt " + " ".join(f"WHEN {k} THEN {v}" for k, v in CLOCK_BY_TYPE.items()) + " ELSE 0 END"


@add(42, 43, 49, sql=f"WITH t AS (SELECT event_id, CAST(event_id % 20 AS INTEGER) AS pt, event_type FROM events) SELECT event_id, {_CASE} AS clock, CASE event_type WHEN 'view' THEN 90000 WHEN 'click' THEN 90000 WHEN 'purchase' THEN 48000 WHEN 'signup' THEN 8000 ELSE 90000 END AS codec_clock FROM t")
def clock_rates(spark, sf_dir):
    types = F.create_map(*[F.lit(x) for kv in CLOCK_BY_TYPE.items() for x in kv])
    codecs = F.create_map(*[F.lit(x) for kv in CLOCK_BY_CODEC.items() for x in kv])
    name = F.when(F.col("event_type") == "view", " h264").when(F.col("event_type") == "click", "HEVC").when(F.col("event_type") == "purchase", "Opus ").when(F.col("event_type") == "signup", "g711").otherwise("?")
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.coalesce(F.try_element_at(types, (F.col("event_id") % 20).cast("int")), F.lit(0)).alias("clock"), F.coalesce(F.try_element_at(codecs, F.upper(F.trim(name))), F.lit(90000)).alias("codec_clock"))


@add(46, 47, sql="SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'H264' ELSE 'H265' END AS codec, CAST(90000 AS INTEGER) AS clock, CAST(96 + p_partkey % 8 AS INTEGER) AS payload_type, CAST(p_size AS VARCHAR) AS profile FROM part")
def session_descriptions(spark, sf_dir):
    """Codec, clock and parameters from session descriptions, here one for each part."""
    pt = F.lit(96) + F.col("p_partkey") % 8
    name = F.when(F.col("p_partkey") % 2 == 0, "H264").otherwise("H265")
    sdp = F.concat(F.lit("v=0\r\ns="), "p_name", F.lit("\r\nm=video 5004 RTP/AVP "), pt, F.lit("\r\na=rtpmap:"), pt, F.lit(" "), name, F.lit("/90000\r\na=fmtp:"), pt, F.lit(" packetization-mode=1; profile="), F.col("p_size"), F.lit("\r\n"))
    rows = table(spark, sf_dir, "part").withColumn("sdp", sdp)
    fmtp = F.str_to_map(F.regexp_replace(F.regexp_extract("sdp", r"a=fmtp:\d+ ([^\r\n]*)", 1), r";\s*", ";"), F.lit(";"), F.lit("="))
    return rows.select("p_partkey", F.regexp_extract("sdp", r"a=rtpmap:\d+ ([^/]+)/", 1).alias("codec"), F.regexp_extract("sdp", r"a=rtpmap:\d+ [^/]+/(\d+)", 1).cast("int").alias("clock"), F.regexp_extract("sdp", r"m=video \d+ \S+ (\d+)", 1).cast("int").alias("payload_type"), F.try_element_at(fmtp, F.lit("profile")).alias("profile"))


@add(70, 248, sql=WITH + """, c AS (SELECT stream_id, arrival_idx, substr(sha256('sps' || CAST(arrival_idx // 100 AS VARCHAR) || 'pps' || CAST(arrival_idx // 150 AS VARCHAR)), 1, 16) AS config FROM packets),
n AS (SELECT *, CASE WHEN config IS DISTINCT FROM lag(config) OVER (PARTITION BY stream_id ORDER BY arrival_idx) THEN 1 ELSE 0 END AS new FROM c), s AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS session FROM n)
SELECT stream_id, CAST(session AS BIGINT) AS session, config, count(*) AS frames FROM s GROUP BY stream_id, session, config""")
def encoder_sessions(spark, sf_dir):
    """A new session wherever the hash of the parameter sets changes."""
    config = F.substring(F.sha2(F.concat(F.lit("sps"), F.expr("arrival_idx div 100"), F.lit("pps"), F.expr("arrival_idx div 150")), 256), 1, 16)
    rows = packets(spark, sf_dir).withColumn("config", config).withColumn("new", (~F.col("config").eqNullSafe(F.lag("config").over(gops.arrival()))).cast("int"))
    return rows.withColumn("session", F.sum("new").over(gops.arrival())).groupBy("stream_id", "session", "config").agg(F.count(F.lit(1)).alias("frames"))


@add(61, 57, sql="""WITH r AS (SELECT event_id, (event_id % 600 + 1) * 16 AS w, (event_id % 400 + 1) * 8 AS h FROM events) SELECT event_id, w AS width, h AS height, w BETWEEN 64 AND 7680 AND h BETWEEN 64 AND 4320 AND w >= 0.25 * h AND w <= 4.0 * h AND w % 8 = 0 AND h % 8 = 0 AS plausible FROM r""")
def resolutions(spark, sf_dir):
    """Width and height from the macroblock counts of a parameter set, and whether they are plausible."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (e % 600).alias("mbs"), (e % 400).alias("units")).withColumn("width", (F.col("mbs") + 1) * 16).withColumn("height", (F.col("units") + 1) * 8)
    w, h = F.col("width"), F.col("height")
    fits = w.between(64, 7680) & h.between(64, 4320) & (w >= 0.25 * h) & (w <= 4.0 * h) & (w % 8 == 0) & (h % 8 == 0)
    return rows.select("event_id", "width", "height", fits.alias("plausible"))


@add(99, 101, 151, sql="""WITH pps AS (SELECT s_suppkey AS pps_id, s_nationkey + 5 AS sps_id FROM supplier), sps AS (SELECT n_nationkey AS sps_id FROM nation)
SELECT pps_id, pps.sps_id, sps.sps_id IS NOT NULL AS known, coalesce(sps.sps_id, (SELECT min(sps_id) FROM sps)) AS used_sps FROM pps LEFT JOIN sps ON pps.sps_id = sps.sps_id""")
def parameter_references(spark, sf_dir):
    """Picture sets whose sequence set is known, else the lowest one as a fallback."""
    pps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pps_id"), (F.col("s_nationkey") + 5).alias("sps_id"))
    sps = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sps_id"), F.lit(True).alias("known"))
    lowest = sps.agg(F.min("sps_id").alias("lowest"))
    rows = pps.join(sps, "sps_id", "left").crossJoin(F.broadcast(lowest))  # one row
    return rows.select("pps_id", "sps_id", F.coalesce("known", F.lit(False)).alias("known"), F.when(F.col("known"), F.col("sps_id")).otherwise(F.col("lowest")).alias("used_sps"))


@add(109, 182, 250, sql="""WITH v AS (SELECT o_custkey AS stream_id, o_orderkey AS nr, o_orderstatus AS config, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)
SELECT stream_id, version, config, version = max(version) OVER (PARTITION BY stream_id) AS is_current FROM v""")
def parameter_versions(spark, sf_dir):
    """An append-only history of versions; going back means reading an older one."""
    by = Window.partitionBy("stream_id").orderBy("at", "nr")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("nr"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("config"))
    rows = rows.withColumn("version", F.row_number().over(by).cast("long"))
    return rows.select("stream_id", "version", "config", (F.col("version") == F.max("version").over(Window.partitionBy("stream_id"))).alias("is_current"))
