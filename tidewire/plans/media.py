"""Queries over packet headers, codecs, checksums, parameter sets and further admission rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import wire
from tidewire.operators import avsync, folds, gops, sequences
from tidewire.sources.projections import audio, packets, table

from .base import WITH, Catalogue
from .quality import _D

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add(72, 73, 75, sql=WITH + """, h AS (SELECT stream_id, arrival_idx, CASE WHEN event_id % 19 = 0 THEN 1 ELSE 2 END AS version, (event_id % 2) = 1 AS marker, CAST(90 + event_id % 38 AS BIGINT) AS payload_type, CAST(seq AS BIGINT) AS seq, rtp_ts, stream_id + 1000 AS ssrc FROM packets)
SELECT stream_id, arrival_idx, CAST(version AS BIGINT) AS version, marker, payload_type, seq, rtp_ts, ssrc, CASE WHEN version <> 2 THEN 'version' WHEN payload_type < 96 OR payload_type > 127 THEN 'payload type' END AS error FROM h""")
def rtp_headers(spark, sf_dir):
    """Headers of twelve bytes, read back and checked: the row stays, with its error beside it."""
    e = F.col("event_id")
    first = F.when(e % 19 == 0, 0x40).otherwise(0x80)
    data = F.unhex(F.concat(wire.hexed(first, 2), wire.hexed((e % 2) * 128 + 90 + e % 38, 2), wire.hexed(F.col("seq"), 4), wire.hexed(F.col("rtp_ts"), 8), wire.hexed(F.col("stream_id") + 1000, 8)))
    rows = packets(spark, sf_dir).withColumn("data", data)
    b = [wire.byte(F.col("data"), i) for i in range(12)]

    def number(at: int, n: int):
        out = b[at]
        for i in range(1, n):
            out = out * 256 + b[at + i]
        return out

    rows = rows.select("stream_id", "arrival_idx", F.shiftright(b[0], 6).cast("long").alias("version"), (b[1] >= 128).alias("marker"), b[1].bitwiseAND(127).alias("payload_type"), number(2, 2).alias("seq"), number(4, 4).alias("rtp_ts"), number(8, 4).alias("ssrc"))
    return rows.withColumn("error", F.when(F.col("version") != 2, "version").when(~F.col("payload_type").between(96, 127), "payload type"))


@add(68, 69, sql=WITH + "SELECT stream_id, arrival_idx, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || event_type), 1, 8) AS BIGINT) AS md5_sum FROM packets")
def checksums(spark, sf_dir):
    """The first four bytes of the MD5 as a number; the CRC-32 of a payload in chunks is that of the whole."""
    rows = packets(spark, sf_dir)
    md5 = F.conv(F.substring(F.md5(F.concat(F.col("event_id").cast("string"), "event_type")), 1, 8), 16, 10).cast("long")
    chunks = F.array(F.col("event_id").cast("string"), F.col("event_type"))
    same = F.crc32(F.array_join(chunks, "").cast("binary")) == F.crc32(F.concat(F.col("event_id").cast("string"), "event_type").cast("binary"))
    return rows.filter(same).select("stream_id", "arrival_idx", md5.alias("md5_sum"))


@add(44, 45, 48, 67, sql="""WITH b AS (SELECT event_id, event_id % 256 AS b0, event_type FROM events)
SELECT event_id, b0 & 127 AS cleaned, CASE WHEN (b0 >> 1) & 63 >= 32 AND (b0 >> 1) & 63 <= 40 THEN 'HEVC' WHEN b0 & 31 BETWEEN 1 AND 28 THEN 'H264' ELSE 'unknown' END AS by_payload, CASE event_type WHEN 'view' THEN 'H264' WHEN 'click' THEN 'AV1' ELSE 'unknown' END AS by_metadata FROM b""")
def codec_detection(spark, sf_dir):
    b0 = F.col("event_id") % 256
    hevc = F.shiftright(b0, 1).bitwiseAND(63)
    kind = F.col("event_type")
    meta = F.when(kind == "view", F.create_map(F.lit("codec"), F.lit("h264"))).when(kind == "click", F.create_map(F.lit("v_codec"), F.lit("av1"))).otherwise(F.create_map(F.lit("title"), F.lit("x")))
    named = F.coalesce(*[F.try_element_at(meta, F.lit(k)) for k in ("codec", "video_codec", "v_codec")])
    return table(spark, sf_dir, "events").select(
        "event_id", b0.bitwiseAND(127).alias("cleaned"), F.when(hevc.between(32, 40), "HEVC").when(b0.bitwiseAND(31).between(1, 28), "H264").otherwise("unknown").alias("by_payload"), F.coalesce(F.upper(named), F.lit("unknown")).alias("by_metadata"))


@add(52, 54, sql="""WITH t AS (SELECT event_id, event_id % 40 AS n, event_id % 4 AS a FROM events)
SELECT event_id, CASE WHEN n BETWEEN 16 AND 18 THEN 'BLA' WHEN n IN (19, 20) THEN 'IDR' WHEN n = 21 THEN 'CRA' WHEN n = 32 THEN 'VPS' WHEN n = 33 THEN 'SPS' WHEN n = 34 THEN 'PPS' WHEN n < 16 AND n % 2 = 1 THEN 'P' ELSE 'B' END AS hevc, CASE a WHEN 0 THEN 'IDR' WHEN 2 THEN 'I' ELSE 'P' END AS av1, 'I' AS jpeg_xs FROM t""")
def frame_types(spark, sf_dir):
    n, a = F.col("event_id") % 40, F.col("event_id") % 4
    hevc = F.when(n.between(16, 18), "BLA").when(n.isin(19, 20), "IDR").when(n == 21, "CRA").when(n == 32, "VPS").when(n == 33, "SPS").when(n == 34, "PPS").when((n < 16) & (n % 2 == 1), "P").otherwise("B")
    return table(spark, sf_dir, "events").select("event_id", hevc.alias("hevc"), F.when(a == 0, "IDR").when(a == 2, "I").otherwise("P").alias("av1"), F.lit("I").alias("jpeg_xs"))


@add(78, sql=WITH + ", l AS (SELECT * FROM (VALUES ('IDR', 8000), ('P', 5000), ('B', 3000)) t(kind, most)) SELECT stream_id, arrival_idx, frame_type, size <= most AS fits FROM packets JOIN l ON frame_type = kind")
def size_limits(spark, sf_dir):
    limits = spark.sql("SELECT * FROM VALUES ('IDR', 8000), ('P', 5000), ('B', 3000) AS t(frame_type, most)")
    return packets(spark, sf_dir).join(F.broadcast(limits), "frame_type").select("stream_id", "arrival_idx", "frame_type", (F.col("size") <= F.col("most")).alias("fits"))  # three rows


@add(94, sql=WITH + ", r AS (SELECT stream_id, arrival_idx, row_number() OVER (PARTITION BY stream_id, event_type, capture_us // 60000000 ORDER BY arrival_idx) AS n FROM packets) SELECT stream_id, arrival_idx FROM r WHERE n <= 5 OR (n - 5) % 10 = 0")
def sampled_log(spark, sf_dir):
    """The first five of each kind and minute, then every tenth."""
    by = Window.partitionBy("stream_id", "event_type", F.expr("capture_us div 60000000")).orderBy("arrival_idx")
    return packets(spark, sf_dir).withColumn("n", F.row_number().over(by)).filter("n <= 5 or (n - 5) % 10 = 0").select("stream_id", "arrival_idx")


@add(183, 186, sql="""WITH s AS (SELECT o_custkey AS stream_id, o_orderkey % 32 AS set_id, max(o_orderdate) AS parsed_at FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY parsed_at, set_id) AS n FROM s),
k AS (SELECT stream_id, set_id, 'own' AS origin FROM r WHERE n > 2) SELECT * FROM k UNION ALL SELECT c.stream_id + 1, c.set_id, 'copied' FROM k c WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.stream_id = c.stream_id + 1 AND o.set_id = c.set_id)""")
def parameter_sets(spark, sf_dir):
    """The two oldest sets of each stream purged, then sets copied to the next stream where it has none of that number."""
    sets = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("stream_id"), (F.col("o_orderkey") % 32).alias("set_id")).agg(F.max("o_orderdate").alias("parsed_at"))
    kept = sets.withColumn("n", F.row_number().over(Window.partitionBy("stream_id").orderBy("parsed_at", "set_id"))).filter("n > 2").select("stream_id", "set_id")
    copies = kept.withColumn("stream_id", F.col("stream_id") + 1).join(kept, ["stream_id", "set_id"], "left_anti")
    return kept.withColumn("origin", F.lit("own")).unionByName(copies.withColumn("origin", F.lit("copied")))


@add(93, sql=WITH + """, s AS (SELECT stream_id, arrival_idx, CASE frame_type WHEN 'IDR' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS needs, last_value(CASE WHEN frame_type = 'IDR' THEN event_id END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS set_event FROM packets)
SELECT stream_id, arrival_idx, needs, set_event, set_event IS NOT NULL AS decodable FROM s""")
def decodable_frames(spark, sf_dir):
    """The newest parameter sets before each frame; without any it cannot be decoded."""
    newest = F.last(F.when(F.col("frame_type") == "IDR", F.col("event_id")), ignorenulls=True).over(gops.arrival())
    needs = F.when(F.col("frame_type") == "IDR", 1).when(F.col("frame_type") == "P", 2).otherwise(3)
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", needs.alias("needs"), newest.alias("set_event")).withColumn("decodable", F.col("set_event").isNotNull())


@add(199, 200, sql=WITH + """, s AS (SELECT *, sum(CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS pes FROM packets), u AS (SELECT stream_id, pes, min(CASE WHEN event_id % 6 = 0 THEN size * 4 END) AS expected, sum(size) AS got, max(capture_us) - min(capture_us) AS span FROM s WHERE pes > 0 GROUP BY stream_id, pes)
SELECT stream_id, CAST(pes AS BIGINT) AS pes, expected, CAST(got AS BIGINT) AS got, CASE WHEN got > 196608 THEN 'too large' WHEN span > 5000000 THEN 'timeout' WHEN got > expected THEN 'overrun' WHEN got = expected THEN 'complete' ELSE 'open' END AS state FROM u""")
def pes_assembly(spark, sf_dir):
    """Elementary packets: a unit start announces a length, what follows is summed against it."""
    starts = F.col("event_id") % 6 == 0
    rows = packets(spark, sf_dir).withColumn("pes", F.sum(starts.cast("int")).over(gops.arrival())).filter("pes > 0")
    units = rows.groupBy("stream_id", "pes").agg(F.min(F.when(starts, F.col("size") * 4)).alias("expected"), F.sum("size").alias("got"), (F.max("capture_us") - F.min("capture_us")).alias("span"))
    state = F.when(F.col("got") > 192 << 10, "too large").when(F.col("span") > 5_000_000, "timeout").when(F.col("got") > F.col("expected"), "overrun").when(F.col("got") == F.col("expected"), "complete").otherwise("open")
    return units.select("stream_id", "pes", "expected", "got", state.alias("state"))


@add(154, sql=WITH + """, l AS (SELECT stream_id, list(CAST(size AS DOUBLE) ORDER BY arrival_idx) AS xs, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS success FROM packets GROUP BY stream_id)
SELECT stream_id, round(list_reduce(xs, lambda a, x: a * 0.9 + x * 0.1), 4) AS mean, CAST(success AS DOUBLE) AS success FROM l""")
def recovery_metrics(spark, sf_dir):
    """Exponentially weighted mean in order of arrival, and the share of successes."""
    rows = packets(spark, sf_dir)
    mean = sequences.smoothed(rows, F.col("size"), 0.9, start=F.get("xs", F.lit(0))["x"])
    success = rows.groupBy("stream_id").agg(F.round(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)), 6).alias("success"))
    return mean.join(success, "stream_id").select("stream_id", F.round("last", 4).alias("mean"), "success")


@add(14, sql=WITH + "SELECT stream_id, event_id AS id, pts, dts, frame_type AS kind, CAST(size AS BIGINT) AS size FROM packets")
def serialized_frames(spark, sf_dir):
    """Frames written as fixed binary records and read back."""
    kinds = F.create_map(*[F.lit(x) for kv in (("IDR", 1), ("P", 2), ("B", 3)) for x in kv])
    code = F.element_at(kinds, F.col("frame_type"))
    record = F.unhex(F.concat(wire.hexed(F.col("event_id"), 16), wire.hexed(F.col("pts"), 16), wire.hexed(F.col("dts"), 16), wire.hexed(code, 2), wire.hexed(F.col("size"), 8)))
    rows = packets(spark, sf_dir).withColumn("r", F.hex(record))

    def part(at: int, n: int):
        return F.conv(F.substring("r", at * 2 + 1, n * 2), 16, 10).cast("long")

    kind = F.when(part(24, 1) == 1, "IDR").when(part(24, 1) == 2, "P").otherwise("B")
    return rows.select("stream_id", part(0, 8).alias("id"), part(8, 8).alias("pts"), part(16, 8).alias("dts"), kind.alias("kind"), part(25, 4).alias("size"))


@add(194, sql=(WITH + """, t AS (SELECT stream_id, arrival_idx, CASE WHEN event_id % 41 = 0 THEN (seq + 500) % 65536 ELSE seq END AS seq, CASE WHEN event_id % 43 = 0 THEN (rtp_ts + 9000000) % 4294967296 ELSE rtp_ts END AS ts, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS n FROM packets),
r AS (SELECT stream_id, n, arrival_idx, CAST(NULL AS VARCHAR) AS problem, CAST(seq AS BIGINT) AS ls, CAST(ts AS BIGINT) AS lt FROM t WHERE n = 1 UNION ALL (
 SELECT stream_id, n, arrival_idx, problem, CASE WHEN problem IS NULL THEN seq ELSE ls END, CASE WHEN problem IS NULL THEN ts ELSE lt END FROM (
  SELECT t.*, r.ls, r.lt, CASE WHEN abs((t.seq - r.ls + 98304) % 65536 - 32768) > 100 THEN 'gap' WHEN abs((t.ts - r.lt + 6442450944) % 4294967296 - 2147483648) > 5400000 THEN 'jump' END AS problem FROM r JOIN t ON t.stream_id = r.stream_id AND t.n = r.n + 1) x))
SELECT stream_id, arrival_idx, problem FROM r""").replace("WITH packets", "WITH RECURSIVE packets", 1))
def rtp_timestamp_validation(spark, sf_dir):
    """Packets, some of them far off in number or time."""
    e = F.col("event_id")
    seq = F.when(e % 41 == 0, F.pmod(F.col("seq") + 500, F.lit(65536))).otherwise(F.col("seq"))
    ts = F.when(e % 43 == 0, F.pmod(F.col("rtp_ts") + 9000000, F.lit(1 << 32))).otherwise(F.col("rtp_ts"))
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", seq.alias("seq"), ts.alias("rtp_ts"))
    return folds.checked_packets(rows).select("stream_id", "arrival_idx", "problem")


def _released(k: int, due: str) -> str:
    """One release of the least frame held, if it is due and fits, over the states of the level before."""
    p = k - 1
    fits = f"(lpts{p} IS NULL OR CASE WHEN h{k}.d < ldts{p} THEN ldts{p} - h{k}.d WHEN h{k}.k <> 'B' THEN lpts{p} - h{k}.p ELSE 0 END NOT BETWEEN 1 AND 900000)"
    return f"""SELECT *, CASE WHEN due{k} THEN held{p}[2:] ELSE held{p} END AS held{k}, CASE WHEN due{k} AND fits{k} THEN h{k}.d ELSE ldts{p} END AS ldts{k}, CASE WHEN due{k} AND fits{k} AND h{k}.k <> 'B' THEN h{k}.p ELSE lpts{p} END AS lpts{k},
 CASE WHEN due{k} AND fits{k} THEN o{p} || [{{'e': h{k}.e, 'd': h{k}.d}}] ELSE o{p} END AS o{k} FROM (SELECT *, {fits} AS fits{k}, {due.format(n=f"len(held{p})", h=f"h{k}")} AS due{k} FROM (SELECT *, held{p}[1] AS h{k} FROM (@) l{k}a) l{k}b) l{k}c"""


def _levels(first: str, n: int, due: str) -> str:
    for k in range(1, n + 1):
        first = _released(k, due).replace("@", first)
    return first


_HELD, _OUT = "STRUCT(d BIGINT, c BIGINT, p BIGINT, k VARCHAR, s BIGINT, e BIGINT)[]", "STRUCT(e BIGINT, d BIGINT)[]"
# a buffer of three holds three at most, so three releases follow a frame at most, and two are left at the end
_DUE = "coalesce({n} >= 3 OR {n} > 0 AND ({h}.k = 'IDR' OR t - {h}.s > 200000 OR {h}.k IN ('I', 'P') AND {n} > 1), false)"
_REORDER = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", f AS (SELECT stream_id, arrival_idx AS n, event_id AS e, pts + CASE WHEN event_id % 211 = 0 THEN 2000000 ELSE 0 END AS p, dts + CASE WHEN event_id % 211 = 0 THEN 2000000 ELSE 0 END AS d, frame_type AS k, capture_us AS t FROM packets),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS n, CAST([] AS {_HELD}) AS held, CAST(NULL AS BIGINT) AS ldts, CAST(NULL AS BIGINT) AS lpts, CAST([] AS {_OUT}) AS found FROM f WHERE n = 1
 UNION ALL SELECT stream_id, n, CAST(held3 AS {_HELD}), ldts3, lpts3, CAST(o3 AS {_OUT}) FROM ({_levels(f"SELECT f.*, list_sort(r.held || [{{'d': CASE WHEN f.d = 0 THEN f.p ELSE f.d END, 'c': f.n, 'p': f.p, 'k': f.k, 's': f.t, 'e': f.e}}]) AS held0, r.ldts AS ldts0, r.lpts AS lpts0, CAST([] AS {_OUT}) AS o0 FROM r JOIN f ON f.stream_id = r.stream_id AND f.n = r.n + 1", 3, _DUE)}) x),
z AS (SELECT stream_id, n, found FROM r UNION ALL SELECT stream_id, n + 1, o2 FROM ({_levels(f"SELECT r.stream_id, r.n, r.held AS held0, r.ldts AS ldts0, r.lpts AS lpts0, CAST([] AS {_OUT}) AS o0 FROM r JOIN (SELECT stream_id AS s, max(n) AS m FROM r GROUP BY ALL) ON s = r.stream_id AND m = r.n", 2, "({n} > 0)")}) y),
u AS (SELECT stream_id, n, i, found[i] AS x FROM z, unnest(range(1, len(found) + 1)) AS q(i))
SELECT stream_id, x.e AS event_id, x.d AS dts, row_number() OVER (PARTITION BY stream_id ORDER BY n, i) - 1 AS out FROM u"""


@add(212, 213, 214, 215, sql=_REORDER)
def reordered_frames(spark, sf_dir):
    """Frames as they arrive, some with gaps, some with a new time base, in decode order."""
    later = F.when(F.col("event_id") % 211 == 0, 2_000_000).otherwise(0)
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", "event_id", F.col("pts") + later, F.col("dts") + later, "frame_type", "capture_us")
    return folds.reordered(rows.toDF("stream_id", "arrival_idx", "event_id", "pts", "dts", "frame_type", "capture_us"))


@add()
def memory_admission(spark, sf_dir):
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", F.when(F.col("event_type") == "error", -F.col("size")).otherwise(F.col("size")).alias("change"))
    return folds.memory_limit(rows, 4_000_000).select("stream_id", "arrival_idx", "granted", "used")


@add(249)
def parameter_cache(spark, sf_dir):
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", "capture_us", (F.col("event_id") % 40).alias("entry"))
    return folds.cached(rows, most=16, ttl_us=5_000_000).groupBy("stream_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@add(226, sql=(_D + """, o AS (SELECT stream_id, event_id, capture_us, drift_us, row_number() OVER (PARTITION BY stream_id ORDER BY capture_us, event_id) AS n FROM d),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS off, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS moved, CAST(0 AS BIGINT) AS cnt FROM o GROUP BY stream_id UNION ALL (
 SELECT stream_id, n, event_id, CASE WHEN moves THEN off - step ELSE off END, seen, CASE WHEN moves THEN t ELSE moved END, cnt + CASE WHEN moves THEN 1 ELSE 0 END FROM (
  SELECT *, far AND abs(mean) >= 20000 AS moves, CAST(greatest(-5000, least(5000, trunc(mean * 0.1))) AS BIGINT) AS step FROM (
   SELECT *, CAST(trunc(list_sum(seen) / CAST(len(seen) AS DOUBLE)) AS BIGINT) AS mean, abs(dr) > 40000 AND len(seen) >= 10 AND (moved IS NULL OR t - moved > 100000) AS far FROM (
    SELECT o.stream_id, o.n, o.event_id, o.capture_us AS t, r.off, o.drift_us - r.off AS dr, list_append(CASE WHEN len(r.seen) >= 100 THEN r.seen[2:] ELSE r.seen END, o.drift_us - r.off) AS seen, r.moved, r.cnt FROM r JOIN o ON o.stream_id = r.stream_id AND o.n = r.n + 1) x) y) z))
SELECT stream_id, event_id, off AS offset_us, cnt AS corrections FROM r WHERE n > 0""").replace("WITH packets", "WITH RECURSIVE packets", 1))
def drift_correction(spark, sf_dir):
    return folds.drift_corrected(avsync.drift(packets(spark, sf_dir), audio(spark, sf_dir))).select("stream_id", "event_id", "offset_us", "corrections")
