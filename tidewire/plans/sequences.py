"""Queries over sequence numbers, timestamps and arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import sequences as op
from tidewire.sources.projections import packets, table

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add

_EXT = WITH + """,
d AS (SELECT *, ((CAST(seq AS BIGINT) - lag(seq) OVER w + 98304) % 65536) - 32768 AS delta FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
x AS (SELECT *, CAST(first_value(seq) OVER w + sum(coalesce(delta, 0)) OVER w AS BIGINT) AS ext FROM d WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
h AS (SELECT *, max(ext) OVER (PARTITION BY stream_id ORDER BY arrival_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM x)
"""
_TS = WITH + """,
t AS (SELECT *, CASE WHEN lag(rtp_ts) OVER w - rtp_ts > 2147483648 THEN 1 WHEN lag(rtp_ts) OVER w - rtp_ts < -2147483648 THEN -1 ELSE 0 END AS turn FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
u AS (SELECT *, CAST(rtp_ts + sum(turn) OVER (PARTITION BY stream_id ORDER BY arrival_idx) * 4294967296 AS BIGINT) AS ts FROM t)
"""


@add(191, 227, sql=_EXT + "SELECT stream_id, arrival_idx, seq, CAST(delta AS BIGINT) AS delta, CASE WHEN delta IS NULL THEN 'first' WHEN delta = 0 THEN 'duplicate' WHEN delta = 1 THEN 'next' WHEN delta > 1 AND delta < 100 THEN 'loss' WHEN delta < 0 AND delta > -100 THEN 'reordered' ELSE 'reset' END AS step FROM d")
def sequence_steps(spark, sf_dir):
    return op.sequence_steps(packets(spark, sf_dir)).select("stream_id", "arrival_idx", "seq", "delta", "step")


@add(112, 191, sql=_EXT + "SELECT stream_id, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN delta > 1 AND delta < 100 THEN delta - 1 END), 0) AS BIGINT) AS lost, count(*) FILTER (WHERE delta > 1 AND delta < 100) AS gaps, CAST(max(CASE WHEN delta > 1 AND delta < 100 THEN delta END) AS BIGINT) AS max_gap, count(*) FILTER (WHERE delta < 0 AND delta > -100) AS reordered, CAST(arg_max(seq, arrival_idx) AS INTEGER) AS last_seq FROM d GROUP BY stream_id")
def session_counters(spark, sf_dir):
    rows = op.sequence_steps(packets(spark, sf_dir))
    loss = F.col("step") == "loss"
    return rows.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(loss, F.col("delta") - 1)), F.lit(0).cast("long")).alias("lost"),
        F.count_if(loss).alias("gaps"), F.max(F.when(loss, F.col("delta"))).alias("max_gap"), F.count_if(F.col("step") == "reordered").alias("reordered"), F.max_by("seq", "arrival_idx").alias("last_seq"))


@add(121, 192, sql=_EXT + """, s AS (SELECT stream_id, count(*) FILTER (WHERE high IS NULL OR ext - high > 0 OR (ext - high < 0 AND ext - high > -100)) AS received,
 CAST(sum(CASE WHEN ext - high > 0 THEN ext - high ELSE 0 END) + 1 AS BIGINT) AS expected, CAST(sum(CASE WHEN ext - high > 1 THEN ext - high - 1 ELSE 0 END) AS BIGINT) AS lost,
 count(*) FILTER (WHERE ext - high > 1) AS loss_events, CAST(max(CASE WHEN ext - high > 1 THEN ext - high - 1 ELSE 0 END) AS BIGINT) AS max_consecutive,
 count(*) FILTER (WHERE ext - high < 0 AND ext - high > -100) AS recovered, CAST(max(ext) // 65536 - min(ext) // 65536 AS BIGINT) AS cycles FROM h GROUP BY stream_id)
SELECT *, CAST(lost - recovered AS BIGINT) AS unrecoverable, round(lost / CAST(expected AS DOUBLE), 6) AS loss_rate FROM s""")
def loss_statistics(spark, sf_dir):
    return op.loss_statistics(packets(spark, sf_dir))


@add(193, 184, sql=_EXT + ", l AS (SELECT stream_id, unnest(range(high + 1, ext)) AS lost_ext FROM h WHERE ext - high > 1) SELECT stream_id, lost_ext, lost_ext % 65536 AS lost_seq FROM l")
def lost_sequences(spark, sf_dir):
    return op.lost_sequences(packets(spark, sf_dir))


@add(34, 35, sql=_TS + "SELECT stream_id, arrival_idx, ts - first_value(ts) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS pts, ts - first_value(ts) OVER (PARTITION BY stream_id ORDER BY arrival_idx) - CASE WHEN frame_type = 'B' THEN 6000 ELSE 0 END AS dts FROM u")
def rtp_timestamps(spark, sf_dir):
    rows = op.unwrapped(packets(spark, sf_dir), "rtp_ts", 32, "ts").withColumn("pts", F.col("ts") - F.first("ts").over(op.arrival()))
    return rows.select("stream_id", "arrival_idx", "pts", (F.col("pts") - F.when(F.col("frame_type") == "B", 6000).otherwise(0)).alias("dts"))


_PTS = WITH + ", p AS (SELECT stream_id, arrival_idx, (pts + 8589900000) % 8589934592 AS wire FROM packets), q AS (SELECT *, lag(wire) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS before FROM p)"


@add(41, 195, 196, sql=_PTS + "SELECT stream_id, arrival_idx, wire, CAST(wire + sum(CASE WHEN before - wire > 4294967296 THEN 1 WHEN before - wire < -4294967296 THEN -1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx) * 8589934592 AS BIGINT) AS pts, coalesce(abs(wire - before) > 90000 AND abs(wire - before) < 4294967296, false) AS discontinuity FROM q")
def pts_wraps(spark, sf_dir):
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", F.pmod(F.col("pts") + 8589900000, F.lit(1 << 33)).alias("wire"))
    jump = F.abs(F.col("wire") - F.lag("wire").over(op.arrival()))
    return op.unwrapped(rows, "wire", 33, "pts").withColumn("discontinuity", F.coalesce((jump > 90000) & (jump < 1 << 32), F.lit(False)))


@add(190, sql=_TS + """, r AS (SELECT stream_id, arrival_idx, capture_us * 9 // 100 - ts AS transit FROM u),
v AS (SELECT stream_id, arrival_idx, CAST(abs(transit - lag(transit) OVER (PARTITION BY stream_id ORDER BY arrival_idx)) AS DOUBLE) AS d FROM r),
l AS (SELECT stream_id, list(d ORDER BY arrival_idx) AS ds FROM v WHERE d IS NOT NULL GROUP BY stream_id),
f AS (SELECT stream_id, list_reduce(list_concat([{'j': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'd': 0.0::DOUBLE}], [{'j': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'd': x} for x in ds]),
 lambda a, x: {'j': a.j + (x.d - a.j) / 16.0, 'm': greatest(a.m, a.j + (x.d - a.j) / 16.0), 'd': x.d}) AS r FROM l)
SELECT stream_id, round(r.j, 4) AS jitter, round(r.m, 4) AS max_jitter FROM f""")
def interarrival_jitter(spark, sf_dir):
    return op.jitter(packets(spark, sf_dir))


@add(189, 171, sql=_TS + ", p AS (SELECT *, first_value(capture_us) OVER w + (ts - first_value(ts) OVER w) * 1000000 // 90000 + 50000 AS playout_us FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)) SELECT stream_id, arrival_idx, playout_us, capture_us > playout_us AS late FROM p")
def jitter_buffer_release(spark, sf_dir):
    return op.playout(packets(spark, sf_dir)).select("stream_id", "arrival_idx", "playout_us", "late")


@add(198, 124, sql=WITH + ", c AS (SELECT stream_id, (seq % 16 - lag(seq % 16) OVER (PARTITION BY stream_id ORDER BY arrival_idx) + 16) % 16 AS step FROM packets) SELECT stream_id, count(*) AS packets, count(*) FILTER (WHERE step = 0) AS repeats, count(*) FILTER (WHERE step > 1) AS breaks FROM c GROUP BY stream_id")
def continuity_counters(spark, sf_dir):
    return op.continuity(packets(spark, sf_dir))


@add(158, 159, sql=WITH + """, r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY stream_id ORDER BY capture_us, arrival_idx) AS BIGINT) AS total FROM packets),
f AS (SELECT *, min({'c': capture_us, 'a': arrival_idx, 't': total}) OVER (PARTITION BY stream_id ORDER BY capture_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS s FROM r)
SELECT stream_id, arrival_idx, CASE WHEN capture_us > s.c THEN (total - s.t) * 8000000 // (capture_us - s.c) ELSE 0 END AS bitrate FROM f""")
def sliding_bitrate(spark, sf_dir):
    return op.sliding_bitrate(packets(spark, sf_dir)).select("stream_id", "arrival_idx", "bitrate")


@add(113, 126, 92, sql=WITH + ", s AS (SELECT stream_id, count(*) AS n, sum(size) AS b, min(capture_us) AS f, max(capture_us) AS l, (SELECT max(capture_us) FROM packets) AS now FROM packets GROUP BY stream_id) SELECT stream_id, CAST(b * 8000000 // (l - f) AS BIGINT) AS bitrate, round(least(120.0, n * 1000000.0 / (l - f)), 6) AS frame_rate, now - l < 10000000 AS active FROM s")
def session_rates(spark, sf_dir):
    rows = packets(spark, sf_dir).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("capture_us").alias("f"), F.max("capture_us").alias("l"))
    now = rows.agg(F.max("l").alias("now"))
    return rows.crossJoin(F.broadcast(now)).select("stream_id", F.expr("b * 8000000 div (l - f)").alias("bitrate"), F.round(F.least(F.lit(120.0), F.col("n") * 1000000.0 / (F.col("l") - F.col("f"))), 6).alias("frame_rate"), (F.col("now") - F.col("l") < 10_000_000).alias("active"))


@add(114, sql=WITH + """, r AS (SELECT stream_id, capture_us // 30000000 AS report, CAST(sum(size) AS BIGINT) AS bytes FROM packets GROUP BY stream_id, capture_us // 30000000),
c AS (SELECT stream_id, report, CAST(sum(bytes) OVER (PARTITION BY stream_id ORDER BY report) AS BIGINT) AS total FROM r)
SELECT stream_id, report, total, CAST((total - coalesce(lag(total) OVER (PARTITION BY stream_id ORDER BY report), 0)) * 8 // 30 AS BIGINT) AS bitrate FROM c""")
def report_bitrate(spark, sf_dir):
    by = op.Window.partitionBy("stream_id").orderBy("report")
    rows = packets(spark, sf_dir).groupBy("stream_id", F.expr("capture_us div 30000000").alias("report")).agg(F.sum("size").alias("bytes"))
    rows = rows.withColumn("total", F.sum("bytes").over(by)).withColumn("before", F.coalesce(F.lag("total").over(by), F.lit(0)))
    return rows.select("stream_id", "report", "total", F.expr("case when total < before then 0 else (total - before) * 8 div 30 end").alias("bitrate"))


@add(252, sql="""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t_us FROM events),
n AS (SELECT *, CASE WHEN coalesce(t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) > 28800000000, true) THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS BIGINT) AS session FROM n)
SELECT user_id, session, min(t_us) AS started_us, max(t_us) AS ended_us, count(*) AS n FROM s GROUP BY user_id, session""")
def session_expiry(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return op.sessions(rows, "user_id", "at", 8 * 3600)


@add(162, 150, sql=WITH + """, e AS (SELECT stream_id, frame_type AS kind, capture_us FROM packets WHERE size % 7 = 0),
w AS (SELECT stream_id, kind, (capture_us // 10000000 - k) * 10 AS window_s FROM e, range(6) AS r(k))
SELECT stream_id, kind, window_s, count(*) AS n, count(*) > 60 AS alert FROM w GROUP BY stream_id, kind, window_s""")
def event_rate_windows(spark, sf_dir):
    rows = packets(spark, sf_dir).filter("size % 7 = 0").select("stream_id", F.col("frame_type").alias("kind"), F.timestamp_micros("capture_us").alias("at"))
    out = rows.groupBy("stream_id", "kind", F.window("at", "60 seconds", "10 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("stream_id", "kind", F.unix_seconds("w.start").alias("window_s"), "n", (F.col("n") > 60).alias("alert"))


@add(161, sql=WITH + """, d AS (SELECT stream_id, capture_us // 10000000 AS win, ((CAST(seq AS BIGINT) - lag(seq) OVER (PARTITION BY stream_id ORDER BY arrival_idx) + 98304) % 65536) - 32768 AS delta FROM packets)
SELECT stream_id, win, count(*) AS packets, CAST(coalesce(sum(CASE WHEN delta > 1 AND delta < 100 THEN delta - 1 END), 0) AS BIGINT) AS lost FROM d GROUP BY stream_id, win""")
def loss_windows(spark, sf_dir):
    rows = op.sequence_steps(packets(spark, sf_dir))
    return rows.groupBy("stream_id", F.expr("capture_us div 10000000").alias("win")).agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(F.when(F.col("step") == "loss", F.col("delta") - 1)), F.lit(0).cast("long")).alias("lost"))


@add(228, sql=_TS + ", j AS (SELECT stream_id, arrival_idx, ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS step FROM u) SELECT stream_id, arrival_idx, step, CASE WHEN abs(step) > 90000 THEN 'high' ELSE 'medium' END AS severity FROM j WHERE abs(step) > 9000")
def timestamp_jumps(spark, sf_dir):
    rows = op.unwrapped(packets(spark, sf_dir), "rtp_ts", 32, "ts").withColumn("step", F.col("ts") - F.lag("ts").over(op.arrival()))
    return rows.filter(F.abs("step") > 9000).select("stream_id", "arrival_idx", "step", F.when(F.abs("step") > 90000, "high").otherwise("medium").alias("severity"))
