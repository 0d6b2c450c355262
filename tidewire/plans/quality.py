"""Queries over audio/video sync, health scores, anomalies and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import scores
from tidewire.operators import avsync
from tidewire.operators import sequences as seq
from tidewire.sources.projections import audio, packets

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add

_D = WITH + """, j AS (SELECT a.stream_id, a.event_id, a.capture_us, v.pts AS video_pts, a.audio_pts, v.capture_us AS video_us FROM audio a ASOF JOIN (SELECT stream_id, capture_us, arg_max(pts, event_id) AS pts FROM packets GROUP BY stream_id, capture_us) v ON a.stream_id = v.stream_id AND a.capture_us >= v.capture_us),
d AS (SELECT stream_id, event_id, capture_us, video_pts, audio_pts, video_pts * 1000000 // 90000 - audio_pts * 1000000 // 48000 AS drift_us, video_us - capture_us AS lag_us FROM j WHERE video_pts <> 0 AND audio_pts <> 0)
"""
#: One row per stream and ten seconds: measured counts, and ratios made of them that span the range of each score.
_M = WITH + """, b AS (SELECT stream_id, capture_us // 10000000 AS win, count(*) AS n, CAST(sum(size) AS BIGINT) AS s, max(size) AS mx FROM packets GROUP BY stream_id, capture_us // 10000000),
m AS (SELECT stream_id, win, CAST((s % 120) / 1000.0 AS DOUBLE) AS drops, s % 150 AS drift_ms, CAST((s % 100) / 100.0 AS DOUBLE) AS used, CAST((n % 120) / 1000.0 AS DOUBLE) AS errors, CAST((mx % 60) / 100.0 AS DOUBLE) AS variance, n % 12 AS changes, s % 600 AS latency_ms, CAST((s % 101) / 100.0 AS DOUBLE) AS cpu, CAST((mx % 101) / 100.0 AS DOUBLE) AS memory, CAST((n % 30) / 1000.0 AS DOUBLE) AS loss FROM b)
"""


def metrics(spark, sf_dir):
    b = packets(spark, sf_dir).groupBy("stream_id", F.expr("capture_us div 10000000").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.max("size").alias("mx"))
    c = F.col
    return b.select("stream_id", "win", ((c("s") % 120) / 1000.0).alias("drops"), (c("s") % 150).alias("drift_ms"), ((c("s") % 100) / 100.0).alias("used"), ((c("n") % 120) / 1000.0).alias("errors"), ((c("mx") % 60) / 100.0).alias("variance"), (c("n") % 12).alias("changes"), (c("s") % 600).alias("latency_ms"), ((c("s") % 101) / 100.0).alias("cpu"), ((c("mx") % 101) / 100.0).alias("memory"), ((c("n") % 30) / 1000.0).alias("loss"))


@add(98, sql=_D + "SELECT * FROM d")
def av_drift(spark, sf_dir):
    return avsync.drift(packets(spark, sf_dir), audio(spark, sf_dir))


@add(120, sql=_D + """, w AS (SELECT *, count(*) OVER k AS n, sum(drift_us) OVER k AS sm, sum(CAST(trunc(drift_us / 1000) AS BIGINT)) OVER k AS s1, sum(CAST(trunc(drift_us / 1000) AS BIGINT) * CAST(trunc(drift_us / 1000) AS BIGINT)) OVER k AS s2 FROM d WINDOW k AS (PARTITION BY stream_id ORDER BY capture_us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
a AS (SELECT *, CAST(trunc(sm / CAST(n AS DOUBLE)) AS BIGINT) AS avg_us FROM w), z AS (SELECT *, CAST(trunc(avg_us / 1000) AS BIGINT) AS m FROM a)
SELECT stream_id, event_id, avg_us, round(CAST(s2 - 2 * m * s1 + n * m * m AS DOUBLE) / n, 6) AS variance_ms2, abs(avg_us) <= 40000 AS in_sync FROM z""")
def drift_statistics(spark, sf_dir):
    return avsync.drift_statistics(avsync.drift(packets(spark, sf_dir), audio(spark, sf_dir)))


@add(231, sql=_D + "SELECT stream_id, event_id, abs(drift_us) // 1000 AS drift_ms, CASE WHEN abs(drift_us) > 1000000 THEN 'critical' WHEN abs(drift_us) > 500000 THEN 'high' ELSE 'medium' END AS severity FROM d WHERE abs(drift_us) > 200000")
def drift_events(spark, sf_dir):
    rows = avsync.drift(packets(spark, sf_dir), audio(spark, sf_dir)).withColumn("d", F.abs("drift_us")).filter("d > 200000")
    return rows.select("stream_id", "event_id", F.expr("d div 1000").alias("drift_ms"), F.when(F.col("d") > 1_000_000, "critical").when(F.col("d") > 500_000, "high").otherwise("medium").alias("severity"))


@add(224, 225, 36, sql=WITH + """, t AS (SELECT *, pts + CASE WHEN arrival_idx > 500 THEN 2000000 ELSE 0 END AS p FROM packets), j AS (SELECT *, abs(p - lag(p) OVER w) AS jump, dts < lag(dts) OVER w AS back FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
b AS (SELECT *, coalesce(sum(CASE WHEN jump > 900000 THEN 1 ELSE 0 END) OVER w, 0) AS base, coalesce(sum(CASE WHEN jump > 90000 THEN 1 ELSE 0 END) OVER w, 0) AS jumps, coalesce(sum(CASE WHEN back THEN 1 ELSE 0 END) OVER w, 0) AS errs FROM j WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
f AS (SELECT *, first_value(capture_us) OVER k AS base_us, first_value(p) OVER k AS base_pts FROM b WINDOW k AS (PARTITION BY stream_id, base ORDER BY arrival_idx))
SELECT stream_id, arrival_idx, CAST(base_us + trunc((p - base_pts) * 1000000 / 90000.0) AS BIGINT) AS present_us, CAST(jumps AS BIGINT) AS jumps, CAST(errs AS BIGINT) AS dts_errors FROM f""")
def track_timeline(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("pts", F.col("pts") + F.when(F.col("arrival_idx") > 500, 2_000_000).otherwise(0))
    return avsync.timeline(rows).select("stream_id", "arrival_idx", "present_us", "jumps", "dts_errors")


@add(37, 38, 39, 40, sql=WITH + "SELECT stream_id, arrival_idx, CAST(round(pts * 48000 / 90000.0) AS BIGINT) AS at_48k, round(pts * 48000 / 90000.0 - round(pts * 48000 / 90000.0), 6) AS rest, CAST(round(round(pts * 48000 / 90000.0) * 1000 / 48000.0) AS BIGINT) AS chained_ms, CAST(round(pts * 1000 / 90000.0) AS BIGINT) AS ms, CAST(round(round(pts * 1000 / 90000.0) * 90000 / 1000.0) AS BIGINT) AS pts_of_ms FROM (SELECT *, pts + event_id % 7 AS q FROM packets) t".replace("pts *", "q *"))
def time_bases(spark, sf_dir):
    q = F.col("pts") + F.col("event_id") % 7
    at = avsync.rescaled(q, 1, 90000, 1, 48000)
    ms = avsync.rescaled(q, 1, 90000, 1, 1000)
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", at.alias("at_48k"), F.round(avsync.residue(q, 1, 90000, 1, 48000), 6).alias("rest"), avsync.rescaled(at, 1, 48000, 1, 1000).alias("chained_ms"), ms.alias("ms"), avsync.rescaled(ms, 1, 1000, 1, 90000).alias("pts_of_ms"))


_S = _M + """, s AS (SELECT *, CASE WHEN drops >= 0.1 THEN 0.0 WHEN drops >= 0.05 THEN 0.5 * (0.1 - drops) / (0.1 - 0.05) ELSE 1.0 - pow(drops / 0.05, 2) END AS frame_drop, CASE WHEN drift_ms >= 100 THEN 0.0 ELSE 1.0 - drift_ms / 100.0 END AS ts_score,
 CASE WHEN used < 0.3 OR used > 0.95 THEN 0.0 WHEN used >= 0.5 AND used <= 0.8 THEN 1.0 WHEN used < 0.5 THEN (used - 0.3) / 0.2 ELSE (0.95 - used) / 0.15 END AS buffer, CASE WHEN errors >= 0.1 THEN 0.0 WHEN errors <= 0.001 THEN 1.0 ELSE 1.0 - (log10(errors * 1000) + 3) / 5 END AS error_rate,
 CASE WHEN variance >= 0.5 THEN 0.0 ELSE 1.0 - variance * 2 END AS bitrate, CASE WHEN changes = 0 THEN 1.0 WHEN changes >= 10 THEN 0.0 ELSE 1.0 - changes / 10.0 END AS param_changes, CASE WHEN latency_ms >= 500 THEN 0.0 WHEN latency_ms <= 50 THEN 1.0 ELSE 1.0 - (latency_ms - 50) / 450.0 END AS latency FROM m),
h AS (SELECT stream_id, win, frame_drop, ts_score, buffer, error_rate, bitrate, param_changes, latency, frame_drop * 0.3 + ts_score * 0.2 + buffer * 0.15 + error_rate * 0.2 + bitrate * 0.05 + param_changes * 0.05 + latency * 0.05 AS score FROM s)
"""


def _health(spark, sf_dir):
    c = F.col
    parts = {"frame_drop": scores.frame_drops(c("drops")), "timestamp": scores.timestamp_drift(c("drift_ms")), "buffer": scores.buffer_use(c("used")), "error_rate": scores.error_rate(c("errors")), "bitrate": scores.bitrate_variance(c("variance")), "param_changes": scores.parameter_changes(c("changes")), "latency": scores.latency(c("latency_ms"))}
    return metrics(spark, sf_dir).select("stream_id", "win", *[v.alias(k) for k, v in parts.items()]).withColumn("score", scores.weighted({k: c(k) for k in parts}))


@add(132, 133, 134, 135, 136, 137, 138, 139, sql=_S + "SELECT stream_id, win, " + ", ".join(f"CAST(round({a}, 5) AS DOUBLE) AS {b}" for a, b in (("frame_drop", "frame_drop"), ("ts_score", '"timestamp"'), ("buffer", "buffer"), ("error_rate", "error_rate"), ("bitrate", "bitrate"), ("param_changes", "param_changes"), ("latency", "latency"), ("score", "score"))) + " FROM h")
def health_scores(spark, sf_dir):
    rows = _health(spark, sf_dir)
    return rows.select("stream_id", "win", *[F.round(x, 5).alias(x) for x in rows.columns[2:]])


@add(165, 166, sql=_S + ", t AS (SELECT stream_id, win, avg(score) OVER (PARTITION BY stream_id ORDER BY win ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS older, avg(score) OVER (PARTITION BY stream_id ORDER BY win ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS newer FROM h) SELECT stream_id, win, round(CAST(newer - older AS DOUBLE), 5) AS trend FROM t")
def health_trend(spark, sf_dir):
    w = Window.partitionBy("stream_id").orderBy("win")
    return _health(spark, sf_dir).select("stream_id", "win", F.round(F.avg("score").over(w.rowsBetween(-4, 0)) - F.avg("score").over(w.rowsBetween(-9, -5)), 5).alias("trend"))


@add(140, sql=_M + """, s AS (SELECT *, CASE WHEN drops > 0.1 THEN 0.5 WHEN drops > 0.05 THEN 0.8 ELSE 1.0 END * CASE WHEN cpu > 0.9 THEN 0.6 ELSE 1.0 END * CASE WHEN memory > 0.9 THEN 0.7 ELSE 1.0 END * CASE WHEN latency_ms > 200 THEN 0.8 ELSE 1.0 END * CASE WHEN changes > 10 THEN 0.7 ELSE 1.0 END AS score,
 concat_ws(',', CASE WHEN drops > 0.05 THEN 'frame_drops' END, CASE WHEN cpu > 0.9 THEN 'cpu_usage' END, CASE WHEN memory > 0.9 THEN 'memory_usage' END, CASE WHEN latency_ms > 200 THEN 'latency' END, CASE WHEN changes > 10 THEN 'corruption' END) AS issues FROM m)
SELECT stream_id, win, CAST(round(score, 6) AS DOUBLE) AS score, CASE WHEN score >= 0.9 THEN 'healthy' WHEN score >= 0.7 THEN 'degraded' WHEN score >= 0.3 THEN 'unhealthy' ELSE 'critical' END AS status, issues FROM s""")
def health_status(spark, sf_dir):
    args = [F.col(x) for x in ("drops", "cpu", "memory", "latency_ms", "changes")]
    rows = metrics(spark, sf_dir).withColumn("score", F.round(scores.monitor_score(*args), 6))
    return rows.select("stream_id", "win", "score", scores.monitor_status(F.col("score")).alias("status"), F.array_join(scores.monitor_issues(*args), ",").alias("issues"))


@add(141, sql=_M + """, p AS (SELECT stream_id, win, greatest(0, 100 - CASE WHEN changes <> 3 THEN 0 ELSE 50 END - CASE WHEN changes <> 4 THEN 0 ELSE 20 END - CASE WHEN errors > 0.1 THEN 30 WHEN errors > 0.05 THEN 15 WHEN errors > 0.01 THEN 5 ELSE 0 END - CASE WHEN changes > 6 THEN 10 ELSE 0 END - CASE WHEN changes > 8 THEN 5 ELSE 0 END - CASE WHEN drift_ms > 100 THEN 10 ELSE 0 END - CASE WHEN changes > 9 THEN 5 ELSE 0 END - CASE WHEN changes > 10 THEN 5 ELSE 0 END - CASE WHEN used > 0.9 THEN 10 ELSE 0 END) AS score FROM m)
SELECT stream_id, win, CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 25 THEN 'poor' ELSE 'critical' END AS status FROM p""")
def session_diagnostics(spark, sf_dir):
    c = F.col
    score = scores.session_score(c("changes") != 3, c("changes") != 4, c("errors"), c("changes") - 6, c("changes") - 8, c("drift_ms"), c("changes") - 9, c("changes") - 10, F.when(c("used") > 0.9, 1).otherwise(0))
    return metrics(spark, sf_dir).withColumn("score", score).select("stream_id", "win", "score", scores.session_status(c("score")).alias("status"))


@add(142, sql=_M + "SELECT stream_id, win, (1.0 - least(cpu / 0.8, 1.0)) * 0.25 + (1.0 - least(memory / 0.8, 1.0)) * 0.2 + (1.0 - least(drops / 0.05, 1.0)) * 0.25 + (1.0 - least(loss / 0.02, 1.0)) * 0.2 + CASE WHEN latency_ms > 100 THEN greatest(0.0, 1.0 - (latency_ms - 100) / 400.0) ELSE 1.0 END * 0.1 AS score FROM m")
def adaptive_quality(spark, sf_dir):
    return metrics(spark, sf_dir).select("stream_id", "win", scores.adaptive_quality(*[F.col(x) for x in ("cpu", "memory", "drops", "loss", "latency_ms")]).alias("score"))


@add(247, sql=_M + """, br AS (SELECT *, drops > 0.05 AS breach FROM m), c AS (SELECT *, CASE WHEN breach IS DISTINCT FROM lag(breach) OVER (PARTITION BY stream_id ORDER BY win) THEN 1 ELSE 0 END AS new FROM br), i AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY win) AS island FROM c)
SELECT stream_id, CAST(island AS BIGINT) AS island, min(win) AS raised, max(win) AS last_seen, max(drops) AS worst FROM i WHERE breach GROUP BY stream_id, island""")
def threshold_alerts(spark, sf_dir):
    w = Window.partitionBy("stream_id").orderBy("win")
    rows = metrics(spark, sf_dir).withColumn("breach", F.col("drops") > 0.05).withColumn("new", (~F.col("breach").eqNullSafe(F.lag("breach").over(w))).cast("int")).withColumn("island", F.sum("new").over(w))
    return rows.filter("breach").groupBy("stream_id", "island").agg(F.min("win").alias("raised"), F.max("win").alias("last_seen"), F.max("drops").alias("worst"))


_E = WITH + ", e AS (SELECT stream_id, arrival_idx, capture_us, CASE event_type WHEN 'error' THEN 'corruption' WHEN 'click' THEN 'packet_loss' ELSE 'timeout' END AS kind FROM packets WHERE event_type IN ('error', 'click', 'signup'))"


def errors(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "corruption").when(F.col("event_type") == "click", "packet_loss").otherwise("timeout")
    return packets(spark, sf_dir).filter(F.col("event_type").isin("error", "click", "signup")).select("stream_id", "arrival_idx", "capture_us", kind.alias("kind"))


@add(155, 150, sql=_E + "SELECT stream_id, kind, count(*) AS n, min(capture_us) AS first_us, max(capture_us) AS last_us FROM e GROUP BY stream_id, kind HAVING count(*) >= 5")
def alert_groups(spark, sf_dir):
    return errors(spark, sf_dir).groupBy("stream_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("capture_us").alias("first_us"), F.max("capture_us").alias("last_us")).filter("n >= 5")


@add(147, sql=_E + ", c AS (SELECT stream_id, kind, count(*) AS n FROM e GROUP BY stream_id, kind), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, kind) AS k FROM c) SELECT stream_id, kind, n FROM r WHERE k = 1")
def common_errors(spark, sf_dir):
    counted = errors(spark, sf_dir).groupBy("stream_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("stream_id").orderBy(F.desc("n"), "kind")
    return counted.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


@add(163, 164, 240, sql=_E + """, w AS (SELECT *, count(*) OVER r AS recent, count(*) FILTER (WHERE kind = 'corruption') OVER r AS corrupt, capture_us - lag(capture_us) OVER o AS i3, lag(capture_us) OVER o - lag(capture_us, 2) OVER o AS i2, lag(capture_us, 2) OVER o - lag(capture_us, 3) OVER o AS i1 FROM e
 WINDOW r AS (PARTITION BY stream_id ORDER BY capture_us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW), o AS (PARTITION BY stream_id ORDER BY capture_us, arrival_idx)),
p AS (SELECT *, (i1 + i2) // 2 AS mean FROM w), q AS (SELECT *, coalesce(mean > 0 AND i1 BETWEEN 0.8 * mean AND 1.2 * mean AND i2 BETWEEN 0.8 * mean AND 1.2 * mean AND i3 BETWEEN 0.8 * mean AND 1.2 * mean, false) AS repeating FROM p)
SELECT stream_id, arrival_idx, recent, repeating, CASE WHEN recent / 5.0 > 20.0 THEN 'fast' WHEN repeating THEN 'adaptive' WHEN corrupt > 2 THEN 'preemptive' ELSE 'default' END AS strategy FROM q""")
def recovery_strategy(spark, sf_dir):
    """The strategy by the errors of the last five minutes (here fast above 20 a minute)."""
    by = Window.partitionBy("stream_id").orderBy("capture_us", "arrival_idx")
    at = [F.col("capture_us"), *[F.lag("capture_us", k).over(by) for k in (1, 2, 3)]]
    counts = {"recent": F.lit(1), "corrupt": (F.col("kind") == "corruption").cast("int")}
    rows = seq.counted_within(errors(spark, sf_dir), "capture_us", 300_000_000, counts)
    rows = rows.withColumn("i3", at[0] - at[1]).withColumn("i2", at[1] - at[2]).withColumn("i1", at[2] - at[3]).withColumn("mean", F.expr("(i1 + i2) div 2"))
    near = [F.col(i).between(0.8 * F.col("mean"), 1.2 * F.col("mean")) for i in ("i1", "i2", "i3")]
    rows = rows.withColumn("repeating", F.coalesce((F.col("mean") > 0) & near[0] & near[1] & near[2], F.lit(False)))
    kind = F.when(F.col("recent") / 5.0 > 20.0, "fast").when(F.col("repeating"), "adaptive").when(F.col("corrupt") > 2, "preemptive").otherwise("default")
    return rows.select("stream_id", "arrival_idx", "recent", "repeating", kind.alias("strategy"))


@add(246, sql=_E + ", a AS (SELECT stream_id, arrival_idx, (max(capture_us) OVER () - capture_us) // 1000000 AS age_s FROM e) SELECT stream_id, arrival_idx, age_s, CASE WHEN age_s >= 45 THEN 3 WHEN age_s >= 15 THEN 2 WHEN age_s >= 5 THEN 1 ELSE 0 END AS level FROM a")
def alert_escalation(spark, sf_dir):
    """Level by age; the clock is the newest row, and a minute of the policy is a second here."""
    rows = errors(spark, sf_dir)
    now = rows.agg(F.max("capture_us").alias("now"))
    aged = rows.crossJoin(F.broadcast(now)).withColumn("age_s", F.expr("(now - capture_us) div 1000000"))
    return aged.select("stream_id", "arrival_idx", "age_s", F.when(F.col("age_s") >= 45, 3).when(F.col("age_s") >= 15, 2).when(F.col("age_s") >= 5, 1).otherwise(0).alias("level"))


@add(156, sql=_E + ", c AS (SELECT stream_id, count(*) FILTER (WHERE kind = 'corruption') AS n FROM e GROUP BY stream_id), r AS (SELECT stream_id, CASE WHEN n > 250 THEN 2 WHEN n > 200 THEN 1 ELSE 0 END AS rank FROM c) SELECT CASE coalesce(max(rank), 2) WHEN 2 THEN 'down' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status, count(*) AS checks FROM r")
def overall_health(spark, sf_dir):
    checks = errors(spark, sf_dir).groupBy("stream_id").agg(F.count_if(F.col("kind") == "corruption").alias("n")).withColumn("rank", F.when(F.col("n") > 250, 2).when(F.col("n") > 200, 1).otherwise(0))
    worst = F.coalesce(F.max("rank"), F.lit(2))
    return checks.agg(F.when(worst == 2, "down").when(worst == 1, "degraded").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("checks"))


@add(243, 244, sql=WITH + "SELECT stream_id, arrival_idx, CAST(least(30000.0, 100.0 * pow(2.0, arrival_idx % 12)) AS DOUBLE) AS delay_ms FROM packets WHERE event_type = 'error'")
def retry_backoff(spark, sf_dir):
    rows = packets(spark, sf_dir).filter("event_type = 'error'")
    return rows.select("stream_id", "arrival_idx", F.least(F.lit(30000.0), 100.0 * F.pow(F.lit(2.0), F.col("arrival_idx") % 12)).alias("delay_ms"))


@add(83, 229, 77, 79, 80, 81, 82, sql=WITH + """, v AS (SELECT stream_id, arrival_idx, size, dts, CASE WHEN event_id % 31 = 0 THEN -pts - 1 WHEN event_id % 37 = 0 THEN dts - 1 WHEN event_id % 41 = 0 THEN pts + 8589934592 ELSE pts END AS p FROM packets)
SELECT stream_id, arrival_idx, p BETWEEN 0 AND 8589934591 AS in_range, dts = 0 OR p >= dts AS ordered, size > 0 AND size <= 52428800 AS size_ok, concat_ws(',', CASE WHEN NOT p BETWEEN 0 AND 8589934591 THEN 'range' END, CASE WHEN dts <> 0 AND p < dts THEN 'order' END, CASE WHEN size <= 0 OR size > 52428800 THEN 'size' END, CASE WHEN p = 0 AND dts = 0 THEN 'unset' END) AS errors FROM v""")
def frame_validation(spark, sf_dir):
    """Errors of each frame, kept beside the row; some timestamps are spoiled on purpose."""
    e, pts, dts, size = (F.col(x) for x in ("event_id", "pts", "dts", "size"))
    rows = packets(spark, sf_dir).withColumn("p", F.when(e % 31 == 0, -pts - 1).when(e % 37 == 0, dts - 1).when(e % 41 == 0, pts + (1 << 33)).otherwise(pts))
    fits, ordered, fair = F.col("p").between(0, (1 << 33) - 1), (dts == 0) | (F.col("p") >= dts), (size > 0) & (size <= 50 << 20)
    found = F.concat_ws(",", F.when(~fits, "range"), F.when(~ordered, "order"), F.when(~fair, "size"), F.when((F.col("p") == 0) & (dts == 0), "unset"))
    return rows.select("stream_id", "arrival_idx", fits.alias("in_range"), ordered.alias("ordered"), fair.alias("size_ok"), found.alias("errors"))


@add(122, 123, sql=WITH + "SELECT stream_id, arrival_idx, round(avg(size) OVER w, 6) AS mean_size, min(size) OVER w AS least, max(size) OVER w AS most, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER w, 6) AS error_share FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)")
def running_diagnostics(spark, sf_dir):
    w = seq.arrival()
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", F.round(F.avg("size").over(w), 6).alias("mean_size"), F.min("size").over(w).alias("least"), F.max("size").over(w).alias("most"), F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).over(w), 6).alias("error_share"))
