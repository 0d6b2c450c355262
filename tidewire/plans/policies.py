"""Queries over admission, rate control, recovery state, the registry and eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scores
from tidewire.operators import folds, registry
from tidewire.operators import sequences as seq
from tidewire.sources.projections import packets, table

from .base import WITH, Catalogue
from .quality import metrics

CATALOGUE = Catalogue()
add = CATALOGUE.add



@add(234, sql=WITH + """, o AS (SELECT stream_id, list({'t': capture_us, 's': size} ORDER BY arrival_idx) AS xs FROM packets GROUP BY stream_id),
z AS (SELECT stream_id, list_concat([{'tok': 100000::BIGINT, 'last': xs[1].t, 'ok': 0::BIGINT, 'bytes': 0::BIGINT, 't': 0::BIGINT, 's': 0::BIGINT}], [{'tok': 0::BIGINT, 'last': 0::BIGINT, 'ok': 0::BIGINT, 'bytes': 0::BIGINT, 't': x.t, 's': x.s} for x in xs]) AS ys FROM o),
r AS (SELECT stream_id, list_reduce(ys, lambda a, x: {
 'tok': CASE WHEN x.t - a.last >= 1000 AND (x.t - a.last) * 100000 // 1000000 > 0 THEN least(100000, a.tok + (x.t - a.last) * 100000 // 1000000) ELSE a.tok END - CASE WHEN x.s <= CASE WHEN x.t - a.last >= 1000 AND (x.t - a.last) * 100000 // 1000000 > 0 THEN least(100000, a.tok + (x.t - a.last) * 100000 // 1000000) ELSE a.tok END THEN x.s ELSE 0 END,
 'last': CASE WHEN x.t - a.last >= 1000 AND (x.t - a.last) * 100000 // 1000000 > 0 THEN x.t ELSE a.last END,
 'ok': a.ok + CASE WHEN x.s <= CASE WHEN x.t - a.last >= 1000 AND (x.t - a.last) * 100000 // 1000000 > 0 THEN least(100000, a.tok + (x.t - a.last) * 100000 // 1000000) ELSE a.tok END THEN 1 ELSE 0 END,
 'bytes': a.bytes + CASE WHEN x.s <= CASE WHEN x.t - a.last >= 1000 AND (x.t - a.last) * 100000 // 1000000 > 0 THEN least(100000, a.tok + (x.t - a.last) * 100000 // 1000000) ELSE a.tok END THEN x.s ELSE 0 END, 't': x.t, 's': x.s}) AS f FROM z)
SELECT stream_id, CAST(f.ok AS BIGINT) AS admitted, CAST(f.bytes AS BIGINT) AS bytes, CAST(f.tok AS BIGINT) AS tokens FROM r""")
def token_bucket(spark, sf_dir):
    rows = folds.token_bucket(packets(spark, sf_dir).select("stream_id", "arrival_idx", "capture_us", "size"), rate=100_000)
    return rows.groupBy("stream_id").agg(F.count_if("allowed").alias("admitted"), F.coalesce(F.sum(F.when(F.col("allowed"), F.col("size"))), F.lit(0)).alias("bytes"), F.max_by("tokens", "arrival_idx").alias("tokens"))


@add(160, sql=WITH + """, t AS (SELECT stream_id, arrival_idx, (size % 101) / 100.0 AS p FROM packets), h AS (SELECT *, list(p) OVER (PARTITION BY stream_id ORDER BY arrival_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ps FROM t)
SELECT stream_id, arrival_idx, CAST(round(list_sum([ps[i] * i for i in range(1, len(ps) + 1)]) / (len(ps) * (len(ps) + 1) / 2), 6) AS DOUBLE) AS smoothed FROM h""")
def smoothed_pressure(spark, sf_dir):
    last = seq.arrival().rowsBetween(-9, 0)
    rows = packets(spark, sf_dir).withColumn("ps", F.collect_list((F.col("size") % 101) / 100.0).over(last))
    total = F.aggregate(F.transform("ps", lambda p, i: p * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("stream_id", "arrival_idx", F.round(total / (F.size("ps") * (F.size("ps") + 1) / 2), 6).alias("smoothed"))


@add(233)
def rate_controller(spark, sf_dir):
    ticks = packets(spark, sf_dir).groupBy("stream_id", F.expr("capture_us div 1000000").alias("tick")).agg(((F.sum("size") % 101) / 100.0).alias("pressure"))
    return folds.rate_controller(ticks, least=100_000, most=50_000_000).select("stream_id", "tick", F.round("smoothed", 6).alias("smoothed"), "rate")


@add(242)
def circuit_breaker(spark, sf_dir):
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", "capture_us", (F.col("event_type") == "error").alias("failed"))
    return folds.circuit_breaker(rows, "failed", threshold=2, timeout_us=500_000).select("stream_id", "arrival_idx", "allowed", "state")


@add(241)
def quality_ladder(spark, sf_dir):
    rows = metrics(spark, sf_dir).withColumn("score", scores.adaptive_quality(*[F.col(x) for x in ("cpu", "memory", "drops", "loss", "latency_ms")])).withColumn("bandwidth", F.col("latency_ms") * 100_000)
    return folds.quality_ladder(rows, (50_000_000, 25_000_000, 10_000_000, 5_000_000, 2_000_000)).select("stream_id", "win", "profile")


@add(235)
def connection_limits(spark, sf_dir):
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", (F.col("event_type").isin("click", "view", "signup")).alias("opens"))
    return folds.connection_limit(rows, 25).select("stream_id", "arrival_idx", "admitted", "held")


_PDV = (WITH + """, t AS (SELECT stream_id, arrival_idx, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS n, CASE WHEN event_id % 31 = 0 THEN -pts - 1 ELSE (pts + 8589900000) % 8589934592 END AS pts, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 37 = 0 THEN (dts + 8589850000) % 8589934592 ELSE (dts + 8589900000) % 8589934592 END AS dts FROM packets),
z AS (SELECT stream_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS lp, CAST(NULL AS BIGINT) AS ld, CAST(0 AS BIGINT) AS pw, CAST(0 AS BIGINT) AS dw, CAST(NULL AS BIGINT) AS arrival_idx, CAST(NULL AS VARCHAR) AS problem, '' AS warnings FROM packets GROUP BY stream_id),
r AS (SELECT * FROM z UNION ALL (
 SELECT stream_id, n, CASE WHEN problem IS NULL THEN pts ELSE lp END, CASE WHEN problem IS NULL THEN dts ELSE ld END, pw + CASE WHEN seen AND lp IS NOT NULL AND pts - lp < -4294967295 THEN 1 ELSE 0 END,
  dw + CASE WHEN seen AND back > 4294967295 THEN 1 ELSE 0 END, arrival_idx, problem,
  CASE WHEN seen THEN concat_ws(',', CASE WHEN dts <> 0 AND pts - dts > 90000 THEN 'lead' END, CASE WHEN pts - lp < -4294967295 THEN 'wrap' WHEN pts - lp > 900000 THEN 'jump' WHEN pts - lp < 0 AND pts - lp > -900000 THEN 'behind' END, CASE WHEN back > 4294967295 THEN 'dts wrap' END) ELSE '' END
 FROM (SELECT *, problem IS NULL OR problem = 'back' AS seen FROM (SELECT *, CASE WHEN pts < 0 OR pts > 8589934591 OR dts < 0 OR dts > 8589934591 THEN 'range' WHEN dts <> 0 AND pts < dts THEN 'order' WHEN back > 0 AND back < 900000 THEN 'back' END AS problem
  FROM (SELECT t.*, r.lp, r.ld, r.pw, r.dw, CASE WHEN t.dts <> 0 AND r.ld <> 0 THEN r.ld - t.dts ELSE 0 END AS back FROM r JOIN t ON t.stream_id = r.stream_id AND t.n = r.n + 1) a) b) c))
SELECT stream_id, arrival_idx, problem, warnings, pw AS pts_wraps, dw AS dts_wraps FROM r WHERE n > 0""").replace("WITH packets", "WITH RECURSIVE packets", 1)


@add(197, sql=_PDV)
def timestamp_validation(spark, sf_dir):
    """Times near their wrap, some negative, some without a DTS, some with one that goes back."""
    e, top = F.col("event_id"), F.lit(1 << 33)
    pts = F.when(e % 31 == 0, -F.col("pts") - 1).otherwise(F.pmod(F.col("pts") + 8589900000, top))
    dts = F.when(e % 13 == 0, 0).when(e % 37 == 0, F.pmod(F.col("dts") + 8589850000, top)).otherwise(F.pmod(F.col("dts") + 8589900000, top))
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", pts.alias("pts"), dts.alias("dts"))
    return folds.checked_timestamps(rows).select("stream_id", "arrival_idx", "problem", F.array_join("warnings", ",").alias("warnings"), "pts_wraps", "dts_wraps")


@add(245, sql=(WITH + """, a AS (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY capture_us, arrival_idx) AS n FROM (SELECT CAST(stream_id AS VARCHAR) || ':' || frame_type AS alert, stream_id, arrival_idx, capture_us FROM packets WHERE event_type = 'error') x),
r AS (SELECT *, true AS sent, capture_us AS last FROM a WHERE n = 1 UNION ALL (SELECT a.*, a.capture_us - r.last > 5000000, CASE WHEN a.capture_us - r.last > 5000000 THEN a.capture_us ELSE r.last END FROM r JOIN a ON a.alert = r.alert AND a.n = r.n + 1))
SELECT stream_id, arrival_idx, alert, sent FROM r""").replace("WITH packets", "WITH RECURSIVE packets", 1))
def alert_deduplication(spark, sf_dir):
    rows = packets(spark, sf_dir).filter("event_type = 'error'").select(F.concat_ws(":", "stream_id", "frame_type").alias("alert"), "stream_id", "arrival_idx", "capture_us")
    return folds.alert_deduplication(rows, 5_000_000).select("stream_id", "arrival_idx", "alert", "sent")


@add(239, sql=WITH + ", e AS (SELECT stream_id, arrival_idx, capture_us FROM packets WHERE event_type = 'error'), k AS (SELECT stream_id, capture_us AS key_us FROM packets WHERE frame_type = 'IDR') SELECT e.stream_id, e.arrival_idx, min(k.key_us) - e.capture_us AS wait_us FROM e LEFT JOIN k ON e.stream_id = k.stream_id AND k.key_us > e.capture_us AND k.key_us <= e.capture_us + 300000 GROUP BY e.stream_id, e.arrival_idx, e.capture_us")
def keyframe_waits(spark, sf_dir):
    """How long after each error the next keyframe comes, if it comes in time."""
    after = seq.Window.partitionBy("stream_id").orderBy("capture_us").rangeBetween(1, 300_000)
    rows = packets(spark, sf_dir).withColumn("next", F.min(F.when(F.col("frame_type") == "IDR", F.col("capture_us"))).over(after))
    return rows.filter("event_type = 'error'").select("stream_id", "arrival_idx", (F.col("next") - F.col("capture_us")).alias("wait_us"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("nr"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("bitrate"))


@add(15, 16, 20, 21, 22, 23, sql="""SELECT o_custkey AS stream_id, arg_max(o_orderstatus, {'a': o_orderdate, 'b': o_orderkey}) AS status, arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS bitrate, max(o_orderdate) AS last_heartbeat, min(o_orderdate) AS created_at, count(*) AS n_updates FROM orders GROUP BY o_custkey""")
def registry_upsert(spark, sf_dir):
    rows = registry.upserted(_orders(spark, sf_dir), "stream_id", ["at", "nr"])
    return rows.select("stream_id", "status", "bitrate", F.col("at").alias("last_heartbeat"), "created_at", "n_updates")


@add(17, 19, sql="""WITH n AS (SELECT max(o_orderdate) AS now FROM orders), f AS (SELECT DISTINCT o_custkey FROM orders, n WHERE o_orderdate > n.now - INTERVAL 180 DAY)
SELECT c_custkey AS stream_id, c_name AS name, c_custkey IN (SELECT o_custkey FROM f) AS alive FROM customer""")
def registry_list(spark, sf_dir):
    streams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_name").alias("name"))
    beats = _orders(spark, sf_dir)
    alive, expired = registry.live(streams, beats, "stream_id", "at", "180 DAY")
    return alive.withColumn("alive", F.lit(True)).unionByName(expired.withColumn("alive", F.lit(False)))


@add(18, sql="SELECT c_custkey AS stream_id, c_name AS name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 25")
def registry_page(spark, sf_dir):
    streams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_name").alias("name"))
    return registry.page(streams, "stream_id", 40, 25)


@add(95, 96, 97, 125, sql="""WITH s AS (SELECT o_custkey, count(*) AS frames, max(o_totalprice) AS bitrate FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT c_custkey AS stream_id, c_mktsegment AS kind, coalesce(s.bitrate, c_acctbal) AS bitrate, coalesce(s.frames, 0) AS frames, s.o_custkey IS NOT NULL AS handled FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def registry_with_statistics(spark, sf_dir):
    stats = _orders(spark, sf_dir).filter("status = 'O'").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.max("bitrate").alias("live"), F.lit(True).alias("h"))
    streams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("stored"))
    return streams.join(stats, "stream_id", "left").select("stream_id", "kind", F.coalesce("live", "stored").alias("bitrate"), F.coalesce("n", F.lit(0)).alias("frames"), F.coalesce("h", F.lit(False)).alias("handled"))


@add(128, sql="SELECT c_nationkey AS node, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY c_nationkey")
def streams_by_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return rows.select("node", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


_ST = """WITH s AS (SELECT c_custkey AS stream_id, c_nationkey AS node, CAST(floor(c_acctbal + 2000) AS BIGINT) AS memory, CAST(c_custkey % 11 AS BIGINT) AS priority, c_custkey % 7 = 0 AS active, CAST((c_custkey * 37) % 1009 AS BIGINT) AS age FROM customer)"""


def _streams(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("stream_id"), F.col("c_nationkey").alias("node"), F.floor(F.col("c_acctbal") + 2000).alias("memory"), (k % 11).alias("priority"), (k % 7 == 0).alias("active"), ((k * 37) % 1009).alias("age"))


def _evict_sql(order: str, select: str = "*") -> str:
    return _ST + f", h AS (SELECT {select} FROM s), e AS (SELECT *, coalesce(sum(memory) OVER (PARTITION BY node ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT node, stream_id, memory FROM e WHERE before < 50000"


def _evict(spark, sf_dir, *order):
    return registry.evicted(_streams(spark, sf_dir), F.lit(50_000), list(order)).select("node", "stream_id", "memory")


@add(176, sql=_evict_sql("active, age DESC, stream_id"))
def evict_least_recent(spark, sf_dir):
    return _evict(spark, sf_dir, F.asc("active"), F.desc("age"), F.asc("stream_id"))


@add(177, sql=_evict_sql("priority DESC, age DESC, stream_id"))
def evict_by_priority(spark, sf_dir):
    return _evict(spark, sf_dir, F.desc("priority"), F.desc("age"), F.asc("stream_id"))


@add(178, sql=_evict_sql("memory DESC, stream_id"))
def evict_by_size(spark, sf_dir):
    return _evict(spark, sf_dir, F.desc("memory"), F.asc("stream_id"))


@add(179, sql=_evict_sql("active, score DESC, stream_id", "*, round(0.4 * age / max(age) OVER (PARTITION BY node) + 0.4 * memory / max(memory) OVER (PARTITION BY node) + 0.2 * priority / 10.0, 9) AS score"))
def evict_hybrid(spark, sf_dir):
    rows = _streams(spark, sf_dir).withColumn("score", registry.hybrid_score())
    return registry.evicted(rows, F.lit(50_000), [F.asc("active"), F.desc("score"), F.asc("stream_id")]).select("node", "stream_id", "memory")


@add(129, 130, 131, sql=_ST + "SELECT node, count(*) FILTER (WHERE active) AS active, CAST(sum(memory) AS BIGINT) AS total, round(max(memory) / CAST(sum(memory) AS DOUBLE), 6) AS largest_share, round(sum(memory) / 1000000.0 + sum(CASE WHEN active THEN memory ELSE 0 END) / 104857600.0, 6) AS pressure FROM s GROUP BY node")
def memory_statistics(spark, sf_dir):
    total = F.sum("memory")
    return _streams(spark, sf_dir).groupBy("node").agg(F.count_if("active").alias("active"), total.alias("total"), F.round(F.max("memory") / total, 6).alias("largest_share"), F.round(total / 1000000.0 + F.sum(F.when(F.col("active"), F.col("memory")).otherwise(0)) / 104857600.0, 6).alias("pressure"))


@add(4, sql="SELECT event_id, CAST(user_id AS VARCHAR) || '/' || event_type AS stream_key FROM events WHERE regexp_matches(CAST(user_id AS VARCHAR) || '/' || event_type, '^[0-9]{1,3}/(view|click)$')")
def admission_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "user_id", "event_type").alias("stream_key"))
    return rows.filter(F.col("stream_key").rlike(r"^[0-9]{1,3}/(view|click)$"))
