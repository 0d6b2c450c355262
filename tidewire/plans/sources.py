"""Queries over the registry's log, over what its streams hold, and over the packets of a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import avsync, folds, registry, sequences
from tidewire.sources.projections import packets, table

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add

_LOG = """WITH l AS (SELECT o_custkey AS stream_id, o_orderdate AS made, o_orderkey AS nr, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 7 < 4 THEN 'update' ELSE 'set' END AS op, CASE WHEN o_orderkey % 7 > 1 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 <> 2 THEN o_totalprice END AS bitrate FROM orders),
t AS (SELECT *, coalesce(last_value(CASE op WHEN 'set' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY made, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM l), a AS (SELECT *, op = 'set' OR there AS applied FROM t)
"""


def _log(spark, sf_dir):
    """Orders as writes to the registry: some set all, some update a column, some delete."""
    way = F.col("o_orderkey") % 7
    op = F.when(way == 0, "delete").when(way < 4, "update").otherwise("set")
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("stream_id"), F.col("o_orderdate").alias("made"), F.col("o_orderkey").alias("nr"), op.alias("op"), F.when(way > 1, F.col("o_orderstatus")).alias("status"), F.when(way != 2, F.col("o_totalprice")).alias("bitrate"))


@add(19, 23, sql=_LOG + "SELECT stream_id, nr, op, applied FROM a")
def registry_log(spark, sf_dir):
    """Which writes apply: sets always, updates and deletes only where the key is."""
    return registry.replayed(_log(spark, sf_dir), "stream_id", ["made", "nr"]).select("stream_id", "nr", "op", "applied")


@add(16, 22, 19, sql=_LOG + """, g AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY made, nr) AS life FROM a WHERE applied), n AS (SELECT *, max(life) OVER (PARTITION BY stream_id) AS newest FROM g)
SELECT stream_id, arg_max(status, {'a': made, 'b': nr}) FILTER (WHERE status IS NOT NULL) AS status, arg_max(bitrate, {'a': made, 'b': nr}) FILTER (WHERE bitrate IS NOT NULL) AS bitrate, min(made) AS created_at, count(*) AS n_writes FROM n WHERE life = newest AND op <> 'delete' GROUP BY stream_id""")
def registry_current(spark, sf_dir):
    """What the log leaves of each stream that is there."""
    return registry.current(_log(spark, sf_dir), "stream_id", ["made", "nr"], ["status", "bitrate"])


@add(97, sql="""SELECT c_custkey AS stream_id, c_mktsegment AS kind, s.frames, s.bitrate, m.memory FROM customer JOIN (SELECT o_custkey AS k, count(*) AS frames, max(o_totalprice) AS bitrate FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) s ON s.k = c_custkey
 JOIN (SELECT o_custkey AS k, count(*) AS memory FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) m ON m.k = c_custkey""")
def registry_usage(spark, sf_dir):
    """Streams that are registered, have a handler and use memory: all three are joined on the stream."""
    streams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_mktsegment").alias("kind"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), "o_orderstatus", "o_totalprice")
    handled = orders.filter("o_orderstatus = 'O'").groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.max("o_totalprice").alias("bitrate"))
    used = orders.filter("o_orderstatus = 'F'").groupBy("stream_id").agg(F.count(F.lit(1)).alias("memory"))
    return streams.join(handled, "stream_id").join(used, "stream_id")


@add(224, sql=WITH + """, t AS (SELECT *, (pts + 8589934592 - 90000) % 8589934592 AS p FROM packets), d AS (SELECT *, coalesce((p - lag(p) OVER w + 12884901888) % 8589934592 - 4294967296, 0) AS step, first_value(p) OVER w AS p0, first_value(capture_us) OVER w AS c0 FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx)),
u AS (SELECT *, p0 + sum(step) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS u FROM d) SELECT stream_id, arrival_idx, p AS pts, CAST(floor(u / 8589934592.0) AS BIGINT) AS wraps, CAST(c0 + trunc((u - p0) * 1000000 / 90000.0) AS BIGINT) AS present_us FROM u""")
def track_wraps(spark, sf_dir):
    """Presentation times over the wrap of 33-bit times, and how often these have wrapped."""
    rows = packets(spark, sf_dir).withColumn("pts", F.pmod(F.col("pts") - 90_000, F.lit(1 << 33)))
    found = avsync.timeline(sequences.unwrapped(rows, "pts", 33, "unwrapped").withColumnsRenamed({"pts": "as_come", "unwrapped": "pts"}))
    return found.select("stream_id", "arrival_idx", F.col("as_come").alias("pts"), F.floor(F.col("pts") / (1 << 33)).alias("wraps"), "present_us")


_SOURCE = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT stream_id, arrival_idx AS n, CASE WHEN event_id % 53 = 0 THEN 1 ELSE 2 END AS version, 94 + event_id % 36 AS kind, CASE WHEN event_id % 6 = 0 THEN event_id % 48 END AS padding, CASE WHEN event_id % 47 = 0 THEN 11 WHEN event_id % 59 = 0 THEN 70000 ELSE 12 + event_id % 31 END AS bytes,
 CASE WHEN event_id % 41 = 0 THEN (seq + 500) % 65536 ELSE seq END AS seq, CASE WHEN event_id % 43 = 0 THEN (rtp_ts + 9000000) % 4294967296 WHEN event_id % 37 = 0 THEN (rtp_ts + 4294967296 - 21000) % 4294967296 WHEN event_id % 11 = 0 THEN (rtp_ts + 4294967296 - 6000) % 4294967296 ELSE rtp_ts END AS ts FROM packets),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS BIGINT) AS lseq, CAST(0 AS BIGINT) AS lts, CAST(0 AS BIGINT) AS high, 0 AS taken, CAST([] AS BIGINT[]) AS times, CAST(3000 AS BIGINT) AS duration, false AS back FROM s WHERE n = 1
 UNION ALL SELECT stream_id, n, problem, CASE WHEN problem IS NULL THEN seq ELSE lseq END, CASE WHEN problem IS NULL THEN ts ELSE lts END, CASE WHEN wrong IS NOT NULL OR gap THEN high WHEN problem IS NOT NULL THEN high1 ELSE greatest(CASE WHEN lseq IS NULL THEN ts ELSE high1 END, ts) END, taken + CASE WHEN problem IS NULL THEN 1 ELSE 0 END, CASE WHEN wrong IS NOT NULL OR gap THEN times ELSE times1 END, duration1, back1 FROM
 (SELECT *, wrong IS NULL AND NOT gap AND lseq IS NOT NULL AND ts < high1 AS back1, CASE WHEN wrong IS NOT NULL THEN wrong WHEN lseq IS NULL THEN NULL WHEN gap THEN 'gap' WHEN taken < 3 AND ts - lts > 5400000 AND lts > 0 THEN 'jump' WHEN taken >= 3 AND (ts - high1 > 5400000 OR high1 - ts > 5 * duration1) THEN 'jump' END AS problem FROM
 (SELECT *, CASE WHEN wrong IS NOT NULL OR gap OR lseq IS NULL THEN duration ELSE coalesce(list_sort(list_transform(steps, lambda d: {'k': -len(list_filter(steps, lambda x: x = d)), 'd': d}))[1].d, 3000) END AS duration1 FROM
 (SELECT *, list_filter(list_transform(range(2, len(times1) + 1), lambda i: times1[i] - times1[i - 1]), lambda d: d BETWEEN 750 AND 9000) AS steps FROM
 (SELECT *, CASE WHEN lts > 4026531840 AND ts < 268435456 THEN ts ELSE high END AS high1, CASE WHEN len(times) >= 10 THEN times[2:] ELSE times END || [ts] AS times1 FROM
 (SELECT s.*, r.lseq, r.lts, r.high, r.taken, r.times, r.duration, CASE WHEN version <> 2 THEN 'version' WHEN kind NOT BETWEEN 96 AND 127 THEN 'payload type' WHEN padding IS NOT NULL AND NOT (padding > 0 AND padding <= bytes) THEN 'padding' WHEN bytes NOT BETWEEN 12 AND 65536 THEN 'bytes' END AS wrong,
 r.lseq IS NOT NULL AND abs((s.seq - r.lseq + 98304) % 65536 - 32768) > 100 AS gap FROM r JOIN s ON s.stream_id = r.stream_id AND s.n = r.n + 1) a) b) c) d) e)
SELECT stream_id, n AS arrival_idx, problem, duration, back FROM r WHERE n > 0"""


@add(72, 73, 75, 194, sql=_SOURCE)
def source_validation(spark, sf_dir):
    """Packets checked by structure and by the state of their source: padding, sizes, gaps, jumps, and times that lie back."""
    e = F.col("event_id")
    seq = F.when(e % 41 == 0, F.pmod(F.col("seq") + 500, F.lit(65536))).otherwise(F.col("seq"))
    moved = F.when(e % 43 == 0, 9_000_000).when(e % 37 == 0, -21_000).when(e % 11 == 0, -6000).otherwise(0)
    rows = packets(spark, sf_dir).select(
        "stream_id", "arrival_idx", F.when(e % 53 == 0, 1).otherwise(2).alias("version"), (F.lit(94) + e % 36).alias("payload_type"), F.when(e % 6 == 0, e % 48).alias("padding"),
        F.when(e % 47 == 0, 11).when(e % 59 == 0, 70_000).otherwise(F.lit(12) + e % 31).alias("bytes"), seq.alias("seq"), F.pmod(F.col("rtp_ts") + moved, F.lit(1 << 32)).alias("rtp_ts"))
    return folds.validated_source(rows).select("stream_id", "arrival_idx", "problem", "duration", "back")


@add(247, sql=WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, f AS (SELECT stream_id, event_id, capture_us AS t, event_id % 7 < 3 AS breach, row_number() OVER (PARTITION BY stream_id ORDER BY capture_us, event_id) AS n FROM packets),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS alert, false AS active, CAST(NULL AS BIGINT) AS resolved FROM f WHERE n = 1
 UNION ALL SELECT stream_id, n, event_id, CASE WHEN up THEN 'raised' WHEN down THEN 'resolved' END, up OR was AND NOT down, CASE WHEN down THEN t ELSE resolved END FROM
 (SELECT f.*, r.active AS was, r.resolved, f.breach AND NOT r.active AND (r.resolved IS NULL OR f.t - r.resolved > 150000) AS up, NOT f.breach AND r.active AS down FROM r JOIN f ON f.stream_id = r.stream_id AND f.n = r.n + 1) x)
SELECT stream_id, event_id, alert, active FROM r WHERE n > 0""")
def alert_cooldowns(spark, sf_dir):
    """Threshold alerts raised and resolved, and silent for a while after they are resolved."""
    rows = packets(spark, sf_dir).select("stream_id", "event_id", "capture_us", (F.col("event_id") % 7 < 3).alias("breach"))
    return folds.alerts_with_cooldown(rows, 150_000).select("stream_id", "event_id", "alert", "active")
