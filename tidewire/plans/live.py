"""Queries that run as streams over all input there is, and must equal their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.streaming import live

from .base import Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add(161, 162, sql="SELECT user_id AS stream_id, epoch_us(ts) // 86400000000 * 86400 AS window_s, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def stream_rate_windows(spark, sf_dir):
    rows = live.drained(live.rate_windows(live.event_stream(spark, sf_dir), late=live.lateness(spark, sf_dir)), "update")
    return rows.groupBy("stream_id", "window_s").agg(F.max_by("n", "batch").alias("n"), F.max_by("ids", "batch").alias("ids"))


@add(188, sql="SELECT event_id, user_id AS stream_id FROM events")
def stream_deduplication(spark, sf_dir):
    events = live.event_stream(spark, sf_dir)
    return live.drained(live.deduplicated(events.union(events), live.lateness(spark, sf_dir)).select("event_id", "stream_id")).select("event_id", "stream_id")


@add(252, sql="""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t_us FROM events),
n AS (SELECT *, CASE WHEN coalesce(t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) >= 28800000000, true) THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS session FROM n) SELECT user_id, min(t_us) AS started_us, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    # all sessions so far, open ones too: the last batch has them complete
    rows = live.drained(live.idle_sessions(live.event_stream(spark, sf_dir)), "complete")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select("user_id", "started_us", "n", "first_id")


@add(191, 193, sql="WITH d AS (SELECT user_id AS stream_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT stream_id, max(event_id) AS high, CAST(sum(greatest(step - 1, 0)) AS BIGINT) AS lost FROM d GROUP BY stream_id")
def stream_gap_counts(spark, sf_dir):
    rows = live.drained(live.gap_counts(live.event_stream(spark, sf_dir)), "update")
    return rows.groupBy("stream_id").agg(F.max("high").alias("high"), F.max_by("lost", "batch").alias("lost"))
