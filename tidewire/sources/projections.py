"""Projections of the ``events`` table to packets and audio samples, in SQL that Spark and DuckDB
both run, so that both sides of a comparison read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS = """
WITH e AS (
  SELECT event_id, event_type, value, user_id AS stream_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n
  FROM events),
p AS (
  SELECT stream_id, n, event_id, event_type,
         CAST((65500 + n) % 65536 AS INT) AS seq,
         (4294900000 + n * 3000) % 4294967296 AS rtp_ts,
         n * 3000 AS dts,
         CASE WHEN n % 3 = 0 THEN (n + 3) * 3000 ELSE n * 3000 END AS pts,
         CASE WHEN n % 12 = 0 THEN 'IDR' WHEN n % 3 = 0 THEN 'P' ELSE 'B' END AS frame_type,
         CAST(floor(value * 100) AS BIGINT) AS size,
         n + CASE WHEN event_id % 23 = 0 THEN 3 ELSE 0 END AS arrival_key
  FROM e WHERE event_id % 17 <> 0)
SELECT stream_id, seq, rtp_ts, pts, dts, frame_type, size, event_id, event_type,
       CAST(row_number() OVER (PARTITION BY stream_id ORDER BY arrival_key, n) AS BIGINT) AS arrival_idx,
       1704067200000000 + n * 33333 + (event_id % 7) * 1000
         + CASE WHEN event_id % 23 = 0 THEN 99999 ELSE 0 END AS capture_us
FROM p"""

AUDIO = """
SELECT user_id AS stream_id, event_id, n * 1600 + n * 16 AS audio_pts,
       1704067200000000 + n * 33333 AS capture_us
FROM (SELECT user_id, event_id, event_type,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n
      FROM events) e
WHERE event_type = 'view'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, PACKETS)


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, AUDIO)
