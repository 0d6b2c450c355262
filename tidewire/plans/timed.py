"""Queries by machines with clocks, over a table and over a stream of it. The stream comes in parts that overlap in time; both forms must
give the same outcomes up to the stream's watermark."""

from __future__ import annotations

import time
import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import machines
from tidewire.sources.projections import packets
from tidewire.sources.session import kept, shared_folder
from tidewire.streaming import keyed, live

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add

#: Parts of a stream, how far they overlap, how late rows may be.
PARTS, OVERLAP_US, LATE_MS = 6, 150_000, 250
#: Rows of a part that go to one of its files.
FILE_ROWS = 500_000
_BUFFER = partial(machines.JitterBuffer, most=3, delay_us=90_000)
_RECOVERY = partial(machines.Recovery, wait_us=200_000, most_us=300_000)


def buffered(spark, sf_dir) -> DataFrame:
    """Packets, some of them twice."""
    rows = packets(spark, sf_dir).select("stream_id", "capture_us", "event_id", "seq", "rtp_ts")
    again = rows.filter(F.col("event_id") % 19 == 0).withColumns({"capture_us": F.col("capture_us") + 700, "event_id": F.col("event_id") + 1_000_000_000})
    return rows.unionByName(again)


def errors(spark, sf_dir) -> DataFrame:
    """Key frames and errors of each stream."""
    e = F.col("event_id")
    kind = F.when(F.col("frame_type") == "IDR", 0).when(e % 5 == 0, 1 + F.floor(e / 5) % 6)
    return packets(spark, sf_dir).select("stream_id", "capture_us", "event_id", kind.cast("long").alias("kind"), (e % 11).alias("amount"), (e % 4 == 0).alias("closed"), (e % 3 == 0).alias("clean")).filter("kind IS NOT NULL")


def streamed(rows: DataFrame) -> DataFrame:
    """``rows`` as a stream: parts by time, written one after the other and read one a batch; a fifth of the rows comes in a part
    that is up to ``OVERLAP_US`` late. All parts have the same number of files, which follows the rows, so that a batch is
    a part and no part passes one task."""
    spark = rows.sparkSession
    to = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    low, high, n = rows.agg(F.min("capture_us"), F.max("capture_us"), F.count(F.lit(1))).first()
    files = 1 + n // (PARTS * FILE_ROWS)
    at = F.col("capture_us") + F.when(F.col("event_id") % 5 == 0, OVERLAP_US).otherwise(0)
    part = F.floor((at - (low or 0)) * PARTS / ((high or 0) - (low or 0) + OVERLAP_US + 1)).cast("int")
    held, none, known = rows.withColumn("part", part), spark.createDataFrame([], rows.schema), 0
    for k in range(PARTS):
        of_part = held.filter(F.col("part") == k).drop("part")
        (of_part.coalesce(1) if files == 1 else of_part.repartition(files)).write.mode("append").parquet(to)
        while files > 1 and len(spark.read.schema(rows.schema).parquet(to).inputFiles()) < known + files:
            # tasks without rows write no file
            none.coalesce(1).write.mode("append").parquet(to)
        known += files
        time.sleep(0.02)  # files are read in the order of their times
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(to)


def passed(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """Outcomes that the last watermark of a stream of ``rows`` has passed."""
    end = rows.agg((F.floor(F.max("capture_us") / 1000) - LATE_MS - 1).alias("end"))
    return outcomes.crossJoin(F.broadcast(end)).filter(F.col("decided_us") < F.col("end") * 1000).drop("end")  # one row


def told(machine: type, outcomes: DataFrame) -> DataFrame:
    return outcomes.select("stream_id", "decided_us", "event_id", machines.named(machine, F.col("outcome")).alias("outcome"))


_J = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT stream_id, capture_us AS t, event_id AS e, seq, rtp_ts FROM packets UNION ALL SELECT stream_id, capture_us + 700, event_id + 1000000000, seq, rtp_ts FROM packets WHERE event_id % 19 = 0),
b AS (SELECT *, row_number() OVER w AS rn, first_value(t) OVER w AS t0, first_value(rtp_ts) OVER w AS ts0, coalesce((seq - lag(seq) OVER w + 98304) % 65536 - 32768, seq) AS moved FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY t, e)),
j AS (SELECT stream_id, rn, t, e, CAST(sum(moved) OVER (PARTITION BY stream_id ORDER BY rn) AS BIGINT) AS u, t0 + CAST(floor(((rtp_ts - ts0 + 6442450944) % 4294967296 - 2147483648) * 1000000 / 90000.0) AS BIGINT) + 90000 AS p FROM b),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(u BIGINT, p BIGINT, e BIGINT)[]) AS buf, CAST([] AS STRUCT(t BIGINT, e BIGINT, o INT)[]) AS out FROM j WHERE rn = 1
 UNION ALL SELECT stream_id, rn, buf3[k2 + 1:], CAST(o1 || o2 || list_transform(buf3[1:k2], lambda x: {'t': t, 'e': x.e, 'o': CASE WHEN t - x.p > 90000 THEN 1 ELSE 0 END}) AS STRUCT(t BIGINT, e BIGINT, o INT)[]) FROM
 (SELECT *, len(list_filter(range(1, len(buf3) + 1), lambda i: NOT again AND list_max(list_transform(buf3[1:i], lambda x: x.p)) <= t)) AS k2 FROM
 (SELECT *, CASE WHEN again THEN buf1 ELSE list_sort(CASE WHEN len(buf1) >= 3 THEN buf1[2:] ELSE buf1 END || [{'u': u, 'p': p, 'e': e}]) END AS buf3, CASE WHEN again THEN [{'t': t, 'e': e, 'o': 3}] WHEN len(buf1) >= 3 THEN [{'t': t, 'e': buf1[1].e, 'o': 2}] ELSE [] END AS o2 FROM
 (SELECT *, len(list_filter(buf1, lambda x: x.u = u)) > 0 AS again FROM
 (SELECT *, buf[k1 + 1:] AS buf1, list_transform(range(1, k1 + 1), lambda i: {'t': list_max(list_transform(buf[1:i], lambda x: x.p)), 'e': buf[i].e, 'o': CASE WHEN list_max(list_transform(buf[1:i], lambda x: x.p)) - buf[i].p > 90000 THEN 1 ELSE 0 END}) AS o1 FROM
 (SELECT j.*, r.buf, len(list_filter(range(1, len(r.buf) + 1), lambda i: list_max(list_transform(r.buf[1:i], lambda x: x.p)) <= j.t)) AS k1 FROM r JOIN j ON j.stream_id = r.stream_id AND j.rn = r.rn + 1) s1) s2) s3) s4) s5),
z AS (SELECT stream_id, unnest(out) AS x FROM r UNION ALL SELECT stream_id, unnest(list_transform(range(1, len(buf) + 1), lambda i: {'t': list_max(list_transform(buf[1:i], lambda y: y.p)), 'e': buf[i].e, 'o': CASE WHEN list_max(list_transform(buf[1:i], lambda y: y.p)) - buf[i].p > 90000 THEN 1 ELSE 0 END})) FROM r JOIN (SELECT stream_id AS s, max(rn) AS m FROM r GROUP BY ALL) ON s = stream_id AND m = rn)
SELECT stream_id, x.t AS decided_us, x.e AS event_id, ['delivered', 'late', 'overflow', 'repeat'][x.o + 1] AS outcome FROM z"""
_PASSED = f" WHERE x.t < (SELECT max(t) // 1000 - {LATE_MS + 1} FROM {{rows}}) * 1000"


@add(171, 188, 189, sql=_J)
def jitter_buffer(spark, sf_dir):
    """What becomes of each packet in a buffer of three: delivered in order of unwrapped numbers, late, pushed out, or a repeat."""
    return told(machines.JitterBuffer, machines.applied(buffered(spark, sf_dir), _BUFFER))


@add(171, 188, 189, sql=_J + _PASSED.format(rows="a"))
def stream_jitter_buffer(spark, sf_dir):
    """The same over a stream of unordered parts, up to its watermark."""
    rows = kept(buffered(spark, sf_dir))
    found, _ = live.watched(keyed.timed(streamed(rows), _BUFFER, f"{LATE_MS} milliseconds"), provider=keyed.PROVIDER)
    return told(machines.JitterBuffer, passed(found.drop("batch"), rows))


_R = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT stream_id, capture_us AS t, event_id AS e, CASE WHEN frame_type = 'IDR' THEN 0 WHEN event_id % 5 = 0 THEN 1 + event_id // 5 % 6 END AS kind FROM packets),
j AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, e) AS rn FROM a WHERE kind IS NOT NULL),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS rn, 0 AS state, CAST(-1 AS BIGINT) AS began, CAST(-1 AS BIGINT) AS asked, CAST([] AS STRUCT(t BIGINT, e BIGINT, o INT)[]) AS out FROM j WHERE rn = 1
 UNION ALL SELECT stream_id, rn, CASE c WHEN 'key' THEN 0 WHEN 'fail' THEN 3 WHEN 'lose' THEN 1 WHEN 'quick' THEN 0 WHEN 'sync' THEN 2 ELSE s1 END, CASE WHEN c IN ('lose', 'quick') OR c = 'sync' AND s1 <> 2 THEN t ELSE began END, CASE WHEN c = 'key' THEN -1 WHEN c IN ('ask', 'lose', 'sync') THEN t ELSE a1 END,
 CAST(o1 || CASE WHEN c = 'key' AND s1 <> 0 THEN [{'t': t, 'e': e, 'o': 0}] WHEN c = 'fail' THEN [{'t': t, 'e': e, 'o': 3}] WHEN c = 'lose' THEN [{'t': t, 'e': e, 'o': 1}] WHEN c = 'quick' THEN [{'t': t, 'e': e, 'o': 1}, {'t': t, 'e': e, 'o': 0}] WHEN c = 'sync' AND s1 <> 2 THEN [{'t': t, 'e': e, 'o': 2}] ELSE [] END AS STRUCT(t BIGINT, e BIGINT, o INT)[]) FROM
 (SELECT *, CASE WHEN kind = 0 THEN CASE WHEN a1 >= 0 AND a1 < t THEN 'key' ELSE 'none' END WHEN s1 = 1 THEN CASE WHEN t - began > 300000 THEN 'fail' ELSE 'ask' END WHEN kind = 4 AND e % 11 < 5 THEN 'none'
 WHEN kind IN (1, 2, 4) THEN CASE WHEN CASE WHEN kind = 2 THEN e % 3 = 0 ELSE e % 4 = 0 END THEN 'quick' ELSE 'lose' END ELSE 'sync' END AS c FROM
 (SELECT j.*, r.began, CASE WHEN fired THEN 3 ELSE state END AS s1, CASE WHEN fired THEN -1 ELSE asked END AS a1, CASE WHEN fired AND state <> 3 THEN [{'t': asked + 200000, 'e': -1, 'o': 3}] ELSE [] END AS o1
 FROM (SELECT r.*, j AS j, asked >= 0 AND asked + 200000 <= j.t AS fired FROM r JOIN j ON j.stream_id = r.stream_id AND j.rn = r.rn + 1) r) s1) s2),
z AS (SELECT stream_id, unnest(out) AS x FROM r UNION ALL SELECT stream_id, {'t': asked + 200000, 'e': -1, 'o': 3} FROM r JOIN (SELECT stream_id AS s, max(rn) AS m FROM r GROUP BY ALL) ON s = stream_id AND m = rn WHERE asked >= 0 AND state <> 3)
SELECT stream_id, x.t AS decided_us, CAST(x.e AS BIGINT) AS event_id, ['normal', 'recovering', 'resyncing', 'failed'][x.o + 1] AS outcome FROM z"""


@add(238, sql=_R)
def recovery_states(spark, sf_dir):
    """The states that each stream enters by its errors, key frames and waits that run out."""
    return told(machines.Recovery, machines.applied(errors(spark, sf_dir), _RECOVERY))


@add(238, sql=_R + _PASSED.format(rows="j"))
def stream_recovery_states(spark, sf_dir):
    """The same over a stream, whose waits run out by timers."""
    rows = kept(errors(spark, sf_dir))
    found, _ = live.watched(keyed.timed(streamed(rows), _RECOVERY, f"{LATE_MS} milliseconds"), provider=keyed.PROVIDER)
    return told(machines.Recovery, passed(found.drop("batch"), rows))
