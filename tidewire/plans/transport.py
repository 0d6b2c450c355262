"""Queries over whole transport packets: their fields and clocks, elementary packets put together from bytes, guarded fragments. What
the packet rows were written as is what the SQL side knows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import wire
from tidewire.functions.parsing import bound
from tidewire.functions.wire import hexed
from tidewire.operators import transport
from tidewire.sources.projections import packets

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add

_CLOCK = (1 << 33) * 300


def _packet(pid: Column, starts: Column, field: Column | None, payload: Column, error: Column | None = None, control: Column | None = None, sync: Column | None = None) -> Column:
    """A packet of 188 bytes: header, the adaptation field (without its length; stuffed as far as the payload leaves room), payload."""
    second = F.shiftright(pid, 8) + F.when(starts, 0x40).otherwise(0) + (F.when(error, 0x80).otherwise(0) if error is not None else 0)
    room = F.lit(183) - F.floor(F.length(payload) / 2)
    held = F.when(room > 0, "00").otherwise("") if field is None else field
    stuffed = F.rpad(held, (room * 2).cast("int"), "F")
    ways = F.when(F.length(payload) > 0, 0x30).otherwise(0x20)
    ways = F.when(control, 0).otherwise(ways) if control is not None else ways
    first = F.when(sync, "47").otherwise("46") if sync is not None else F.lit("47")
    return F.concat(first, hexed(second.cast("long"), 2), hexed(pid.bitwiseAND(255).cast("long"), 2), hexed(ways.cast("long"), 2), hexed(room.cast("long"), 2), stuffed, payload)


def _adapted(spark, sf_dir):
    """Packet rows with clocks, discontinuities and damage (ts, in hexadecimal)."""
    e = F.col("event_id")
    q, pid = e % 8, (F.lit(256) + e % 2).cast("long")
    clock = (F.col("arrival_idx") * 900_000_007 + e * 11) % _CLOCK
    base, ext = F.floor(clock / 300).cast("long"), clock % 300
    pcr = F.concat(hexed(F.floor(base / 2).cast("long"), 8), hexed(((base % 2) * 0x8000 + 0x7E00 + ext).cast("long"), 4))
    field = F.when(q == 0, F.concat(F.lit("10"), pcr)).when(q == 1, F.concat(F.lit("90"), pcr)).when(q == 6, "80").otherwise("00")
    payload = F.when(q.isin(0, 6), "").otherwise(hexed(e, 16))
    whole = _packet(pid, e % 3 == 0, field, payload, q == 3, q == 4, ~((q == 7) & (e % 3 == 0)))
    # a field of six bytes has no room for the clock that its flag names; some packets are cut off
    short = F.concat(F.lit("47"), hexed(pid, 4), F.lit("300610"), F.repeat(F.lit("01"), 5), F.repeat(F.lit("AB"), 177))
    ts = F.when((q == 7) & (e % 3 == 1), short).when((q == 7) & (e % 3 == 2), F.substring(whole, 1, 374)).otherwise(whole)
    return packets(spark, sf_dir).select("stream_id", "arrival_idx", ts.alias("ts"))


_A = WITH + f", x AS (SELECT stream_id, arrival_idx, event_id AS e, event_id % 8 AS q, event_id % 3 AS t, 256 + event_id % 2 AS pid, (arrival_idx * 900000007 + event_id * 11) % {_CLOCK} AS clock FROM packets)"


@add(26, 74, sql=_A + """ SELECT stream_id, arrival_idx, CASE WHEN q = 3 THEN 'error' WHEN q = 4 THEN 'control' WHEN q = 7 AND t = 0 THEN 'sync' WHEN q = 7 AND t = 2 THEN 'length' END AS problem, CAST(CASE WHEN q = 7 AND t = 1 THEN 256 + e % 2 ELSE pid END AS BIGINT) AS pid,
 CASE WHEN q IN (0, 1) THEN CAST(clock AS BIGINT) END AS pcr, CASE WHEN NOT (q IN (3, 4) OR q = 7 AND t <> 1) THEN q IN (1, 6) END AS discontinuity, CASE WHEN q IN (1, 2, 5) THEN printf('%016X', e) WHEN q = 7 AND t = 1 THEN repeat('AB', 177) END AS payload FROM x""")
def transport_fields(spark, sf_dir):
    """Adaptation fields with clocks and flags, and packets that are damaged in each way."""
    rows = _adapted(spark, sf_dir).withColumn("f", bound(F.col("ts"), transport.fields))
    return rows.select("stream_id", "arrival_idx", "f.problem", "f.pid", "f.pcr", "f.discontinuity", "f.payload")


@add(26, sql=_A + f""", d AS (SELECT *, sum(CASE WHEN q IN (1, 6) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, pid ORDER BY arrival_idx) AS epoch FROM x WHERE NOT (q IN (3, 4) OR q = 7 AND t <> 1)),
s AS (SELECT *, clock - lag(clock) OVER (PARTITION BY stream_id, pid, epoch ORDER BY arrival_idx) AS moved FROM d WHERE q IN (0, 1)),
m AS (SELECT *, coalesce((moved + {_CLOCK + _CLOCK // 2}) % {_CLOCK} - {_CLOCK // 2}, 0) AS step FROM s)
SELECT stream_id, arrival_idx, CAST(pid AS BIGINT) AS pid, CAST(clock AS BIGINT) AS pcr, CAST(epoch AS BIGINT) AS epoch, CAST(sum(step) OVER (PARTITION BY stream_id, pid, epoch ORDER BY arrival_idx) AS BIGINT) AS elapsed FROM m""")
def program_clocks(spark, sf_dir):
    """The clock of each program, begun anew where it says that it is discontinuous."""
    return transport.clock_lines(_adapted(spark, sf_dir))


#: The bound of the query's units, small enough for its packets to exceed.
_MOST = 40


@add(33, 199, 200, sql=WITH + f""", x AS (SELECT stream_id, arrival_idx, event_id AS e, pts, event_id % 6 = 0 AS starts, 256 + event_id % 4 // 2 AS pid, CASE WHEN event_id % 6 = 0 THEN 18 ELSE 8 END AS n FROM packets WHERE NOT (event_id % 6 = 0 AND (event_id % 7 = 0 OR event_id % 11 = 0))),
u AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, pid ORDER BY arrival_idx) AS unit FROM x),
c AS (SELECT *, first_value(CASE e % 5 WHEN 1 THEN 34 WHEN 2 THEN 21 WHEN 3 THEN 18 WHEN 4 THEN 206 END) OVER w AS announced, sum(n) OVER w AS come FROM u WHERE unit > 0 WINDOW w AS (PARTITION BY stream_id, pid, unit ORDER BY arrival_idx)),
o AS (SELECT *, coalesce(bool_or(coalesce(come >= announced, false) OR come > {_MOST} OR coalesce(announced > {_MOST}, false)) OVER (PARTITION BY stream_id, pid, unit ORDER BY arrival_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM c),
b AS (SELECT *, least(n, coalesce(announced - (come - n), n)) AS room FROM o WHERE NOT over),
g AS (SELECT stream_id, pid, unit, min(arrival_idx) AS arrival_idx, count(*) AS packets, max(announced) AS announced, max(come) AS bytes, max(CASE WHEN starts THEN pts END) AS pts,
 string_agg(CASE WHEN starts THEN substr(printf('%08X', e), 1, CAST(2 * greatest(room - 14, 0) AS BIGINT)) ELSE substr(printf('%016X', e), 1, CAST(2 * room AS BIGINT)) END, '' ORDER BY arrival_idx) AS payload FROM b GROUP BY stream_id, pid, unit)
SELECT stream_id, CAST(pid AS BIGINT) AS pid, CAST(unit AS BIGINT) AS unit, arrival_idx, packets, CAST(announced AS BIGINT) AS announced, CAST(bytes AS BIGINT) AS bytes, CAST(pts AS BIGINT) AS pts, CAST(pts AS BIGINT) AS dts, payload,
 CASE WHEN bytes > {_MOST} OR coalesce(announced > {_MOST}, false) THEN 'oversize' WHEN bytes > announced THEN 'overrun' WHEN bytes = announced THEN 'complete' WHEN lead(unit) OVER (PARTITION BY stream_id, pid ORDER BY unit) IS NULL THEN 'open' WHEN announced IS NULL THEN 'complete' ELSE 'incomplete' END AS status FROM g""")
def pes_units(spark, sf_dir):
    """Elementary packets from transport packets: with and without a length, cut off, overrun, too large, with damaged starts."""
    e = F.col("event_id")
    starts, pid = e % 6 == 0, (F.lit(256) + F.floor(e % 4 / 2)).cast("long")
    length = F.when(e % 5 == 1, 28).when(e % 5 == 2, 15).when(e % 5 == 3, 12).when(e % 5 == 4, 200).otherwise(0)
    code = F.when(e % 7 == 0, "000002E0").otherwise("000001E0")
    begun = F.concat(code, hexed(length.cast("long"), 4), F.lit("808005"), F.hex(wire.timestamp_bytes(F.col("pts"), 2)), hexed(e, 8))
    payload = F.when(starts, F.when(e % 11 == 0, F.substring(begun, 1, 8)).otherwise(begun)).otherwise(hexed(e, 16))
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", _packet(pid, starts, None, payload).alias("ts"))
    return transport.pes_units(rows, _MOST).withColumn("payload", F.hex("payload"))


_G = """(SELECT *, CASE WHEN n1 > 0 THEN ((seq - last + 32768) % 65536 + 65536) % 65536 - 32768 ELSE 1 END AS gap FROM
 (SELECT f.*, p.unit + CASE WHEN f.starts THEN 1 ELSE 0 END AS unit1, CASE WHEN f.starts THEN 0 ELSE p.n END AS n1, CASE WHEN f.starts THEN 0 ELSE p.held END AS bytes1, CASE WHEN f.starts THEN f.clock ELSE p.began END AS began1, p.last FROM r p JOIN f ON f.stream_id = p.stream_id AND f.arrival_idx = p.arrival_idx + 1) a)"""


@add(202, sql=WITH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", f AS (SELECT stream_id, arrival_idx, CASE WHEN event_id % 13 = 0 THEN (seq + 65535) % 65536 WHEN event_id % 29 = 0 THEN (seq + 9) % 65536 ELSE seq END AS seq, capture_us + 2000000 * (event_id % 5) AS clock, CASE WHEN event_id % 31 = 0 THEN 20000000 ELSE size * 30 END AS bytes, event_id % 6 IN (0, 3) AS starts, event_id % 6 = 5 AS ends FROM packets),
r AS (SELECT stream_id, CAST(0 AS BIGINT) AS arrival_idx, 0 AS unit, CAST(NULL AS INT) AS n, CAST(0 AS HUGEINT) AS held, 0 AS last, CAST(0 AS BIGINT) AS began, 0 AS fragments, CAST('' AS VARCHAR) AS problem, false AS complete FROM f WHERE arrival_idx = 1
 UNION ALL SELECT stream_id, arrival_idx, unit1, CASE WHEN refused IS NOT NULL THEN n1 WHEN given_up IS NOT NULL OR ends THEN NULL ELSE n1 + 1 END, CASE WHEN refused IS NULL THEN bytes1 + bytes ELSE bytes1 END, CASE WHEN refused IS NULL THEN seq ELSE last END, began1, CASE WHEN refused IS NULL THEN n1 + 1 ELSE coalesce(n1, 0) END, coalesce(refused, given_up), refused IS NULL AND given_up IS NULL AND ends
 FROM (SELECT *, CASE WHEN refused IS NULL THEN CASE WHEN clock - began1 > 5000000 THEN 'age' WHEN n1 + 1 > 3 THEN 'count' WHEN bytes1 + bytes > 900000 THEN 'unit size' END END AS given_up FROM
 (SELECT *, CASE WHEN bytes > 10485760 THEN 'fragment size' WHEN n1 IS NULL OR n1 = 0 AND NOT starts THEN 'no start' WHEN gap = 0 THEN 'repeat' WHEN gap < 0 THEN 'order' WHEN gap > 5 THEN 'gap' END AS refused FROM {_G} b) c) d)
SELECT stream_id, arrival_idx, CAST(unit AS BIGINT) AS unit, CAST(fragments AS BIGINT) AS fragments, problem, complete FROM r WHERE arrival_idx > 0""")
def guarded_fragments(spark, sf_dir):
    """Fragments under the guard, each of whose rules refuses some: here at most three and 900,000 bytes a unit."""
    e = F.col("event_id")
    seq = F.when(e % 13 == 0, F.pmod(F.col("seq") - 1, F.lit(65536))).when(e % 29 == 0, F.pmod(F.col("seq") + 9, F.lit(65536))).otherwise(F.col("seq"))
    rows = packets(spark, sf_dir).select("stream_id", "arrival_idx", seq.alias("seq"), (F.col("capture_us") + 2_000_000 * (e % 5)).alias("capture_us"), F.when(e % 31 == 0, 20_000_000).otherwise(F.col("size") * 30).cast("long").alias("bytes"), (e % 6).isin(0, 3).alias("starts"), (e % 6 == 5).alias("ends"))
    return transport.guarded_fragments(rows, most=3, most_unit=900_000).select("stream_id", "arrival_idx", "unit", "fragments", "problem", "complete")
