"""Transport packets beyond their payload: adaptation fields and program clocks, and elementary packets put together from their bytes.

Packets have stream_id, arrival_idx and ts, their bytes in hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.parsing import bound, number, piece, size
from tidewire.functions.wire import timestamp

from .folds import ordered_fold

#: Bytes of a packet; the clock's ticks for one of the 33-bit base, and how far it counts.
PACKET, TICKS = 188, 300
CLOCK = (1 << 33) * TICKS
#: Stream ids whose packets have no optional header; bytes of an elementary packet at most, its fixed and optional headers.
BARE, MOST_BYTES, FIXED, OPTIONAL = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF), 192 << 10, 6, 9


def fields(h: Column) -> Column:
    """problem (length, sync, error, control; else null), pid, starts, counter, has_payload, discontinuity, pcr (in ticks of 27 MHz, null
    without one) and payload (null where there is none)."""
    flags, control = number(h, 1, 1), F.shiftright(number(h, 3, 1), 4).bitwiseAND(3)
    problem = F.when(F.coalesce(size(h), F.lit(0)) != PACKET, "length").when(number(h, 0, 1) != 0x47, "sync").when(flags >= 128, "error").when(control == 0, "control")
    adapted, paid = control >= 2, control % 2 == 1
    length = F.when(adapted, number(h, 4, 1)).otherwise(-1)  # the field's own length byte is not in it
    told = F.when(adapted & (length > 0), number(h, 5, 1)).otherwise(0)
    clock = (told.bitwiseAND(0x10) != 0) & (length >= 7)
    tail = number(h, 10, 1)
    pcr = F.when(clock, (number(h, 6, 4) * 2 + F.shiftright(tail, 7)) * TICKS + tail.bitwiseAND(1) * 256 + number(h, 11, 1))
    start = F.lit(5) + length
    payload = F.when(paid & (start < PACKET), piece(h, start, F.lit(PACKET)))
    fine = problem.isNull()
    return F.struct(problem.alias("problem"), number(h, 1, 2).bitwiseAND(0x1FFF).alias("pid"), F.when(fine, flags.bitwiseAND(0x40) != 0).alias("starts"), F.when(fine, number(h, 3, 1).bitwiseAND(15)).alias("counter"), F.when(fine, paid).alias("has_payload"), F.when(fine, told >= 128).alias("discontinuity"), F.when(fine, pcr).alias("pcr"), F.when(fine, payload).alias("payload"))


def clock_lines(packets: DataFrame) -> DataFrame:
    """stream_id, arrival_idx, pid, pcr, epoch and elapsed (ticks since the first clock of the epoch) of each packet with a clock. An
    epoch begins with a packet that says that its clock is discontinuous; the clock wraps after 2^33 ticks of its base."""
    rows = packets.select("stream_id", "arrival_idx", bound(F.col("ts"), fields).alias("f")).filter("f.problem IS NULL").select("stream_id", "arrival_idx", "f.pid", "f.pcr", "f.discontinuity")
    by = Window.partitionBy("stream_id", "pid").orderBy("arrival_idx")
    rows = rows.withColumn("epoch", F.sum(F.col("discontinuity").cast("int")).over(by)).filter("pcr IS NOT NULL")
    inside = Window.partitionBy("stream_id", "pid", "epoch").orderBy("arrival_idx")
    moved = F.col("pcr") - F.lag("pcr").over(inside)
    step = F.pmod(moved + CLOCK // 2, F.lit(CLOCK)) - CLOCK // 2
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0)))
    return rows.select("stream_id", "arrival_idx", "pid", "pcr", "epoch", F.sum("step").over(inside).alias("elapsed"))


def pes_header(h: Column) -> Column:
    """problem (short, code, header; else null), announced (bytes with the fixed header, null if not told), body (where the data
    begins), pts and dts of a payload that begins an elementary packet. Without a dts it is the pts; a time with a wrong prefix or
    marker is null. A packet of which the optional header does not fit into the payload is damaged."""
    bare = number(h, 3, 1).isin(*BARE)
    length, more = number(h, 4, 2), number(h, 8, 1)
    problem = F.when(size(h) < OPTIONAL, "short").when(number(h, 0, 3) != 1, "code").when(~bare & (size(h) < OPTIONAL + more), "header")
    told = F.shiftright(number(h, 7, 1), 6).bitwiseAND(3)
    data = F.unhex(h)

    def time(at: int, prefix: Column, needed: int) -> Column:
        ok = ~bare & (more >= needed) & (F.shiftright(number(h, at, 1), 4) == prefix)
        return F.when(ok, timestamp(data, at))

    pts = F.when(told >= 2, time(9, told, 5))
    dts = F.when(told == 3, time(14, F.lit(1), 10)).when(told == 2, pts)
    return F.struct(problem.alias("problem"), F.when(length > 0, length + FIXED).alias("announced"), F.when(bare, FIXED).otherwise(OPTIONAL + more).alias("body"), F.when(problem.isNull(), pts).alias("pts"), F.when(problem.isNull(), dts).alias("dts"))


def pes_units(packets: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """stream_id, pid, unit, arrival_idx (of its first packet), packets, announced, bytes (with headers), pts, dts, status and payload
    (binary, without headers) of the elementary packets in transport packets. One that announces its length is complete when so
    many bytes have come, an overrun if the packet that fills it holds more; one that does not goes on to the next start. Status:
    complete, incomplete (a start came first), overrun, oversize (more than ``most`` bytes, announced or come), open (the stream
    ended first). Damaged starts hold nothing and change nothing; data behind a whole packet or before any start belongs
    to none."""
    rows = packets.select("stream_id", "arrival_idx", bound(F.col("ts"), fields).alias("f")).filter("f.payload IS NOT NULL").select("stream_id", "arrival_idx", "f.pid", "f.starts", "f.payload")
    rows = rows.withColumn("head", F.when(F.col("starts"), bound(F.col("payload"), pes_header))).filter("NOT starts OR head.problem IS NULL")
    by = Window.partitionBy("stream_id", "pid").orderBy("arrival_idx")
    rows = rows.withColumn("unit", F.sum(F.col("starts").cast("int")).over(by)).filter("unit > 0")
    inside = Window.partitionBy("stream_id", "pid", "unit").orderBy("arrival_idx")
    rows = rows.withColumn("announced", F.first("head.announced").over(inside)).withColumn("come", F.sum(size(F.col("payload"))).over(inside))
    rows = rows.withColumn("filled", F.coalesce(F.col("come") >= F.col("announced"), F.lit(False)) | (F.col("come") > most) | F.coalesce(F.col("announced") > most, F.lit(False)))
    rows = rows.withColumn("over", F.coalesce(F.max("filled").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).filter(~F.col("over"))
    # what the unit still takes of this packet, without headers: nothing behind the announced length
    before = F.col("come") - size(F.col("payload"))
    skip = F.when(F.col("starts"), F.col("head.body")).otherwise(0)
    room = F.when(F.col("announced").isNull(), size(F.col("payload"))).otherwise(F.least(size(F.col("payload")), F.col("announced") - before))
    rows = rows.withColumn("body", piece(F.col("payload"), skip, F.greatest(room - skip, F.lit(0))))
    # at most ``most`` bytes a unit and a packet more
    made = rows.groupBy("stream_id", "pid", "unit").agg(F.min("arrival_idx").alias("arrival_idx"), F.count(F.lit(1)).alias("packets"), F.max("announced").alias("announced"), F.max("come").alias("bytes"), F.max("head.pts").alias("pts"), F.max("head.dts").alias("dts"), F.array_sort(F.collect_list(F.struct("arrival_idx", "body"))).alias("parts"))
    last = F.lead("unit").over(Window.partitionBy("stream_id", "pid").orderBy("unit")).isNull()
    made = made.withColumn("last", last)
    status = (F.when((F.col("bytes") > most) | F.coalesce(F.col("announced") > most, F.lit(False)), "oversize").when(F.col("bytes") > F.col("announced"), "overrun").when(F.col("bytes") == F.col("announced"), "complete")
              .when(F.col("last"), "open").when(F.col("announced").isNull(), "complete").otherwise("incomplete"))
    payload = F.unhex(F.array_join(F.transform("parts", lambda p: p["body"]), ""))
    return made.select("stream_id", "pid", "unit", "arrival_idx", "packets", "announced", "bytes", "pts", "dts", status.alias("status"), payload.alias("payload"))


#: Limits of a unit that is put together from fragments: bytes of one and of all, number, sequence gap, age.
MOST_FRAGMENT, MOST_UNIT, MOST_FRAGMENTS, MOST_GAP, MOST_AGE_US = 10 << 20, 10 << 20, 1000, 5, 5_000_000


def guarded_fragments(fragments: DataFrame, most_fragment: int = MOST_FRAGMENT, most_unit: int = MOST_UNIT, most: int = MOST_FRAGMENTS, most_gap: int = MOST_GAP, most_age_us: int = MOST_AGE_US) -> DataFrame:
    """Adds unit, fragments (of the unit so far), problem and complete to fragments (seq, capture_us, bytes, starts, ends). A start
    begins a unit. A fragment that is too large, repeats the last one, comes before it, or is too far ahead is refused, and what is
    held stays as it is; the next one is judged by the last that was taken. A unit that gets too old, too long or too large is
    given up, with the fragment that made it so; fragments without a unit are refused until the next start."""
    def step(s: dict, seq: int, now: int, n: int, starts: bool, ends: bool) -> tuple:
        if starts:
            s.update(unit=s["unit"] + 1, n=0, bytes=0, began=now)
        problem = None
        gap = (seq - s["last"] + 32768) % 65536 - 32768 if s["n"] else 1
        if n > most_fragment:
            problem = "fragment size"
        elif s["n"] is None or not s["n"] and not starts:
            problem = "no start"
        elif gap == 0:
            problem = "repeat"
        elif gap < 0:
            problem = "order"
        elif gap > most_gap:
            problem = "gap"
        if problem:
            return s["unit"], s["n"] or 0, problem, False
        s.update(n=s["n"] + 1, bytes=s["bytes"] + n, last=seq)
        problem = "age" if now - s["began"] > most_age_us else "count" if s["n"] > most else "unit size" if s["bytes"] > most_unit else None
        held = s["n"]
        if problem or ends:
            s.update(n=None)
        return s["unit"], held, problem, problem is None and ends

    adds = T.StructType([T.StructField("unit", T.LongType()), T.StructField("fragments", T.LongType()), T.StructField("problem", T.StringType()), T.StructField("complete", T.BooleanType())])
    return ordered_fold(fragments, "stream_id", ["arrival_idx"], ["seq", "capture_us", "bytes", "starts", "ends"], lambda: {"unit": 0, "n": None, "bytes": 0, "last": 0, "began": 0}, step, adds)
