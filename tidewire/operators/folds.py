"""Ordered folds: state machines over the rows of a key, where a row's outcome depends on the state
that earlier rows left and windows cannot express it.

Rows are dealt by key, sorted, and streamed through the state; a task holds one batch and one
state, however many rows a key has.
"""

from __future__ import annotations

import heapq

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewire.sources.session import shipped


def ordered_fold(rows: DataFrame, key: str, order: list[str], needs: list[str], start: Callable[[], Any], step: Callable[..., tuple], adds: T.StructType) -> DataFrame:
    """Adds the columns ``adds``: for each row of a key, in order, what ``step(state, *values of needs)`` returns;
    ``start()`` makes the state of a new key, which ``step`` changes in place. Batches pass by columns, and only the
    columns named are read in Python."""
    shipped(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, *adds.fields])
    added = to_arrow_schema(adds)
    at = [rows.columns.index(c) for c in [key, *needs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            out = []
            for k, *values in zip(*(b.column(i).to_pylist() for i in at)):
                if k != now or state is None:
                    now, state = k, start()
                out.append(step(state, *values))
            more = [pa.array(x, f.type) for x, f in zip(zip(*out), added)] if out else [pa.array([], f.type) for f in added]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *added.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def token_bucket(rows: DataFrame, rate: int, key: str = "stream_id", at: str = "capture_us", size: str = "size", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds allowed and tokens: a bucket of one second's bytes, refilled by time, at least a
    millisecond at once."""
    most = max(rate, 1024)

    def step(s: dict, now: int, n: int) -> tuple:
        if s["at"] is None:
            s["at"] = now
        new = (now - s["at"]) * rate // 1_000_000
        if now - s["at"] >= 1000 and new > 0:
            s["tokens"], s["at"] = min(most, s["tokens"] + new), now
        allowed = n <= s["tokens"]
        if allowed:
            s["tokens"] -= n
        return allowed, s["tokens"]

    return ordered_fold(rows, key, list(order), [at, size], lambda: {"tokens": most, "at": None}, step, _fields(allowed=T.BooleanType(), tokens=T.LongType()))


def circuit_breaker(rows: DataFrame, failed: str, threshold: int, timeout_us: int, key: str = "stream_id", at: str = "capture_us", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds allowed and state: closed, open after so many failures, half-open (one probe) after a
    pause."""
    def step(s: dict, now: int, bad: bool) -> tuple:
        if s["state"] == "open":
            allowed = now - s["last"] > timeout_us
            if allowed:
                s["state"], s["used"] = "half-open", True
        elif s["state"] == "half-open":
            allowed, s["used"] = not s["used"], True
        else:
            allowed = True
        if allowed and bad:
            s["failures"], s["last"] = s["failures"] + 1, now
            if s["failures"] >= threshold:
                s["state"] = "open"
        elif allowed:
            s.update(failures=0, state="closed", used=False)
        return allowed, s["state"]

    return ordered_fold(rows, key, list(order), [at, failed], lambda: {"state": "closed", "failures": 0, "last": 0, "used": False}, step, _fields(allowed=T.BooleanType(), state=T.StringType()))


def rate_controller(rows: DataFrame, least: int, most: int, target: float = 0.7, up: float = 1.2, down: float = 0.8, history: int = 10, key: str = "stream_id", order: tuple[str, ...] = ("tick",)) -> DataFrame:
    """Adds smoothed and rate for a column pressure: raised below 90 % of the target, cut above
    110 %, nudged in between; quick changes of pressure count more than its weighted mean."""
    def step(s: dict, pressure: float) -> tuple:
        seen = s["seen"]
        seen.append(pressure)
        del seen[:-history]
        weights = range(1, len(seen) + 1)
        smooth = sum(w * p for w, p in zip(weights, seen)) / sum(weights)
        gap = pressure - smooth
        p = pressure * 0.7 + smooth * 0.3 if abs(gap) > 0.1 else smooth
        if p < target * 0.9:
            factor = up * (1.5 if p < target * 0.5 else 1.0)
        elif p > target * 1.1:
            factor = down * (0.5 if p > 0.9 else 0.7 if p > 0.8 else 1.0)
        else:
            factor = 1.0 + (target - p) * 0.1
        s["rate"] = min(most, max(least, int(s["rate"] * factor)))
        return smooth, s["rate"]

    return ordered_fold(rows, key, list(order), ["pressure"], lambda: {"seen": [], "rate": most}, step, _fields(smoothed=T.DoubleType(), rate=T.LongType()))


def quality_ladder(rows: DataFrame, bitrates: tuple[int, ...], key: str = "stream_id", order: tuple[str, ...] = ("win",)) -> DataFrame:
    """Adds profile for columns score, cpu, memory, bandwidth: one step up when all is well and the
    bandwidth has a fifth to spare, one down when strained, two in an emergency."""
    last = len(bitrates) - 1

    def step(s: dict, score: float, cpu: float, memory: float, bandwidth: float) -> tuple:
        now, busy = s["profile"], max(cpu, memory)
        if score > 0.8 and busy < 0.6:
            if now > 0 and bandwidth > bitrates[now - 1] * 120 // 100:
                now -= 1
        elif score < 0.3 or busy > 0.95:
            now = min(last, now + 2)
        elif score < 0.5 or busy > 0.85:
            now = min(last, now + 1)
        s["profile"] = now
        return (now,)

    return ordered_fold(rows, key, list(order), ["score", "cpu", "memory", "bandwidth"], lambda: {"profile": 1}, step, _fields(profile=T.IntegerType()))


def connection_limit(rows: DataFrame, most: int, key: str = "stream_id", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds admitted and held for a column opens: an opening is admitted below the limit, anything
    else closes one."""
    def step(s: dict, opens: bool) -> tuple:
        ok = None
        if opens:
            ok = s["held"] < most
            s["held"] += ok
        else:
            s["held"] = max(0, s["held"] - 1)
        return ok, s["held"]

    return ordered_fold(rows, key, list(order), ["opens"], lambda: {"held": 0}, step, _fields(admitted=T.BooleanType(), held=T.LongType()))


#: Times have 33 bits; ticks of 90 kHz of the largest step that is taken for one, and of the largest lead of PTS.
TOP, MOST_STEP, MOST_LEAD = (1 << 33) - 1, 900_000, 90_000


def checked_timestamps(rows: DataFrame, key: str = "stream_id", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds problem, warnings, pts_wraps and dts_wraps for columns pts and dts (0: absent). A row out of range, with pts
    before dts, or with a dts a little behind the last one is rejected; the last does not undo the count of a pts wrap.
    Warnings: lead (pts more than a second ahead of dts), wrap, jump (pts more than ten seconds on), behind (pts a little
    back), dts wrap."""
    def step(s: dict, pts: int, dts: int) -> tuple:
        said: list[str] = []
        if not (0 <= pts <= TOP and 0 <= dts <= TOP):
            problem = "range"
        elif dts and pts < dts:
            problem = "order"
        else:
            problem = None
            if dts and pts - dts > MOST_LEAD:
                said.append("lead")
            if s["pts"] is not None:
                moved = pts - s["pts"]
                if moved < -(TOP // 2):
                    s["pts_wraps"] += 1
                    said.append("wrap")
                elif moved > MOST_STEP:
                    said.append("jump")
                elif -MOST_STEP < moved < 0:
                    said.append("behind")
                back = s["dts"] - dts if dts and s["dts"] else 0
                if back > TOP // 2:
                    s["dts_wraps"] += 1
                    said.append("dts wrap")
                elif 0 < back < MOST_STEP:
                    problem = "back"
            if problem is None:
                s["pts"], s["dts"] = pts, dts
        return problem, said, s["pts_wraps"], s["dts_wraps"]

    adds = _fields(problem=T.StringType(), warnings=T.ArrayType(T.StringType()), pts_wraps=T.LongType(), dts_wraps=T.LongType())
    return ordered_fold(rows, key, list(order), ["pts", "dts"], lambda: {"pts": None, "dts": None, "pts_wraps": 0, "dts_wraps": 0}, step, adds)


def alert_deduplication(rows: DataFrame, pause_us: int, key: str = "alert", at: str = "capture_us", order: tuple[str, ...] = ("capture_us", "arrival_idx")) -> DataFrame:
    """Adds sent: an alert is repeated only when its last sending is longer ago than the pause."""
    def step(s: dict, now: int) -> tuple:
        new = s["at"] is None or now - s["at"] > pause_us
        if new:
            s["at"] = now
        return (new,)

    return ordered_fold(rows, key, list(order), [at], lambda: {"at": None}, step, _fields(sent=T.BooleanType()))


def alerts_with_cooldown(rows: DataFrame, pause_us: int = 300_000_000, key: str = "stream_id", at: str = "capture_us", order: tuple[str, ...] = ("capture_us", "event_id")) -> DataFrame:
    """Adds alert (raised, resolved, or null) and active for a column breach: an alert is raised at a breach if there was none yet or
    the last one was resolved longer ago than the pause, at whatever row of the breach that is; it is resolved at the first
    row without one."""
    def step(s: dict, now: int, breach: bool) -> tuple:
        said = None
        if breach and not s["active"] and (s["resolved"] is None or now - s["resolved"] > pause_us):
            s["active"], said = True, "raised"
        elif not breach and s["active"]:
            s.update(active=False, resolved=now)
            said = "resolved"
        return said, s["active"]

    return ordered_fold(rows, key, list(order), [at, "breach"], lambda: {"active": False, "resolved": None}, step, _fields(alert=T.StringType(), active=T.BooleanType()))


def checked_packets(rows: DataFrame, most_gap: int = 100, most_jump: int = 60 * 90_000, key: str = "stream_id", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds problem for columns seq and rtp_ts: a sequence gap or a time jump beyond its limit
    rejects the row and leaves the state as it was."""
    def step(s: dict, seq: int, ts: int) -> tuple:
        if s["seq"] is not None:
            gap = (seq - s["seq"] + 32768) % 65536 - 32768
            jump = (ts - s["ts"] + (1 << 31)) % (1 << 32) - (1 << 31)
            if abs(gap) > most_gap:
                return ("gap",)
            if abs(jump) > most_jump:
                return ("jump",)
        s["seq"], s["ts"] = seq, ts
        return (None,)

    return ordered_fold(rows, key, list(order), ["seq", "rtp_ts"], lambda: {"seq": None, "ts": None}, step, _fields(problem=T.StringType()))


#: Payload types of a source, its sequence gap and time jump at most, times that the frame duration is read from, the
#: range of such a duration and the one until it is known, frames that a B frame may lie back, packets until order counts.
PAYLOAD_TYPES, MOST_SEQ_GAP, MOST_TIME_JUMP = range(96, 128), 100, 60 * 90_000
TIMES, LEAST_FRAME, MOST_FRAME, FRAME, FRAMES_BACK, SETTLED = 10, 750, 9000, 3000, 5, 3


def _frame_duration(times: list[int]) -> int:
    """The commonest step between times, the shortest of equals."""
    steps: dict[int, int] = {}
    for a, b in zip(times, times[1:]):
        if LEAST_FRAME <= b - a <= MOST_FRAME:
            steps[b - a] = steps.get(b - a, 0) + 1
    return min(steps, key=lambda d: (-steps[d], d), default=FRAME)


def validated_source(rows: DataFrame, key: str = "stream_id", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds problem, duration (of a frame, as the times so far tell) and back (whether the time lies behind the highest) for columns
    version, payload_type, padding (its length as the last byte tells; null without), bytes, seq and rtp_ts. Structure comes
    first: version, payload type, padding of no or more bytes than the packet has, bytes (12 to 65,536). Then the state of the source: a
    number too far from the last one taken; a time too far ahead of the highest, or more than five frames behind it, which
    is as far as a B frame may lie. A packet that is refused leaves number and highest time as they were; its time still counts for
    the duration, unless its number was refused. A time behind a wrap begins anew."""
    def step(s: dict, version: int, kind: int, padding: int | None, size: int, seq: int, ts: int) -> tuple:
        wrong = "version" if version != 2 else "payload type" if kind not in PAYLOAD_TYPES else "padding" if padding is not None and not 0 < padding <= size else "bytes" if not 12 <= size <= 65_536 else None
        if wrong:
            return wrong, s["duration"], False
        if s["seq"] is None:
            s.update(seq=seq, ts=ts, high=ts, n=1, times=[ts])
            return None, s["duration"], False
        if abs((seq - s["seq"] + 32768) % 65536 - 32768) > MOST_SEQ_GAP:
            return "gap", s["duration"], False
        if s["ts"] > 0xF0000000 and ts < 0x10000000:
            s["high"] = ts
        s["times"] = [*s["times"], ts][-TIMES:]
        s["duration"] = _frame_duration(s["times"])
        back = ts < s["high"]
        if s["n"] < SETTLED:
            if ts - s["ts"] > MOST_TIME_JUMP and s["ts"] > 0:
                return "jump", s["duration"], back
        elif ts - s["high"] > MOST_TIME_JUMP or s["high"] - ts > FRAMES_BACK * s["duration"]:
            return "jump", s["duration"], back
        s.update(seq=seq, ts=ts, high=max(s["high"], ts), n=s["n"] + 1)
        return None, s["duration"], back

    adds = _fields(problem=T.StringType(), duration=T.LongType(), back=T.BooleanType())
    needs = ["version", "payload_type", "padding", "bytes", "seq", "rtp_ts"]
    return ordered_fold(rows, key, list(order), needs, lambda: {"seq": None, "ts": 0, "high": 0, "n": 0, "times": [], "duration": FRAME}, step, adds)


class _Reorderer:
    """One stream's frames (dts, number, pts, kind, capture time, event) on their way from arrival to decode order."""

    def __init__(self, depth: int, wait_us: int):
        self.depth, self.wait = depth, wait_us
        self.held: list[tuple] = []
        self.count = 0
        self.dts = self.pts = None  # of the last frame released; pts of the last one that is not a B frame

    def _due(self, now: int) -> bool:
        """Whether the frame with the least dts may go."""
        dts, _, _, kind, seen, _ = self.held[0]
        n = len(self.held)
        if n >= self.depth or kind == "IDR" or now - seen > self.wait or kind == "I" and n > 1:
            return True
        if kind != "P" or n < 2:
            return False
        after = min(self.held[1:3])  # a heap: the second least is a child of the least
        return n >= (self.depth + 1) // 2 or after[3] in ("I", "P") and after[0] - dts > MOST_GAP

    def _fits(self, frame: tuple) -> bool:
        """Whether a frame keeps the order of those released. A long way back is a wrap or a new time base."""
        dts, _, pts, kind, _, _ = frame
        if self.pts is None:
            return True
        back = self.dts - dts if dts < self.dts else self.pts - pts if kind != "B" else 0
        return back <= 0 or back > MOST_STEP

    def _released(self) -> tuple | None:
        frame = heapq.heappop(self.held)
        if not self._fits(frame):
            return None
        self.dts = frame[0]
        if frame[3] != "B":
            self.pts = frame[2]
        return frame[5], frame[0]

    def add(self, pts: int, dts: int, kind: str, now: int, event: int) -> Iterator[tuple]:
        heapq.heappush(self.held, (dts or pts, self.count, pts, kind, now, event))  # without a dts it is the pts
        self.count += 1
        while self.held and self._due(now):
            if (out := self._released()) is not None:
                yield out

    def rest(self) -> Iterator[tuple]:
        while self.held:
            if (out := self._released()) is not None:
                yield out


#: Fixed value: ticks between a P frame and the next I or P frame beyond which no B frames are waited for.
MOST_GAP = 10_000


def reordered(rows: DataFrame, depth: int = 3, wait_us: int = 200_000, key: str = "stream_id") -> DataFrame:
    """stream_id, event_id, dts, out: frames as a buffer of so many frames releases them by decode time. The least frame
    goes when the buffer is full, when it has waited too long (by the capture time of the newest frame), when it is an IDR
    frame, an I frame with another behind it, or a P frame with half a buffer or a long gap behind it. A frame behind those
    released is dropped, unless it is so far behind that the times have wrapped or begun anew. At the end of a stream the
    rest goes. The state is the buffer."""
    shipped(rows.sparkSession)
    needs = [key, "pts", "dts", "frame_type", "capture_us", "event_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, _Reorderer(depth, wait_us), 0
        for b in batches:
            out: list[tuple] = []

            def put(found: Iterator[tuple]) -> None:
                nonlocal n
                for event, dts in found:
                    out.append((now, event, dts, n))
                    n += 1

            for k, *frame in zip(*(x.to_pylist() for x in b.columns)):
                if k != now:
                    put(state.rest())
                    now, state, n = k, _Reorderer(depth, wait_us), 0
                put(state.add(*frame))
            yield batch(out)
        yield batch([(now, event, dts, n + i) for i, (event, dts) in enumerate(state.rest())])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], [key, "event_id", "dts", "out"])

    ordered = rows.repartition(key).sortWithinPartitions(key, "arrival_idx").select(*needs)
    return ordered.mapInArrow(run, f"{key} long, event_id long, dts long, out long")


def memory_limit(rows: DataFrame, most: int, key: str = "stream_id", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds granted and used for a column change: what would go over the limit is refused, what is
    given back always counts."""
    def step(s: dict, change: int) -> tuple:
        ok = change <= 0 or s["used"] + change <= most
        if ok:
            s["used"] = max(0, s["used"] + change)
        return ok, s["used"]

    return ordered_fold(rows, key, list(order), ["change"], lambda: {"used": 0}, step, _fields(granted=T.BooleanType(), used=T.LongType()))


def cached(rows: DataFrame, most: int, ttl_us: int, key: str = "stream_id", order: tuple[str, ...] = ("arrival_idx",)) -> DataFrame:
    """Adds hit for columns entry and capture_us: a cache of so many entries, the least recently used
    of which goes first, and of which none lives longer than its time."""
    def step(s: dict, entry: int, now: int) -> tuple:
        held = s["held"]
        born = held.pop(entry, None)
        hit = born is not None and now - born <= ttl_us
        held[entry] = born if hit else now
        if len(held) > most:
            del held[next(iter(held))]
        return (hit,)

    return ordered_fold(rows, key, list(order), ["entry", "capture_us"], lambda: {"held": {}}, step, _fields(hit=T.BooleanType()))


def drift_corrected(samples: DataFrame, limit_us: int = 40_000, share: float = 0.1, most_us: int = 5_000, pause_us: int = 100_000, last: int = 100) -> DataFrame:
    """Adds offset_us and corrections for drift samples: once ten samples are there, and not more
    often than the pause, a tenth of the mean drift, at most a step, moves the audio offset; later
    samples see it."""
    def step(s: dict, now: int, measured: int) -> tuple:
        drift = measured - s["offset"]
        seen = s["seen"]
        seen.append(drift)
        del seen[:-last]
        if abs(drift) > limit_us and len(seen) >= 10 and (s["at"] is None or now - s["at"] > pause_us):
            mean = int(sum(seen) / len(seen))
            if abs(mean) >= limit_us // 2:
                move = max(-most_us, min(most_us, int(mean * share)))
                s["offset"], s["at"], s["n"] = s["offset"] - move, now, s["n"] + 1
        return s["offset"], s["n"]

    return ordered_fold(samples, "stream_id", ["capture_us", "event_id"], ["capture_us", "drift_us"], lambda: {"offset": 0, "seen": [], "at": None, "n": 0}, step, _fields(offset_us=T.LongType(), corrections=T.LongType()))


#: Bytes of a transport packet, and the byte that begins one.
PACKET, SYNC = 188, 0x47


def _synchronised(data: bytes, at: int) -> int:
    """Where the first packet from ``at`` on begins: a sync byte with another one a packet further on, or too near the end for that; -1
    if there is none."""
    at = data.find(SYNC, at)
    while at >= 0 and at + PACKET < len(data) and data[at + PACKET] != SYNC:
        at = data.find(SYNC, at + 1)
    return at


def cut_packets(data: bytes) -> tuple[list[bytes], bytes]:
    """The packets in some bytes, each of which begins with a sync byte, and what is left: less than a packet."""
    out, at = [], 0
    while len(data) - at >= PACKET:
        if data[at] == SYNC:
            out.append(data[at : at + PACKET])
            at += PACKET
        elif (found := _synchronised(data, at)) >= 0:
            at = found
        else:
            at = len(data) - PACKET + 1
    return out, data[at:]


def aligned(chunks: DataFrame, key: str = "stream_id", order: str = "arrival_idx") -> DataFrame:
    """stream_id, n and packet: the packets in each stream's chunks (a column chunk), whatever the places at which these were
    cut. Less than a packet is carried on to the next chunk; what stands before a sync byte, also between packets, is dropped."""
    shipped(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, b"", 0
        for b in batches:
            keys, numbers, packets = [], [], []
            for k, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    now, held, n = k, b"", 0
                found, held = cut_packets(held + (chunk or b""))
                for packet in found:
                    keys.append(k), numbers.append(n), packets.append(packet)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(packets, pa.binary())], [key, "n", "packet"])

    ordered = chunks.repartition(key).sortWithinPartitions(key, order).select(key, "chunk")
    return ordered.mapInArrow(run, f"{key} long, n long, packet binary")
