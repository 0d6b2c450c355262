"""Keyed machines with clocks: they take the rows of a key in order of time, and act by themselves when a time has come. The same
machine runs over a table here and over a stream in ``streaming.keyed``.

A machine has ``take`` (a row's values; the time comes first), ``advance`` (what happens by itself up to a time), ``due`` (the next such
time, None if there is none), and its state as numbers, by ``dump`` and ``load``. ``take`` and ``advance`` give outcomes: (time, event, a
number whose meaning ``NAMES`` has).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.sources.session import shipped

Outcome = tuple[int, int, int]
#: What ``applied`` returns, beside the key.
OUTCOMES = "decided_us long, event_id long, outcome long"


class JitterBuffer:
    """Packets (time, event, sequence number, timestamp) held until their turn and time: the first one's time and timestamp set the base,
    a packet's time is the base, the difference of the timestamps and the delay. The packet with the lowest number, unwrapped, goes
    first and holds back those behind it. A packet is dropped if one with its number is in the buffer (repeat), if the buffer is
    full and it is the lowest (overflow), or if it goes out later than its time and the delay once more (late)."""

    NEEDS = ("seq", "rtp_ts")
    NAMES = ("delivered", "late", "overflow", "repeat")

    def __init__(self, most: int = 64, delay_us: int = 50_000, clock: int = 90_000):
        self.most, self.delay, self.clock = most, delay_us, clock
        self.base: tuple[int, int] | None = None
        self.last: tuple[int, int] | None = None  # number as it came and unwrapped
        self.held: list[tuple[int, int, int]] = []  # a heap of (unwrapped number, time to go, event)

    def _out(self, now: int) -> Outcome:
        _, at, event = heapq.heappop(self.held)
        return now, event, int(now - at > self.delay)

    def due(self) -> int | None:
        return self.held[0][1] if self.held else None

    def advance(self, now: int) -> Iterator[Outcome]:
        at = None
        while self.held and self.held[0][1] <= now:
            at = max(self.held[0][1], self.held[0][1] if at is None else at)
            yield self._out(at)

    def take(self, now: int, event: int, seq: int, ts: int) -> Iterator[Outcome]:
        if self.base is None:
            self.base = now, ts
        unwrapped = seq if self.last is None else self.last[1] + (seq - self.last[0] + 32768) % 65536 - 32768
        self.last = seq, unwrapped
        if any(u == unwrapped for u, _, _ in self.held):
            yield now, event, 3
            return
        if len(self.held) >= self.most:
            yield now, heapq.heappop(self.held)[2], 2
        moved = (ts - self.base[1] + (1 << 31)) % (1 << 32) - (1 << 31)
        heapq.heappush(self.held, (unwrapped, self.base[0] + moved * 1_000_000 // self.clock + self.delay, event))
        while self.held and self.held[0][1] <= now:
            yield self._out(now)

    def dump(self) -> tuple[list[int], list[list[int]]]:
        return [*(self.base or ()), *(self.last or ())], [list(h) for h in self.held]

    def load(self, numbers: list[int], held: list[list[int]]) -> None:
        self.base, self.last = tuple(numbers[:2]), tuple(numbers[2:])
        self.held = [tuple(h) for h in held]
        heapq.heapify(self.held)


#: Lost packets from which a gap counts as a loss; the kinds of rows that ``Recovery`` takes.
LEAST_GAP = 5
KEYFRAME, PACKET_LOSS, CORRUPTION, TIMEOUT, GAP, JUMP, CODEC = range(7)


class Recovery:
    """The states of a stream over its errors and key frames (time, event, kind, size, closed, clean). A loss (or a gap of five packets
    and more) and corruption begin a recovery, which ends at once if a closed group (after corruption: a clean key frame) is buffered;
    a timeout, a time jump and a codec error begin a resynchronisation. Otherwise a key frame is asked for: one that is newer than
    the request ends the wait, none in time fails the stream. An error during a recovery asks again, or fails the
    stream when the recovery began too long ago. The outcome is the state entered; the event of a wait that ran out is -1."""

    NEEDS = ("kind", "amount", "closed", "clean")
    NAMES = ("normal", "recovering", "resyncing", "failed")
    NORMAL, RECOVERING, RESYNCING, FAILED = range(4)

    def __init__(self, wait_us: int = 5_000_000, most_us: int = 30_000_000):
        self.wait, self.most = wait_us, most_us
        self.state, self.began, self.asked = self.NORMAL, -1, -1  # asked: since when a key frame is waited for

    def _to(self, state: int, now: int, event: int) -> Iterator[Outcome]:
        if state != self.state:
            self.state = state
            if state in (self.RECOVERING, self.RESYNCING):
                self.began = now
            yield now, event, state

    def due(self) -> int | None:
        return self.asked + self.wait if self.asked >= 0 else None

    def advance(self, now: int) -> Iterator[Outcome]:
        if self.asked >= 0 and self.asked + self.wait <= now:
            at, self.asked = self.asked + self.wait, -1
            yield from self._to(self.FAILED, at, -1)

    def take(self, now: int, event: int, kind: int, amount: int, closed: bool, clean: bool) -> Iterator[Outcome]:
        if kind == KEYFRAME:
            if 0 <= self.asked < now:
                self.asked = -1
                yield from self._to(self.NORMAL, now, event)
            return
        if self.state == self.RECOVERING:
            if now - self.began > self.most:
                yield from self._to(self.FAILED, now, event)
            else:
                self.asked = now
            return
        if kind == GAP and amount < LEAST_GAP:
            return
        if kind in (PACKET_LOSS, GAP, CORRUPTION):
            yield from self._to(self.RECOVERING, now, event)
            if clean if kind == CORRUPTION else closed:
                yield from self._to(self.NORMAL, now, event)
                return
        else:
            yield from self._to(self.RESYNCING, now, event)
        self.asked = now

    def dump(self) -> tuple[list[int], list[list[int]]]:
        return [self.state, self.began, self.asked], []

    def load(self, numbers: list[int], held: list[list[int]]) -> None:
        self.state, self.began, self.asked = numbers


def named(machine: type, outcome: Column) -> Column:
    return F.get(F.lit(list(machine.NAMES)), outcome.cast("int"))


def applied(rows: DataFrame, made: Callable[[], object], key: str = "stream_id", at: str = "capture_us", event: str = "event_id") -> DataFrame:
    """The key and the outcomes of a machine (``made()``, one a key) over all rows, in order of time and event. After the last row what is due
    still happens. Rows pass in batches; the state is that of one key."""
    shipped(rows.sparkSession)
    needs = [key, at, event, *made().NEEDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, out = None, None, []

        def put(found: Iterator[Outcome]) -> None:
            out.extend((now, *o) for o in found)

        def rest() -> None:
            while machine is not None and (due := machine.due()) is not None:
                put(machine.advance(due))

        def batch() -> pa.RecordBatch:
            made_ = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], [key, "decided_us", "event_id", "outcome"])
            out.clear()
            return made_

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if machine is None or k != now:
                    rest()
                    now, machine = k, made()
                put(machine.advance(row[0]))
                put(machine.take(*row))
            yield batch()
        rest()
        yield batch()

    ordered = rows.select(*needs).repartition(key).sortWithinPartitions(key, at, event)
    return ordered.mapInArrow(run, f"{key} long, {OUTCOMES}")
