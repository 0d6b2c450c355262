"""Machines with clocks (``operators.machines``) over streams whose rows come out of order: rows wait in the state until the watermark
has passed them, are then taken in order of time, and timers wake machines whose time has come without a row. What is settled is
released, so the state is what waits for the watermark and what the machines hold.

A call of Python and a read of the state cost far more than a row, so the machines of ``1 << BLOCK_BITS`` neighbouring keys share one
state. Rows wait in slots of time: a batch reads and writes the slots that it touches, not all that waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.machines import OUTCOMES
from tidewire.sources.session import shipped

#: State with maps and timers needs this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that share a state: those that differ in so many of their last bits only.
BLOCK_BITS = 6


class Timed(StatefulProcessor):
    """``columns`` are those of a row: key, time, event and what the machine needs; all are whole numbers."""

    def __init__(self, made: Callable[[], object], columns: list[str], slot_us: int):
        self.made, self.columns, self.slot = made, columns, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint", "rows binary")
        self.machines = handle.getValueState("machines", "each array<struct<key bigint,numbers array<bigint>,held array<array<bigint>>>>")

    def _rows(self, slot: int) -> np.ndarray:
        return np.frombuffer(self.waiting.getValue((slot,))[0], np.int64).reshape(-1, len(self.columns))

    def _ready(self, fresh: list[np.ndarray], end: int) -> tuple[np.ndarray, int | None]:
        """The rows before ``end``, by key and time, and the time of a next one; the others wait."""
        slots = {k[0] for k in self.waiting.keys()} if self.waiting.exists() else set()
        due = [k for k in slots if k * self.slot < end]
        rows = np.concatenate([np.empty((0, len(self.columns)), np.int64), *fresh, *[self._rows(k) for k in due]])
        for k in due:
            self.waiting.removeKey((k,))
        slots.difference_update(due)
        passed = rows[:, 1] < end
        ready, left = rows[passed], rows[~passed]
        left = left[np.argsort(left[:, 1], kind="stable")]
        at = left[:, 1] // self.slot
        cuts = np.flatnonzero(np.diff(at)) + 1
        for k, part in zip(at[np.r_[0, cuts]].tolist(), np.split(left, cuts)) if len(left) else ():
            if k in slots:
                part = np.concatenate([self._rows(k), part])
            self.waiting.updateValue((k,), (part.tobytes(),))
        times = [k * self.slot for k in slots] + left[:1, 1].tolist()
        return ready[np.lexsort(ready.T[::-1])], min(times, default=None)

    def _settled(self, fresh: list[np.ndarray], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Takes what lies before the watermark, keeps the rest, and sets the timer for what comes next."""
        end, machines, out = watermark_ms * 1000, {}, []
        for key, numbers, held in self.machines.get()[0] if self.machines.exists() else ():
            machines[key] = self.made()
            machines[key].load(list(numbers), [list(h) for h in held])
        ready, following = self._ready(fresh, end)
        for key, rows in groupby(ready.tolist(), lambda r: r[0]):
            machine = machines.get(key) or machines.setdefault(key, self.made())
            for _, *row in rows:
                out += [(key, *o) for o in machine.advance(row[0])]
                out += [(key, *o) for o in machine.take(*row)]
        for key, machine in machines.items():
            while (due := machine.due()) is not None and due < end:
                out += [(key, *o) for o in machine.advance(due)]
        if machines:
            self.machines.update(([(key, *m.dump()) for key, m in machines.items()],))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [x for x in (following, *[m.due() for m in machines.values()]) if x is not None]
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)
        if out:
            yield pd.DataFrame(np.array(out, np.int64), columns=[self.columns[0], "decided_us", "event_id", "outcome"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [part[self.columns].to_numpy(np.int64) for part in rows]
        yield from self._settled(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def timed(stream: DataFrame, made: Callable[[], object], late: str, key: str = "stream_id", at: str = "capture_us", event: str = "event_id", slot_us: int = 100_000) -> DataFrame:
    """The key and the outcomes of a machine over a stream, as its watermark passes them (append mode): those of
    ``machines.applied`` up to the watermark, as long as no row is later than ``late``. Rows wait in slots of ``slot_us``. Needs the
    state provider ``PROVIDER``."""
    shipped(stream.sparkSession)
    columns = [key, at, event, *made().NEEDS]
    rows = stream.select(F.shiftright(F.col(key).cast("long"), BLOCK_BITS).alias("block"), F.timestamp_micros(at).alias("clock"), *[F.col(c).cast("long") for c in columns]).withWatermark("clock", late)
    return rows.groupBy("block").transformWithStateInPandas(Timed(made, columns, slot_us), f"{key} long, {OUTCOMES}", "append", "eventTime")
