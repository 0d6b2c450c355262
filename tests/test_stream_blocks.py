"""Streams of many keys: what is kept and written follows the rows, not the keys, and no part passes one task."""

import pytest

from tidewire.operators import machines
from tidewire.plans import timed
from tidewire.streaming import keyed, live

LATE = f"{timed.LATE_MS} milliseconds"


@pytest.mark.parametrize("made,source", [(timed._BUFFER, timed.buffered), (timed._RECOVERY, timed.errors)])
def test_parts_of_several_files(spark, sf_dir, monkeypatch, made, source):
    monkeypatch.setattr(timed, "FILE_ROWS", 4)
    rows = timed.kept(source(spark, sf_dir))
    found, held = live.watched(keyed.timed(timed.streamed(rows), made, LATE), provider=keyed.PROVIDER)
    batch = timed.passed(machines.applied(rows, made), rows)
    assert sorted(map(tuple, timed.passed(found.drop("batch"), rows).select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    # a batch for each part, and one more for the watermark
    assert timed.PARTS <= len(held) <= 2 * timed.PARTS


def test_files_of_parts(spark, monkeypatch):
    # all rows but one lie in one part: files without rows are there as well
    rows = timed.kept(spark.range(100).selectExpr("id % 3 AS stream_id", "CASE WHEN id = 0 THEN 0L ELSE 5000000L + id END AS capture_us", "id AS event_id"))
    monkeypatch.setattr(timed, "FILE_ROWS", 5)
    found, _ = live.watched(timed.streamed(rows))
    sizes = [x["count"] for x in found.groupBy("batch").count().orderBy("batch").collect()]
    assert sorted(sizes) == [1, 99] and found.select("event_id").distinct().count() == 100


def test_state_follows_blocks(spark):
    step, first = 40_000, 10_000_000  # not at zero, where the watermark begins
    rows = timed.kept(spark.range(2000).selectExpr("id % 200 - 100 AS stream_id", f"{first} + floor(id / 200) * {step} + id % 7 AS capture_us", "id AS event_id", "floor(id / 200) AS seq", "floor(id / 200) * 3000 AS rtp_ts"))
    found, held = live.watched(keyed.timed(timed.streamed(rows), timed._BUFFER, LATE), provider=keyed.PROVIDER)
    batch = timed.passed(machines.applied(rows, timed._BUFFER), rows)
    assert sorted(map(tuple, timed.passed(found.drop("batch"), rows).select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() > 100 and 0 < max(held) < 200  # fewer than there are streams


def test_slots():
    """Rows wait in slots; a batch takes what lies before its end, in order of key and time."""
    import numpy as np

    class Map(dict):
        def exists(self):
            return bool(self)

        def keys(self):
            return iter(list(super().keys()))

        getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.pop

    t = keyed.Timed(None, ["k", "at", "e"], 10)
    t.waiting = Map()
    ready, following = t._ready([np.array([[2, 35, 1], [1, 12, 2], [1, 3, 3]]), np.array([[1, 31, 4]])], 12)
    assert ready.tolist() == [[1, 3, 3]] and following == 12 and set(t.waiting) == {(1,), (3,)}
    ready, following = t._ready([np.array([[1, 38, 5]])], 15)
    assert ready.tolist() == [[1, 12, 2]] and following == 30 and set(t.waiting) == {(3,)}
    ready, following = t._ready([], 36)
    assert ready.tolist() == [[1, 31, 4], [2, 35, 1]] and following == 38
    assert t._ready([], 100)[0].tolist() == [[1, 38, 5]] and not t.waiting and t._ready([], 200)[1] is None
