"""Machines with clocks: hand cases, state that comes back from its numbers, and streams against tables."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidewire.operators import machines
from tidewire.plans import timed
from tidewire.streaming import keyed, live


def run(machine, rows):
    """Outcomes over rows, the state written and read again before each."""
    out, now = [], machine()
    for row in rows:
        fresh = machine()
        numbers, held = now.dump()
        if numbers:
            fresh.load(numbers, held)
        now = fresh
        out += [*now.advance(row[0]), *now.take(*row)]
    while (due := now.due()) is not None:
        out += now.advance(due)
    return out


BUFFER = partial(machines.JitterBuffer, most=3, delay_us=50_000)


def test_buffer_orders_and_wraps():
    rows = [(0, 1, 65534, 0), (10_000, 2, 0, 1800), (20_000, 3, 65535, 900), (30_000, 4, 1, 2700)]
    assert run(partial(BUFFER, most=8), rows) == [(50_000, 1, 0), (60_000, 3, 0), (70_000, 2, 0), (80_000, 4, 0)]


def test_buffer_drops():
    # a repeat while it is there, not after it has gone
    assert run(BUFFER, [(0, 1, 5, 0), (10, 2, 5, 0), (60_000, 3, 5, 0)]) == [(10, 2, 3), (50_000, 1, 0), (60_000, 3, 0)]
    # the lowest number goes when it is full
    assert run(BUFFER, [(i, i + 1, 10 - i, 0) for i in range(4)])[0] == (3, 3, 2)
    # later than its time and the delay once more
    assert run(BUFFER, [(0, 1, 1, 0), (150_000, 2, 2, 90)])[-1] == (150_000, 2, 1)
    assert run(BUFFER, [(0, 1, 1, 0), (51_000 + 50_000, 2, 2, 90)])[-1] == (101_000, 2, 0)
    assert run(BUFFER, []) == []


def test_buffer_head_holds_back():
    # the lowest number has the latest time
    assert run(BUFFER, [(0, 1, 1, 0), (1, 2, 2, 9000), (2, 3, 3, 0)]) == [(50_000, 1, 0), (150_000, 2, 0), (150_000, 3, 1)]


RECOVERY = partial(machines.Recovery, wait_us=1000, most_us=5000)


def states(*rows):
    return [(t, e, machines.Recovery.NAMES[s]) for t, e, s in run(RECOVERY, [(t, i, k, n, closed, clean) for i, (t, k, n, closed, clean) in enumerate(rows)])]


def test_recovery():
    m = machines
    assert states((0, m.PACKET_LOSS, 0, True, False)) == [(0, 0, "recovering"), (0, 0, "normal")]
    assert states((0, m.PACKET_LOSS, 0, False, False), (500, m.KEYFRAME, 0, False, False)) == [(0, 0, "recovering"), (500, 1, "normal")]
    assert states((0, m.CORRUPTION, 0, True, False)) == [(0, 0, "recovering"), (1000, -1, "failed")]
    assert states((0, m.CORRUPTION, 0, False, True)) == [(0, 0, "recovering"), (0, 0, "normal")]
    assert states((0, m.GAP, 4, False, False), (1, m.GAP, 5, False, False))[0] == (1, 1, "recovering")
    assert states((0, m.JUMP, 0, False, False), (900, m.CODEC, 0, False, False), (1500, m.KEYFRAME, 0, False, False)) == [(0, 0, "resyncing"), (1500, 2, "normal")]
    # errors during a recovery ask again; when it began too long ago they fail it
    again = [(k * 900, m.PACKET_LOSS, 0, False, False) for k in range(8)]
    assert states(*again)[:2] == [(0, 0, "recovering"), (5400, 6, "failed")]
    assert states((0, m.TIMEOUT, 0, False, False), (0, m.KEYFRAME, 0, False, False)) == [(0, 0, "resyncing"), (1000, -1, "failed")]  # no newer one
    assert states((0, m.TIMEOUT, 0, False, False), (1000, m.KEYFRAME, 0, False, False)) == [(0, 0, "resyncing"), (1000, -1, "failed")]
    assert states((7, m.KEYFRAME, 0, False, False)) == []


@pytest.mark.parametrize("machine", [BUFFER, RECOVERY])
def test_table_form(spark, machine):
    r = random.Random(5)
    rows = []
    for s in range(4):
        at = 0
        for i in range(200):
            at += r.choice([0, 10, 400, 1500, 30_000])
            rows.append((s, at, s * 1000 + i, r.randrange(20) if machine is BUFFER else r.randrange(7), r.randrange(5000) if machine is BUFFER else r.randrange(9), r.random() < 0.3, r.random() < 0.3))
    names = "stream_id long, capture_us long, event_id long, seq long, rtp_ts long, closed boolean, clean boolean" if machine is BUFFER else "stream_id long, capture_us long, event_id long, kind long, amount long, closed boolean, clean boolean"
    df = spark.createDataFrame(rows, names).repartition(7)
    found = sorted((x.stream_id, x.decided_us, x.event_id, x.outcome) for x in machines.applied(df, machine).collect())
    needs = machine().NEEDS
    columns = [n.split()[0] for n in names.split(", ")]
    expected = [(s, *o) for s in range(4) for o in run(machine, sorted([(x[1], x[2], *(x[columns.index(n)] for n in needs)) for x in rows if x[0] == s]))]
    assert found == sorted(expected) and len(expected) > 100


def test_stream_frees_its_state(spark, sf_dir):
    rows = timed.buffered(spark, sf_dir)
    found, held = live.watched(keyed.timed(timed.streamed(rows), timed._BUFFER, f"{timed.LATE_MS} milliseconds"), provider=keyed.PROVIDER)
    batch = timed.passed(machines.applied(rows, timed._BUFFER), rows)
    stream = timed.passed(found.drop("batch"), rows)
    assert sorted(map(tuple, stream.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect())) and batch.count() > 500
    # the rows that wait are those of the last parts: fewer than came, and fewer at the end than at the height
    assert max(held) < rows.count() and held[-1] < max(held)


def test_no_rows(spark):
    none = spark.createDataFrame([], "stream_id long, capture_us long, event_id long, seq long, rtp_ts long")
    assert machines.applied(none, BUFFER).collect() == []
    assert none.select(machines.named(machines.JitterBuffer, F.lit(1))).columns
