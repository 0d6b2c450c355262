"""Adaptation fields, program clocks, elementary packets and the fragment guard: hand cases and random packets against plain machines."""

import random

from pyspark.sql import functions as F

from tidewire.operators import transport


def ts(pid, payload=b"", starts=False, adaptation=None, error=False, control=None, sync=0x47):
    """A packet; ``adaptation`` is the field without its length. Payloads shorter than the packet are stuffed by the field."""
    room = 184 - (0 if adaptation is None else len(adaptation) + 1)
    if adaptation is None and len(payload) < 184:
        adaptation, room = b"", 183
    if adaptation is not None and len(payload) < room:
        adaptation = (adaptation or (b"\0" if room - len(payload) > 0 else b"")) + b"\xff" * (room - len(payload) - (0 if adaptation else 1))
    held = b"" if adaptation is None else bytes([len(adaptation)]) + adaptation
    control = (2 if adaptation is not None else 0) + (1 if payload else 0) if control is None else control
    out = bytes([sync, (0x80 if error else 0) | (0x40 if starts else 0) | pid >> 8, pid & 255, control << 4]) + held + payload
    assert len(out) == 188, len(out)
    return out


def rows(spark, packets):
    return spark.createDataFrame([(0, i, p.hex().upper()) for i, p in enumerate(packets)], "stream_id long, arrival_idx long, ts string")


def pcr(ticks):
    base, ext = divmod(ticks, 300)
    return (base << 15 | 0x3F << 9 | ext).to_bytes(6, "big")


def test_fields(spark):
    packets = [ts(256, b"x" * 184), ts(256, b"ab", True), ts(300, b"", adaptation=b"\x10" + pcr(12_345_678_901)), ts(300, b"abc", adaptation=b"\x90" + pcr((1 << 33) * 300 - 1)), ts(1, b"x" * 184, error=True), ts(1, b"x" * 184, control=0), ts(1, b"x" * 184, sync=0x46), ts(1, b"x" * 184)[:187], ts(17, b"q", adaptation=b"\x10\x01\x02")]
    found = [r.f for r in rows(spark, packets).select("arrival_idx", transport.fields(F.col("ts")).alias("f")).orderBy("arrival_idx").collect()]
    assert [f.problem for f in found] == [None, None, None, None, "error", "control", "sync", "length", None]
    assert [f.pcr for f in found] == [None, None, 12_345_678_901, (1 << 33) * 300 - 1, None, None, None, None, None or found[8].pcr]
    assert found[3].discontinuity and not found[2].discontinuity and found[1].payload == "6162" and found[2].payload is None and found[3].payload == "616263"
    assert spark.createDataFrame([(None,)], "ts string").select(transport.fields(F.col("ts"))["problem"]).first()[0] == "length"


def test_short_field_has_no_clock(spark):
    field = bytes([0x47, 1, 0, 0x30, 6, 0x10]) + b"\1" * 5 + b"z" * 177
    assert rows(spark, [field]).select(transport.fields(F.col("ts"))["pcr"]).first()[0] is None


def test_clock_lines(spark):
    top = (1 << 33) * 300
    clocks = [(100, False), (400, False), (top - 50, False), (50, False), (7_000, True), (7_300, False), (3, True)]
    packets = [ts(256, b"", adaptation=bytes([0x90 if d else 0x10]) + pcr(c)) for c, d in clocks] + [ts(257, b"", adaptation=b"\x10" + pcr(9)), ts(256, b"x" * 184)]
    found = [(r.pid, r.epoch, r.elapsed) for r in transport.clock_lines(rows(spark, packets)).orderBy("arrival_idx").collect()]
    assert found == [(256, 0, 0), (256, 0, 300), (256, 0, -150), (256, 0, -50), (256, 1, 0), (256, 1, 300), (256, 2, 0), (257, 0, 0)]


def stamp(t, prefix):
    return bytes([prefix << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def pes(data, length=None, pts=None, dts=None, sid=0xE0, extra=b""):
    head = b"" if pts is None else stamp(pts, 3 if dts is not None else 2) + (b"" if dts is None else stamp(dts, 1))
    head += extra
    flags = 0x80 if dts is None and pts is not None else 0xC0 if pts is not None else 0
    body = bytes([0x80, flags, len(head)]) + head + data
    n = len(body) if length is None else length
    return b"\0\0\1" + bytes([sid]) + n.to_bytes(2, "big") + body


def found(spark, packets, **more):
    made = transport.pes_units(rows(spark, packets), **more).orderBy("pid", "unit").collect()
    return [(r.pid, r.packets, r.announced, r.bytes, r.pts, r.dts, r.status, bytes(r.payload)) for r in made]


def test_pes_units(spark):
    whole = pes(b"d" * 400, pts=(1 << 33) - 1, dts=5, extra=b"\xff" * 3)
    packets = [ts(256, b"orphan"), ts(256, whole[:184], True), ts(256, whole[184:368]), ts(256, whole[368:]), ts(256, b"behind it")]
    assert found(spark, packets) == [(256, 3, len(whole), len(whole), (1 << 33) - 1, 5, "complete", b"d" * 400)]
    cut = [ts(256, whole[:184], True), ts(256, pes(b"next", 0, pts=9), True), ts(256, b"goes on"), ts(256, pes(b"z"), True), ts(257, pes(b"abc", 100), True)]
    assert found(spark, cut) == [
        (256, 1, len(whole), 184, (1 << 33) - 1, 5, "incomplete", whole[184 - (184 - 22):184]), (256, 2, None, len(pes(b"next", 0, pts=9)) + 7, 9, 9, "complete", b"nextgoes on"),
        (256, 1, 10, 10, None, None, "complete", b"z"), (257, 1, 106, 12, None, None, "open", b"abc"),
    ]


def test_pes_limits(spark):
    over = [ts(256, pes(b"a" * 20, 25), True), ts(256, b"b" * 30)]
    assert [(x[6], x[7]) for x in found(spark, over)] == [("overrun", b"a" * 20 + b"b" * 2)]
    long = [ts(256, pes(b"", 0), True), *[ts(256, b"c" * 184) for _ in range(5)]]
    assert [(x[1], x[6]) for x in found(spark, long, most=600)] == [(5, "oversize")]
    assert [(x[1], x[6]) for x in found(spark, [ts(256, pes(b"", 700), True), ts(256, b"x")], most=600)] == [(1, "oversize")]
    bad = [ts(256, pes(b"fine", 30), True), ts(256, b"\0\0\2" + b"\xe0" + b"\0" * 20, True), ts(256, b"\0\0\1\xe0", True), ts(256, pes(b"", 9)[:8] + b"\x20" + b"ab", True), ts(256, b"more")]
    assert [(x[1], x[6], x[7]) for x in found(spark, bad)] == [(2, "open", b"finemore")]
    assert [(x[4], x[5]) for x in found(spark, [ts(256, pes(b"x", pts=77).replace(stamp(77, 2), b"\x41" + stamp(77, 2)[1:]), True), ts(256, pes(b"x", pts=77).replace(stamp(77, 2), stamp(77, 2)[:4] + b"\x9a"), True)])] == [(None, None)] * 2
    assert [(x[6], x[7]) for x in found(spark, [ts(256, b"\0\0\1\xbe\0\x04abcd", True)])] == [("complete", b"abcd")]
    assert found(spark, []) == []


def guard(spark, fragments, **more):
    df = spark.createDataFrame([(0, i, *f) for i, f in enumerate(fragments)], "stream_id long, arrival_idx long, seq int, capture_us long, bytes long, starts boolean, ends boolean")
    return [(r.unit, r.fragments, r.problem, r.complete) for r in transport.guarded_fragments(df, **more).orderBy("arrival_idx").collect()]


def test_fragment_guard(spark):
    assert guard(spark, [(65534, 0, 1, True, False), (65535, 1, 1, False, False), (1, 2, 1, False, True)]) == [(1, 1, None, False), (1, 2, None, False), (1, 3, None, True)]
    # each rule refuses one, and the next is judged by the last that was taken
    case = [(10, 0, 1, True, False), (10, 1, 1, False, False), (9, 2, 1, False, False), (16, 3, 1, False, False), (11, 4, 99, False, False), (15, 5, 1, False, False), (20, 6, 1, False, True), (21, 7, 1, False, True)]
    assert [x[2] for x in guard(spark, case, most_fragment=50)] == [None, "repeat", "order", "gap", "fragment size", None, None, "no start"]
    assert [x[2] for x in guard(spark, [(1, 0, 1, True, False), (2, 5_000_001, 1, False, False), (3, 5_000_002, 1, False, True)])] == [None, "age", "no start"]
    assert [x[2] for x in guard(spark, [(1, 0, 1, True, False), (2, 1, 1, False, False), (3, 2, 1, False, True)], most=2)] == [None, None, "count"]
    assert [x[2] for x in guard(spark, [(1, 0, 6, True, False), (2, 1, 6, False, True)], most_unit=10)] == [None, "unit size"]
    assert [x[2] for x in guard(spark, [(1, 0, 1, False, False), (2, 1, 1, True, True)])] == ["no start", None]


def test_pes_random(spark):
    r = random.Random(3)
    packets, state, units = [], None, []

    def close(status):
        units.append((status, bytes(state["data"])))

    for _ in range(300):
        if r.random() < 0.4:
            n = r.choice([0, None, None, 30, 200])
            p = pes(bytes(r.randrange(256) for _ in range(r.randint(0, 60))), n, pts=r.choice([None, 7]))
            if state is not None:
                close("complete" if state["announced"] is None else "incomplete")
            length = int.from_bytes(p[4:6], "big")
            state = {"announced": length + 6 if length else None, "come": 0, "data": bytearray(), "head": 9 + p[8]}
            packets.append(ts(256, p, True))
        else:
            p = bytes(r.randrange(256) for _ in range(r.randint(1, 184)))
            packets.append(ts(256, p))
            if state is None:
                continue
        room = len(p) if state["announced"] is None else min(len(p), state["announced"] - state["come"])
        state["data"] += p[state["head"] : room]
        state["come"] += len(p)
        state["head"] = 0
        if state["announced"] is not None and state["come"] >= state["announced"]:
            close("overrun" if state["come"] > state["announced"] else "complete")
            state = None
    if state is not None:
        close("open")
    assert [(x[6], x[7]) for x in found(spark, packets)] == units and len(units) > 60
