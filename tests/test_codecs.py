"""AV1 and JPEG XS payloads, frame boundaries, slices and their sets: hand cases, and random packets against machines that go through
the packets one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import units
from tidewire.operators import boundaries, parameters, payloads


def av1(spark, rows):
    """(unit, kind, obu) of packets (sequence number, payload)."""
    df = spark.createDataFrame([(0, i, s, bytearray(p) if p is not None else None) for i, (s, p) in enumerate(rows)], "stream_id long, arrival_idx long, seq int, data binary")
    return [(r.unit, r.kind, bytes(r.obu)) for r in payloads.av1_units(df).orderBy("arrival_idx", "place").collect()]


def test_av1_whole_and_fragmented(spark):
    assert [x[2] for x in av1(spark, [(1, b"\x10\x0a\x01"), (2, b"\x20\x02\x12\x00\x32\xff")])] == [b"\x0a\x01", b"\x12\x00", b"\x32\xff"]
    parts = [(100, b"\x40\x32\x01"), (101, b"\xc0\x02\x03"), (102, b"\x80\x04")]
    assert av1(spark, parts) == [(1, 6, b"\x32\x01\x02\x03\x04")]
    assert av1(spark, [(65535, b"\x40\x32\x01"), (0, b"\x80\x04")]) == [(1, 6, b"\x32\x01\x04")]  # the numbers wrap
    assert av1(spark, [parts[0], parts[2]]) == []  # one is lost
    assert av1(spark, parts[1:]) == []  # no start
    assert av1(spark, [*parts[:2], (102, b"\x40\x32\x09"), (103, b"\x80\x0a")]) == [(1, 6, b"\x32\x09\x0a")]  # a new start
    assert av1(spark, []) == [] and av1(spark, [(1, b""), (2, None)]) == []


def test_av1_sizes(spark):
    assert [x[2] for x in av1(spark, [(1, b"\x00\x02\x0a\x01\x00\x81\x00\x32")])] == [b"\x0a\x01", b"\x32"]  # an empty one is left out
    assert av1(spark, [(1, b"\x00\x05\x0a")]) == [] and av1(spark, [(1, b"\x00" + b"\xff" * 12)]) == []
    with_loss = payloads.av1_units(spark.createDataFrame([(0, i, i, bytearray(b)) for i, b in enumerate([b"\x40\x32" + b"x" * 50, b"\xc0" + b"y" * 50, b"\x80z"])], "stream_id long, arrival_idx long, seq int, data binary"), 60)
    assert with_loss.count() == 0  # beyond the bound


def test_av1_temporal_units(spark):
    found = av1(spark, [(1, b"\x18\x0a\x01"), (2, b"\x10\x32\x01"), (3, b"\x18\x32\x02"), (4, b"\x20\x01\x10\x32\x03"), (5, b"\x20\x01\x32\x10\x00")])
    assert [x[0] for x in found] == [1, 1, 2, 3, 3, 3, 4][: len(found)] and len(found) == 7


class _Av1:
    """One packet after the other."""

    def __init__(self):
        self.last, self.parts, self.out, self.unit, self.new = None, None, [], 0, True

    def put(self, obu):
        kind = None if not obu or obu[0] & 128 else obu[0] >> 3 & 15
        if self.new or kind == 2:
            self.unit += 1
        self.new = False
        self.out.append((self.unit, kind, obu))

    def add(self, seq, p):
        if not p:
            return
        z, y, n = p[0] & 128, p[0] & 64, p[0] & 8
        gap = self.last is not None and seq != (self.last + 1) % 65536
        self.last = seq
        if gap and self.parts is not None:
            self.parts = None
            if z:
                return
        if n:
            self.new = True
        if z:
            if self.parts is None:
                return
            self.parts.append(p[1:])
            if not y:
                self.put(b"".join(self.parts))
                self.parts = None
        elif y:
            self.parts = [p[1:]]
        else:
            for u in units.av1_elements(p) or []:
                self.put(u)


def test_av1_random(spark):
    r = random.Random(7)
    rows, seq = [], 65400
    for _ in range(600):
        seq = (seq + r.choice([1] * 12 + [2, 0, 65535])) % 65536
        head = r.choice([0x00, 0x10, 0x20, 0x30, 0x40, 0xC0, 0x80]) | r.choice([0, 0, 0, 8])
        rows.append((seq, bytes([head, *(r.choice([0, 1, 2, 3, 0x10, 0x12, 0x32, 0x90, 0x85]) for _ in range(r.randint(0, 6)))]) if r.random() > 0.05 else b""))
    machine = _Av1()
    for row in rows:
        machine.add(*row)
    assert av1(spark, rows) == machine.out
    assert len(machine.out) > 120 and machine.unit > 60


def xs(spark, rows):
    df = spark.createDataFrame([(0, i, s, p.hex().upper()) for i, (s, p) in enumerate(rows)], "stream_id long, arrival_idx long, seq int, h string")
    return [(r.frame, r.profile, r.packets, bytes(r.data)) for r in payloads.xs_frames(df).orderBy("arrival_idx").collect()]


def test_xs_frames(spark):
    def p(flags, frame, data=b"", more=b""):
        return bytes([flags]) + frame.to_bytes(3, "big") + more + data

    assert xs(spark, [(0, p(0xC0, 1, b"abcd"))]) == [(1, None, 1, b"abcd")]
    assert xs(spark, [(65535, p(0x80, 1, b"ab")), (0, p(0, 1, b"cd")), (1, p(0x40, 1, b"ef"))]) == [(1, None, 3, b"abcdef")]
    assert xs(spark, [(1, p(0xC4, 1, b"ab", b"\x00\x01\x2a\x40"))]) == [(1, 0x2A, 1, b"ab")]
    lost = [(100, p(0x80, 1, b"ab")), (102, p(0x40, 1, b"cd")), (103, p(0xC0, 2, b"ef"))]
    assert xs(spark, lost) == [(2, None, 1, b"ef")]
    assert xs(spark, [(100, p(0x80, 1, b"ab")), (102, p(0, 1, b"cd")), (103, p(0x40, 1, b"ef"))]) == []  # nothing of it behind the loss
    assert xs(spark, [(100, p(0x80, 1, b"ab")), (101, p(0xC0, 2, b"cd"))]) == [(2, None, 1, b"cd")]  # another number
    assert xs(spark, [(1, p(0xC0, 1))]) == [] and xs(spark, [(1, b"\xc0\x00"), (2, p(0xC4, 1))]) == [] and xs(spark, []) == []
    assert xs(spark, [(1, p(0x40, 0xFFFFFF, b"a")), (2, p(0xC0, 0, b"b"))]) == [(0xFFFFFF, None, 1, b"a"), (0, None, 1, b"b")]


# Boundaries


class _H264:
    def __init__(self):
        self.last, self.open = 0, False

    def add(self, d, flag):
        def vcl(k):
            return 1 <= k <= 5

        if not d:
            return False, False
        if d.startswith((b"\0\0\1", b"\0\0\0\1")):
            kinds = [u[0] & 31 for u in units.annex_b(d)]
            starts = ends = False
            for k in kinds:
                if k in (5, 7, 8, 9):
                    starts = self.open = True
                if self.open and k == 9:
                    ends, self.open = True, False
                elif self.open and k in (1, 5, 7, 8) and starts:
                    ends = True
                if starts and any(map(vcl, kinds)):
                    ends = True
            return starts, ends
        kind, first, last = d[0] & 31, True, True
        if kind == 28:
            if len(d) < 2 or d[1] & 32:
                return False, False
            kind, first, last = d[1] & 31, d[1] & 128, d[1] & 64
        starts = ends = False
        if first:
            starts = kind in (5, 7, 8, 9) or vcl(kind) and not vcl(self.last) and self.last != 0
            self.open |= starts
            if self.open and vcl(self.last) and kind in (6, 7, 8, 9):
                starts = ends = True
        if first or last:
            self.last = kind
        return starts, ends


class _Hevc:
    def __init__(self):
        self.last, self.open = 0, False

    def add(self, d, flag):
        if len(d) < 2:
            return False, False
        starts = ends = False
        if d.startswith((b"\0\0\1", b"\0\0\0\1")):
            for u in units.annex_b(d):
                if len(u) < 2:
                    continue
                k = u[0] >> 1 & 63
                if self.open and 32 <= k <= 35:
                    ends, self.open = True, False
                starts |= 16 <= k <= 23 or 32 <= k <= 35
                self.open |= k <= 31
                self.last = k
            return starts, ends
        k = d[0] >> 1 & 63
        if k == 49:
            if len(d) < 3:
                return False, False
            k = d[2] & 63
            if d[2] & 128:
                starts = k == 35 or k <= 31
                self.open |= starts
                if self.open and self.last <= 31 and 32 <= k <= 35:
                    starts = ends = True
            if d[2] & 192:
                self.last = k
            return starts, ends
        starts = 32 <= k <= 35 or 16 <= k <= 23 or k <= 31 and self.last > 31
        self.open |= starts
        if self.open and self.last <= 31 and k > 31:
            ends, self.open = True, False
        self.last = k
        return starts, ends


class _Obus:
    def __init__(self):
        self.open = self.headed = False

    def add(self, d, flag):
        starts = ends = False
        for k, _ in units.obus(d) or []:
            if k == 2:
                ends |= self.open
                starts = self.open = True
                self.headed = False
            if k == 1:
                ends |= self.open and not self.headed
                starts = self.open = True
            if k in (3, 6) and not self.headed:
                starts = self.open = self.headed = True
            if k == 4 and self.headed or k == 6:
                ends, self.open, self.headed = True, False, False
        return starts, ends


class _Xs:
    def __init__(self):
        self.open = False

    def add(self, d, flag):
        starts = ends = False
        if len(d) < 2:
            return False, False
        for m in units.markers(d):
            if m == 0x10:
                ends |= self.open
                starts = self.open = True
            elif m == 0x11:
                ends |= self.open
                self.open = False
            elif m == 0x15 and not self.open:
                starts = self.open = True
        if flag and self.open:
            ends, self.open = True, False
        return starts, ends


def _random_packets(r, codec):
    def unit():
        if codec == "H264":
            return bytes([r.choice([1, 5, 6, 7, 8, 9, 12, 0x41, 0x65]), r.randrange(4, 256)])
        return bytes([2 * r.choice([0, 1, 9, 16, 19, 21, 32, 33, 34, 35, 39]), r.randrange(4, 256)][: r.choice([1, 2, 2, 2, 2])])

    if codec == "AV1":
        return bytes(r.choice([0x12, 0x0A, 0x1A, 0x22, 0x32, 0x30, 0x34, 0x7A, 0x92, 0, 1, 1, 2, 0x85]) for _ in range(r.randrange(8)))
    if codec == "JPEGXS":
        return b"".join(r.choice([b"\xff\x10", b"\xff\x11", b"\xff\x15\x00\x02", b"\xff\x12\x00\x04ab", b"a", b"\xff"]) for _ in range(r.randrange(4)))
    if r.random() < 0.25:
        return b"".join(r.choice([b"\0\0\1", b"\0\0\0\1"]) + unit() for _ in range(r.randrange(1, 4)))
    if r.random() < 0.3:
        head = b"\x7c" if codec == "H264" else b"\x62\x01"
        return (head + bytes([r.choice([0x80, 0x40, 0, 0xC0, 0xA0]) | r.choice([1, 5, 7, 9, 16, 19])]))[: r.choice([1, 2, 3, 3, 3])]
    return unit() if r.random() > 0.05 else b""


@pytest.mark.parametrize("codec,machine", [("H264", _H264), ("HEVC", _Hevc), ("AV1", _Obus), ("JPEGXS", _Xs)])
def test_boundaries_random(spark, codec, machine):
    r = random.Random(11)
    rows, expected = [], []
    for s in range(3):
        m = machine()
        for i in range(400):
            d, flag = _random_packets(r, codec), r.random() < 0.1
            rows.append((s, i, codec, bytearray(d), flag))
            expected.append((s, i, *map(bool, m.add(d, flag))))
    df = spark.createDataFrame(rows, "stream_id long, arrival_idx long, codec string, data binary, flag boolean").repartition(5)
    found = sorted(tuple(x) for x in boundaries.detected(df, F.col("flag")).collect())
    assert found == expected and sum(x[2] for x in expected) > 50 and sum(x[3] for x in expected) > 20


def test_boundaries_of_nothing(spark):
    df = spark.createDataFrame([(0, 1, c, None) for c in ("H264", "HEVC", "AV1", "JPEGXS")], "stream_id long, arrival_idx long, codec string, data binary")
    assert [(r.starts, r.ends) for r in boundaries.detected(df, F.lit(True)).collect()] == [(False, False)] * 4


# Slices and sets


def _bits(*codes):
    out = "".join("0" * (len(bin(c + 1)) - 3) + bin(c + 1)[2:] for c in codes) + "1"
    out += "0" * (-len(out) % 8)
    raw = int(out, 2).to_bytes(len(out) // 8, "big")
    escaped, zeros = bytearray(), 0
    for b in raw:
        if zeros >= 2 and b <= 3:
            escaped.append(3)
            zeros = 0
        escaped.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(escaped)


def _sps(i, profile=66):
    return b"\x67" + bytes([profile, 0, 31]) + _bits(i)


def _pps(i, s):
    return b"\x68" + _bits(i, s)


def _slice(pps, kind=0, first=0, head=0x41):
    return bytes([head]) + _bits(first, kind, pps)


def _frames(spark, frames):
    return spark.createDataFrame([(0, i, [bytearray(u) for u in f]) for i, f in enumerate(frames)], "stream_id long, arrival_idx long, units array<binary>")


def test_requirements(spark):
    frames = [
        [_slice(0)], [_pps(0, 2), _slice(0)], [_sps(1)], [_slice(0)], [_sps(2), _slice(0, 7, 0, 0x65)], [_pps(0, 1)], [_slice(0, first=(1 << 22) - 1)], [_slice(255)], [_slice(300)], [b"\x41"],
        [_slice(0, 11)], [b"\x06\x05"], [], [b"", _slice(0), _slice(9)], [b"\x41\x00\x00\x00\x00\x00\x00"],
    ]
    found = [(r.slice_type, r.pps, r.sps, r.status) for r in parameters.requirements(_frames(spark, frames)).orderBy("arrival_idx").collect()]
    assert found == [
        (0, 0, None, "missing pps"), (0, 0, 2, "missing sps"), (None, None, None, "no slice"), (0, 0, 2, "fallback"), (7, 0, 2, "ready"), (None, None, None, "no slice"), (0, 0, 1, "ready"), (0, 255, None, "missing pps"),
        (0, None, None, "unreadable pps"), (None, None, None, "unreadable length"), (None, None, None, "unreadable slice type"), (None, None, None, "no slice"), (None, None, None, "no slice"), (0, 0, 1, "ready"), (None, None, None, "unreadable first macroblock"),
    ]


def test_frame_types_of_slices(spark):
    frames = [[_slice(0, 7, 0, 0x65)], [_slice(0, 0, 0, 0x65)], [b"\x65"], [b"\x65\x00\x00\x00"], [_sps(0), _pps(0, 0)], [_pps(0, 0)], [b"\x06\x05"], [_slice(0, 1)], [_slice(0, 8)], [_slice(0, 9)], [_slice(0, 11), _slice(0, 6)]]
    rows = _frames(spark, frames).select("arrival_idx", boundaries.h264_frame_type(units.h264_fields(F.col("units"))).alias("t")).orderBy("arrival_idx").collect()
    assert [r.t for r in rows] == ["IDR", "P", "I", "I", "SPS", "PPS", "P", "B", "P", "I", "B"]


def test_matches_and_fallbacks(spark):
    frames = [[_slice(0)], [_pps(0, 0)], [_sps(0), _pps(0, 0)], [_slice(0)], [_sps(1)], [_sps(2)], [_sps(3)], [_slice(7)], [_sps(4)], [_slice(0)]]
    found = [(r.session, r.quality, r.age) for r in parameters.matches(_frames(spark, frames)).orderBy("arrival_idx").collect()]
    # the whole session is three sessions back at most, then out of reach: of equals the newest
    assert found == [(0, 0.0, None), (1, 0.5, 0), (2, 1.0, 0), (2, 1.0, 0), (3, 1.0, 1), (4, 1.0, 2), (5, 1.0, 3), (5, 1.0, 3), (6, 0.5, 0), (6, 0.5, 0)]
    low = [[_slice(0)], [_sps(5, 44), _pps(1, 5)], [_slice(0)], [_sps(5, 77)], [_slice(0)], [_slice(3)]]
    found = [(r.arrival_idx, r.strategy, r.quality) for r in parameters.fallbacks(_frames(spark, low)).orderBy("arrival_idx").collect()]
    assert [(a, s, round(q, 3)) for a, s, q in found] == [(0, "generic", 0.3), (2, "approximate", 0.7), (4, "compatible", 0.85), (5, "approximate", 0.7)]


def test_obu_frame_types(spark):
    cases = [(b"\x32\x01\x00", "IDR"), (b"\x32\x01\x20", "P"), (b"\x1a\x01\x40", "I"), (b"\x1a\x01\x60", "P"), (b"\x32\x01\x80", "P"), (b"\x12\x00\x0a\x01\xaa\x32\x01\x00", "SPS"), (b"\x12\x00", "P"), (b"\x92\x00", "P"), (b"\x32\x00", "P"), (b"", "P")]
    df = spark.createDataFrame([(i, bytearray(d), "AV1") for i, (d, _) in enumerate(cases)], "i int, data binary, codec string")
    rows = df.select("i", boundaries.av1_frame_type(units.unit_kinds(F.col("data"), F.col("codec"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [t for _, t in cases]


def test_codec_of_payloads(spark):
    cases = [(b"\x40\x01", "HEVC"), (b"\x40\x00", None), (b"\x41\x00", "H264"), (b"\x7c\x85", "H264"), (b"\x62\x01", "HEVC"), (b"\x12\x00\x00\x00", "H264"), (b"\x20\x00\x01\x02", "AV1"), (b"\x20\x00\x01", None), (b"\xc1\x01", None), (b"\x41", None), (b"", None), (None, None)]
    df = spark.createDataFrame([(i, 96, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)] + [(len(cases), 97, bytearray(b""))], "i int, pt int, data binary")
    known = F.create_map(F.lit(97), F.lit("AV1"))
    assert [r.c for r in df.select("i", boundaries.payload_codec(F.col("data"), F.col("pt"), known).alias("c")).orderBy("i").collect()] == [*(c for _, c in cases), "AV1"]


def test_coverage(spark):
    r = parameters.coverage(_frames(spark, [[_pps(0, 2), _pps(1, 1)], [_sps(1)], [_pps(0, 1)], [_pps(3, 5)], [b"\x68"]])).first()
    assert (r.picture_sets, r.covered, round(r.coverage, 4)) == (3, 2, 0.6667)
    assert parameters.coverage(_frames(spark, [[_sps(1)]])).count() == 0
