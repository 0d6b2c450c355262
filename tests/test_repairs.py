"""Recurrences over several blocks, packets among noise, checksums of chunks, limits of units."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewire.functions import units
from tidewire.operators import folds, sequences


@pytest.mark.parametrize("keep,block", [(0.9, 16), (15 / 16, 1024), (0.5, 64), (0.999, 1024), (0.9999, 1024), (0.0, 8)])
def test_means_over_blocks(spark, monkeypatch, keep, block):
    monkeypatch.setattr(sequences, "BLOCK", block)
    r = random.Random(3)
    rows = [(s, i, r.random() * 1000) for s in (1, 2) for i in range(5000)]
    df = spark.createDataFrame(rows, "stream_id long, arrival_idx long, v double").repartition(5)
    found = {x.stream_id: (x.last, x.most) for x in sequences.smoothed(df, F.col("v"), keep).collect()}
    for s in (1, 2):
        state, most = 0.0, float("-inf")
        for _, _, v in sorted(x for x in rows if x[0] == s):
            state = keep * state + (1 - keep) * v
            most = max(most, state)
        assert found[s] == pytest.approx((state, most), rel=1e-9)


def test_slow_means_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "stream_id long, arrival_idx long, v double")
    for keep in (1.0, 1.5, -0.1, 0.9999999):
        with pytest.raises(ValueError):
            sequences.smoothed(df, F.col("v"), keep)


def _packet(n):
    return b"\x47" + bytes([n % 60]) * 187


def test_packets_among_noise(spark):
    noise = b"\x01" * 10
    assert folds.cut_packets(_packet(1) + noise + _packet(2) + _packet(3) + _packet(4)) == ([_packet(1), _packet(2), _packet(3), _packet(4)], b"")
    assert folds.cut_packets(b"\x00" * 100_000) == ([], b"\x00" * 187)  # no more than a packet is kept
    assert folds.cut_packets(b"") == ([], b"")
    r = random.Random(5)
    data, sent = b"", []
    # behind noise come two packets at least: one alone can't be told from a byte that looks like a beginning
    for n in range(60):
        data += b"" if n % 2 or r.random() < 0.4 else bytes(r.randrange(0x40) for _ in range(r.randrange(300)))
        data += _packet(n)
        sent.append(_packet(n))
    cuts = sorted(r.sample(range(len(data)), 80))
    chunks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
    df = spark.createDataFrame([(7, i, bytearray(c)) for i, c in enumerate(chunks)], "stream_id long, arrival_idx long, chunk binary")
    assert [bytes(x.packet) for x in folds.aligned(df).orderBy("n").collect()] == sent


def test_checksums_of_chunks():
    r = random.Random(1)
    for _ in range(50):
        chunks = [r.randbytes(r.choice([0, 1, 5, 1000])) for _ in range(r.randrange(6))]
        assert units.combined_crc([{"crc": zlib.crc32(c), "size": len(c)} for c in chunks]) == zlib.crc32(b"".join(chunks))


def test_limits_of_units(spark):
    cases = [([], "empty"), ([b"\x41"], None), ([b"\x41", b""], "empty"), ([b"\xc1"], "forbidden"), ([b"\x41"] * 1000, None), ([b"\x41"] * 1001, "units"), ([b"\x41" + b"x" * (10 << 20)], "size"), ([b"\x41" + b"x" * ((10 << 20) - 1)], None), (None, "empty")]
    df = spark.createDataFrame([(i, None if u is None else [bytearray(x) for x in u]) for i, (u, _) in enumerate(cases)], "i int, units array<binary>")
    assert [x.p for x in df.select("i", units.frame_problem(F.col("units")).alias("p")).orderBy("i").collect()] == [p for _, p in cases]
