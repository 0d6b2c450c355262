"""Cases computed by hand, and properties that hold for any input."""

from pyspark.sql import functions as F

from tidewire.functions import scores, wire
from tidewire.operators import avsync, folds, gops, registry, sequences


def packets(spark, seqs):
    return spark.createDataFrame([(0, i, s) for i, s in enumerate(seqs)], "stream_id long, arrival_idx long, seq int")


def lost(spark, seqs):
    return sequences.loss_statistics(packets(spark, seqs)).first()


def test_loss_run(spark):
    r = lost(spark, [100, 101, 105, 106, 110])
    assert (r.lost, r.loss_events) == (6, 2)


def test_sequence_wraps(spark):
    r = lost(spark, [65533, 65534, 65535, 0, 1, 2])
    assert (r.lost, r.cycles) == (0, 1)


def test_loss_across_wrap(spark):
    assert sorted(r.lost_seq for r in sequences.lost_sequences(packets(spark, [65534, 2])).collect()) == [0, 1, 65535]


def test_late_packets_recover(spark):
    r = lost(spark, [100, 101, 105, 102, 103, 106])
    assert (r.lost, r.recovered, r.unrecoverable) == (3, 2, 1)


def test_reset(spark):
    steps = sequences.sequence_steps(packets(spark, [*range(1000, 1010), 100])).orderBy("arrival_idx").collect()
    assert steps[-1].step == "reset" and steps[0].step == "first"


def test_groups(spark):
    rows = [(0, 0, 1, "IDR", 1000, 900, 1000), (0, 1, 2, "P", 1033, 933, 1000), (0, 2, 3, "B", 1066, 966, 1000), (0, 3, 4, "IDR", 2000, 1900, 1000)]
    frames = spark.createDataFrame(rows, "stream_id long, arrival_idx long, event_id long, frame_type string, pts long, dts long, size long")
    first = gops.rollup(gops.segmented(frames)).orderBy("gop_id").first()
    assert (first.frames, first.i_frames, first.p_frames, first.b_frames, first.start_pts, first.pattern) == (3, 1, 1, 1, 1000, "IPB")


def test_droppable(spark):
    rows = [(0, 0, i, t) for i, t in enumerate(["IDR", "P", "B", "P", "P"])]
    frames = spark.createDataFrame(rows, "stream_id long, gop_id long, arrival_idx long, frame_type string")
    assert [r.can_drop for r in gops.droppable(frames).orderBy("arrival_idx").collect()] == [False, False, True, True, True]


def test_drift(spark):
    video = spark.createDataFrame([(0, 1_000_000, 1, 90_000)], "stream_id long, capture_us long, event_id long, pts long")
    audio = spark.createDataFrame([(0, 1_100_000, 2, 45_600)], "stream_id long, capture_us long, event_id long, audio_pts long")
    r = avsync.drift(video, audio).first()
    assert (r.drift_us, r.lag_us) == (50_000, -100_000)


def test_health_bands(spark):
    def score(drops, drift, used, errors, variance, changes, late):
        c = [F.lit(x) for x in (drops, drift, used, errors, variance, changes, late)]
        parts = {"frame_drop": scores.frame_drops(c[0]), "timestamp": scores.timestamp_drift(c[1]), "buffer": scores.buffer_use(c[2]), "error_rate": scores.error_rate(c[3]), "bitrate": scores.bitrate_variance(c[4]), "param_changes": scores.parameter_changes(c[5]), "latency": scores.latency(c[6])}
        return spark.range(1).select(scores.weighted(parts).alias("s")).first().s

    assert score(0.0, 0, 0.65, 0.0, 0.0, 0, 30) > 0.95
    assert score(0.15, 150, 0.98, 0.2, 0.6, 12, 600) < 0.3


def test_eviction(spark):
    rows = [("stream1", 0, 100, 300, False), ("stream2", 0, 50, 60, False), ("stream3", 0, 200, 600, False), ("stream4", 0, 75, 30, True)]
    streams = spark.createDataFrame(rows, "stream_id string, node int, memory long, age long, active boolean")
    out = registry.evicted(streams, F.lit(150), [F.asc("active"), F.desc("age")]).collect()
    assert [r.stream_id for r in out] == ["stream3"]


def test_token_bucket_admits_within_rate(spark):
    rows = [(0, i, i * 100_000, 400) for i in range(50)]
    df = spark.createDataFrame(rows, "stream_id long, arrival_idx long, capture_us long, size long")
    out = folds.token_bucket(df, 2000).orderBy("arrival_idx").collect()
    assert out[0].allowed and sum(r.size for r in out if r.allowed) <= 2000 + 2000 * 5


def test_circuit_breaker(spark):
    rows = [(0, i, i * 1000, i < 3) for i in range(8)]
    df = spark.createDataFrame(rows, "stream_id long, arrival_idx long, capture_us long, failed boolean")
    out = [(r.allowed, r.state) for r in folds.circuit_breaker(df, "failed", 3, 3000).orderBy("arrival_idx").collect()]
    assert out[2] == (True, "open") and out[3][0] is False and out[6] == (True, "closed")


def test_wire_round_trips(spark):
    df = spark.createDataFrame([(0,), (127,), (128,), ((1 << 33) - 1,)], "v long")
    out = df.select("v", wire.leb128_value(wire.leb128(F.col("v"))).alias("a"), wire.timestamp(wire.timestamp_bytes(F.col("v"), 2)).alias("b"), wire.exp_golomb(wire.exp_golomb_bits(F.col("v") % 100000)).alias("c"))
    assert all(r.a == r.v and r.b == r.v and r.c == r.v % 100000 for r in out.collect())


def test_emulation_prevention(spark):
    cases = [b"", b"\0\0\0", b"\0\0\1x", b"\0\0\3\0\0\2", b"\0\0\0\0\0\0\1"]
    df = spark.createDataFrame([(bytearray(c),) for c in cases], "d binary").withColumn("e", wire.escaped("d"))
    for r in df.withColumn("u", wire.unescaped("e")).collect():
        assert bytes(r.u) == bytes(r.d) and all(bytes(r.e)[i : i + 3] not in (b"\0\0\0", b"\0\0\1", b"\0\0\2") for i in range(len(r.e)))


def test_nal_units(spark):
    df = spark.createDataFrame([(bytearray(b"\0\0\0\1\x67ab\0\0\1\x65cd"),)], "d binary")
    assert [bytes(x) for x in df.select(wire.nal_units("d").alias("u")).first().u] == [b"\x67ab", b"\x65cd"]


def test_empty_input(spark):
    none = packets(spark, [1]).filter("false")
    assert sequences.loss_statistics(none).count() == 0 and sequences.lost_sequences(none).count() == 0


def reordered(spark, frames, **more):
    rows = [(0, i, n, t, p, d, c) for i, (n, t, p, d, c) in enumerate(frames)]
    df = spark.createDataFrame(rows, "stream_id long, arrival_idx long, event_id long, frame_type string, pts long, dts long, capture_us long")
    return [(r.event_id, r.dts) for r in folds.reordered(df, **more).orderBy("out").collect()]


def test_reorder_buffer(spark):
    at = lambda i: i * 33_000
    simple = [(1, "I", 1000, 1000, at(0)), (4, "P", 4000, 2000, at(1)), (2, "B", 2000, 3000, at(2)), (3, "B", 3000, 4000, at(3))]
    assert [n for n, _ in reordered(spark, simple)] == [1, 4, 2, 3]
    group = [(i + 1, t, p * 1000, i * 1000, at(i)) for i, (t, p) in enumerate(zip("IPBBPBBBBI", (0, 3, 1, 2, 6, 4, 5, 7, 8, 9)))]
    out = reordered(spark, group)
    assert len(out) == 10 and [d for _, d in out] == sorted(d for _, d in out)
    back = [(1, "I", 1000, 1000, at(0)), (2, "P", 2000, 2000, at(1)), (3, "P", 3000, 3000, at(2)), (4, "P", 4000, 500, at(3))]
    assert [n for n, _ in reordered(spark, back)] == [1, 2, 3]  # one dropped
    assert reordered(spark, [(1, "I", 1000, 0, 0)]) == [(1, 1000)]  # the DTS is the PTS
    late = [(1, "B", 1000, 1000, 0), (2, "B", 2000, 2000, 300_000)]
    assert [n for n, _ in reordered(spark, late, depth=5)] == [1, 2]
    idr = [(1, "P", 1000, 1000, at(0)), (2, "B", 5000, 5000, at(1)), (3, "IDR", 4000, 4000, at(2))]
    assert [d for _, d in reordered(spark, idr)] == [1000, 4000, 5000]
    reset = [(i, "P", t, t, at(i)) for i, t in enumerate([5_000_000, 5_003_000, 5_006_000, 1000, 4000, 7000])]
    assert sorted(n for n, _ in reordered(spark, reset)) == list(range(6))  # a new time base is accepted
    wrap = [(i, "P", t % (1 << 33), t % (1 << 33), at(i)) for i, t in enumerate(range((1 << 33) - 9000, (1 << 33) + 9000, 3000))]
    assert len(reordered(spark, wrap)) == 6


def test_timestamp_rules(spark):
    top = (1 << 33) - 1

    def checked(pairs):
        df = spark.createDataFrame([(0, i, p, d) for i, (p, d) in enumerate(pairs)], "stream_id long, arrival_idx long, pts long, dts long")
        return [(r.problem, r.warnings, r.pts_wraps, r.dts_wraps) for r in folds.checked_timestamps(df).orderBy("arrival_idx").collect()]

    for pair, problem in [((90_000, 0), None), ((90_000, 90_000), None), ((95_000, 90_000), None), ((-1, 0), "range"), ((90_000, -1), "range"), ((top + 1, 0), "range"), ((90_000, top + 1), "range"), ((90_000, 95_000), "order")]:
        assert checked([pair])[0][0] == problem
    assert [x[:2] for x in checked([(1000, 1000), (2000, 2000), (1500, 0), (3000, 3000), (4000, 2500)])] == [(None, []), (None, []), (None, ["behind"]), (None, []), ("back", [])]
    assert checked([(top - 1000, top - 1000), (1000, 1000)])[1] == (None, ["wrap", "dts wrap"], 1, 1)


def test_picture_sizes_of_known_sets():
    from tidewire.functions import parsing

    # 1280 x 720, baseline; 1920 x 1080, high, cropped by eight rows
    assert parsing.first_size([bytes.fromhex("68CE3880"), bytes.fromhex("6742001FDA014016E4")], "H264") == (1280, 720)
    assert parsing.first_size([bytes.fromhex("67640028ACD940780227E5C0440000030004000003")], "H264") == (1920, 1080)
    assert parsing.first_size([b"", b"\x67", bytes.fromhex("674200")], "H264") is None and parsing.first_size([b"\x42\x01"], "HEVC") is None


def test_alignment(spark):
    packet = lambda k: b"\x47" + bytes([k]) * 187
    stream = b"\x01\x47\x02" + packet(1) + packet(2) + packet(3)
    df = spark.createDataFrame([(0, i, bytearray(stream[a : a + 100])) for i, a in enumerate(range(0, len(stream), 100))] + [(1, 0, bytearray(b"abc")), (1, 1, None)], "stream_id long, arrival_idx long, chunk binary")
    got = {r.n: bytes(r.packet) for r in folds.aligned(df).collect()}
    assert all(len(p) == 188 and p[0] == 0x47 for p in got.values()) and len(got) == 3
