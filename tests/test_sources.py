"""The registry's log and the checks of a packet source: hand cases."""

from tidewire.operators import folds, registry


def log(spark, rows):
    return spark.createDataFrame([(k, i, op, v) for i, (k, op, v) in enumerate(rows)], "stream_id string, nr long, op string, status string")


def test_writes_apply_where_the_key_is(spark):
    rows = [("a", "update", "x"), ("a", "set", "1"), ("a", "update", None), ("a", "update", "2"), ("b", "delete", None), ("a", "delete", None), ("a", "update", "3"), ("a", "delete", None), ("b", "set", "4"), ("c", "set", "5"), ("c", "delete", None), ("c", "set", None)]
    df = log(spark, rows)
    assert [r.applied for r in registry.replayed(df, "stream_id", ["nr"]).orderBy("nr").collect()] == [False, True, True, True, False, True, False, False, True, True, True, True]
    left = registry.current(df, "stream_id", ["nr"], ["status"])
    assert sorted((r.stream_id, r.status, r.created_at, r.n_writes) for r in left.collect()) == [("b", "4", 8, 1), ("c", None, 11, 1)]
    assert registry.got(left, "stream_id", "b").first().status == "4" and registry.got(left, "stream_id", "a").count() == 0
    assert registry.current(log(spark, []), "stream_id", ["nr"], ["status"]).count() == 0


def source(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "stream_id long, arrival_idx long, version int, payload_type int, padding int, bytes long, seq int, rtp_ts long")
    return [(r.problem, r.duration, r.back) for r in folds.validated_source(df).orderBy("arrival_idx").collect()]


def test_source_structure(spark):
    good = (2, 96, None, 100, 1, 3000)
    cases = [((1, 96, None, 100, 1, 0), "version"), ((2, 95, None, 100, 1, 0), "payload type"), ((2, 128, None, 100, 1, 0), "payload type"), ((2, 96, 0, 100, 1, 0), "padding"), ((2, 96, 101, 100, 1, 0), "padding"), ((2, 96, None, 11, 1, 0), "bytes"), ((2, 96, None, 65_537, 1, 0), "bytes")]
    assert [x[0] for x in source(spark, [c for c, _ in cases])] == [p for _, p in cases]
    assert source(spark, [good, (2, 127, 100, 100, 2, 6000)]) == [(None, 3000, False), (None, 3000, False)]


def test_source_state(spark):
    def at(seq, ts):
        return (2, 96, None, 100, seq % 65536, ts % (1 << 32))

    assert [x[0] for x in source(spark, [at(65530, 0), at(65540, 1500), at(65700, 3000), at(65541, 3000)])] == [None, None, "gap", None]
    # five frames back is a B frame, more is none; the duration follows the times
    frames = [at(i, 90_000 + 1500 * i) for i in range(6)]
    assert source(spark, [*frames, at(6, 90_000 + 7500 - 7500), at(7, 90_000)])[-2:] == [(None, 1500, True), (None, 1500, True)]
    assert [x[0] for x in source(spark, [*frames, at(6, 90_000 + 7500 - 7501), at(7, 90_000 + 7500 + 5_400_001), at(8, 90_000 + 7500 + 5_400_000)])][-3:] == ["jump", "jump", None]
    # over the wrap the time begins anew
    near = (1 << 32) - 4000
    assert [x[0] for x in source(spark, [at(i, near + 3000 * i) for i in range(6)])] == [None] * 6


def test_alerts_wait_for_their_cooldown(spark):
    breaches = [(0, True), (10, True), (20, False), (30, True), (119, True), (121, True), (130, False), (500, True)]
    df = spark.createDataFrame([(1, i, t, b) for i, (t, b) in enumerate(breaches)], "stream_id long, event_id long, capture_us long, breach boolean")
    found = [(r.alert, r.active) for r in folds.alerts_with_cooldown(df, 100).orderBy("event_id").collect()]
    assert found == [("raised", True), (None, True), ("resolved", False), (None, False), (None, False), ("raised", True), ("resolved", False), ("raised", True)]
