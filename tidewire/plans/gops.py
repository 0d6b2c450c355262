"""Queries over groups of pictures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import gops as op
from tidewire.sources.projections import packets

from .base import WITH, Catalogue

CATALOGUE = Catalogue()
add = CATALOGUE.add

_F = WITH + ", f AS (SELECT *, row_number() OVER (PARTITION BY stream_id, gop_id ORDER BY arrival_idx) - 1 AS pos FROM frames)"
_G = _F + """, g0 AS (SELECT stream_id, gop_id, count(*) AS frames, CAST(sum(size) AS BIGINT) AS total_size, count(*) FILTER (WHERE frame_type = 'IDR') AS i_frames, count(*) FILTER (WHERE frame_type = 'P') AS p_frames, count(*) FILTER (WHERE frame_type = 'B') AS b_frames,
 min(dts) AS start_dts, max(dts) AS end_dts, min(pts) AS start_pts, max(pts) AS end_pts, max(arrival_idx) AS last_idx, string_agg(CASE WHEN frame_type = 'IDR' THEN 'I' ELSE frame_type END, '' ORDER BY arrival_idx) AS pattern FROM f GROUP BY stream_id, gop_id),
g AS (SELECT *, end_pts - start_pts AS duration, CASE WHEN end_pts > start_pts THEN CAST(total_size * 8 * 90000 // (end_pts - start_pts) AS BIGINT) ELSE 0 END AS bitrate FROM g0)
"""
COLS = ["stream_id", "gop_id", "frames", "total_size", "i_frames", "p_frames", "b_frames", "start_dts", "end_dts", "start_pts", "end_pts", "duration", "bitrate", "pattern"]


def frames(spark, sf_dir):
    return op.segmented(packets(spark, sf_dir))


def groups(spark, sf_dir):
    return op.rollup(frames(spark, sf_dir))


@add(115, 167, 168, 217, sql=_G + f"SELECT {', '.join(COLS)} FROM g")
def gop_rollup(spark, sf_dir):
    return groups(spark, sf_dir).select(*COLS)


@add(117, sql=_G + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY gop_id DESC) AS rank FROM g) SELECT stream_id, round(avg(frames), 6) AS avg_frames, round(avg(duration), 6) AS avg_duration, round(sum(i_frames) / CAST(sum(frames) AS DOUBLE), 6) AS i_ratio, round(sum(p_frames) / CAST(sum(frames) AS DOUBLE), 6) AS p_ratio, round(sum(b_frames) / CAST(sum(frames) AS DOUBLE), 6) AS b_ratio FROM r WHERE rank <= 10 GROUP BY stream_id")
def gop_recent_statistics(spark, sf_dir):
    return op.recent_statistics(groups(spark, sf_dir))


@add(118, sql=_G + "SELECT stream_id, gop_id, round(avg(frames) OVER w, 6) AS avg_frames, round(avg(duration) OVER w, 6) AS avg_duration FROM g WINDOW w AS (PARTITION BY stream_id ORDER BY gop_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def gop_running_averages(spark, sf_dir):
    w = Window.partitionBy("stream_id").orderBy("gop_id").rowsBetween(-9, 0)
    return groups(spark, sf_dir).select("stream_id", "gop_id", F.round(F.avg("frames").over(w), 6).alias("avg_frames"), F.round(F.avg("duration").over(w), 6).alias("avg_duration"))


@add(86, 87, 218, sql=_G + ", c AS (SELECT *, duration >= 45000 OR frames >= 120 AS complete, duration >= 180000 OR frames >= 120 AS closed FROM g) SELECT stream_id, gop_id, complete, closed, complete AND i_frames > 0 AS is_complete, complete AND closed AND i_frames > 0 AS can_drop FROM c")
def gop_completion(spark, sf_dir):
    rows = op.completion(groups(spark, sf_dir))
    whole = F.col("complete") & (F.col("i_frames") > 0)
    return rows.select("stream_id", "gop_id", "complete", "closed", whole.alias("is_complete"), (whole & F.col("closed")).alias("can_drop"))


@add(84, 85, 88, sql=_F + ", n AS (SELECT *, lead(frame_type) OVER (PARTITION BY stream_id, gop_id ORDER BY arrival_idx) AS after FROM f) SELECT stream_id, arrival_idx, frame_type = 'IDR' AS keyframe, frame_type IN ('IDR', 'P') AS reference, frame_type = 'B' AS discardable, (size & 3) <> 0 AS flagged, CASE frame_type WHEN 'B' THEN true WHEN 'P' THEN coalesce(after, '') <> 'B' ELSE false END AS can_drop FROM n")
def frame_predicates(spark, sf_dir):
    rows = op.droppable(frames(spark, sf_dir))
    kind = F.col("frame_type")
    return rows.select("stream_id", "arrival_idx", op.is_key().alias("keyframe"), (op.is_key() | (kind == "P")).alias("reference"), (kind == "B").alias("discardable"), (F.col("size").bitwiseAND(3) != 0).alias("flagged"), "can_drop")


@add(90, 91, sql=_F + """, n AS (SELECT *, lead(frame_type) OVER (PARTITION BY stream_id, gop_id ORDER BY arrival_idx) AS after, (event_id % 101) / 100.0 AS p FROM f),
c AS (SELECT *, pos > 0 AND CASE frame_type WHEN 'B' THEN true WHEN 'P' THEN coalesce(after, '') <> 'B' ELSE false END AS inside FROM n)
SELECT stream_id, arrival_idx, NOT (frame_type = 'IDR' AND p < 0.95) AND p > CASE WHEN frame_type = 'B' AND inside THEN 0.5 WHEN frame_type = 'P' AND inside THEN 0.7 WHEN frame_type = 'B' THEN 0.6 WHEN frame_type = 'P' THEN 0.8 ELSE 0.95 END AS drop_frame,
 p >= 0.9 AND (size <= 1000 OR (size * 1.0 / 3000 < 3.0 OR p >= 0.95)) AS drop_gop FROM c""")
def load_shedding(spark, sf_dir):
    rows = op.droppable(frames(spark, sf_dir)).withColumn("p", (F.col("event_id") % 101) / 100.0)
    return rows.select("stream_id", "arrival_idx", op.sheds_frame(F.col("frame_type"), F.col("can_drop"), F.col("pos"), F.col("p")).alias("drop_frame"), op.sheds_group(F.col("p"), F.col("size"), F.lit(3000), 1000).alias("drop_gop"))


@add(221, sql=_F + """, a AS (SELECT *, (stream_id % 5) * 0.11 + 0.5 AS p, dense_rank() OVER (PARTITION BY stream_id ORDER BY gop_id) AS age FROM f), m AS (SELECT *, max(age) OVER (PARTITION BY stream_id) AS n FROM a),
d AS (SELECT *, CASE WHEN p < 0.5 THEN false WHEN p < 0.7 THEN frame_type = 'B' AND age <= 2 WHEN p < 0.85 THEN frame_type = 'B' OR (frame_type = 'P' AND age = 1) WHEN p < 0.95 THEN age = 1 AND frame_type <> 'IDR' WHEN n > 1 THEN age = 1 ELSE frame_type <> 'IDR' END AS dropped FROM m)
SELECT stream_id, count(*) FILTER (WHERE dropped) AS dropped, count(*) FILTER (WHERE NOT dropped) AS kept, CAST(coalesce(sum(size) FILTER (WHERE dropped), 0) AS BIGINT) AS dropped_bytes FROM d GROUP BY stream_id""")
def pressure_shedding(spark, sf_dir):
    rows = op.shed(frames(spark, sf_dir), (F.col("stream_id") % 5) * 0.11 + 0.5)
    return rows.groupBy("stream_id").agg(F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("kept"), F.coalesce(F.sum(F.when(F.col("dropped"), F.col("size"))), F.lit(0).cast("long")).alias("dropped_bytes"))


@add(116, 222, sql=_F + ", k AS (SELECT * FROM f WHERE frame_type <> 'B' AND pos < 8) SELECT stream_id, gop_id, count(*) AS frames, CAST(sum(size) AS BIGINT) AS total_size, max(pts) - min(pts) AS duration FROM k GROUP BY stream_id, gop_id")
def gop_after_drops(spark, sf_dir):
    kept = frames(spark, sf_dir).filter((F.col("frame_type") != "B") & (F.col("pos") < 8))
    return op.rollup(kept).select("stream_id", "gop_id", "frames", "total_size", "duration")


@add(219, 220, sql=_G + """, r AS (SELECT *, row_number() OVER w AS rank, sum(total_size) OVER w AS held, max(start_pts) OVER (PARTITION BY stream_id) AS newest FROM g WINDOW w AS (PARTITION BY stream_id ORDER BY gop_id DESC))
SELECT stream_id, gop_id, rank, frames, total_size FROM r WHERE rank <= 10 AND (held <= 52428800 OR rank = 1) AND start_pts > newest - 2700000""")
def gop_retention(spark, sf_dir):
    return op.retained(groups(spark, sf_dir)).select("stream_id", "gop_id", "rank", "frames", "total_size")


@add(119, sql=_G + "SELECT stream_id, count(*) AS gops, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(total_size) AS BIGINT) AS bytes, min(start_pts) AS oldest_pts, max(end_pts) AS newest_pts, CAST(sum(i_frames) AS BIGINT) AS i_frames FROM g GROUP BY stream_id")
def gop_buffer_statistics(spark, sf_dir):
    return groups(spark, sf_dir).groupBy("stream_id").agg(F.count(F.lit(1)).alias("gops"), F.sum("frames").alias("frames"), F.sum("total_size").alias("bytes"), F.min("start_pts").alias("oldest_pts"), F.max("end_pts").alias("newest_pts"), F.sum("i_frames").alias("i_frames"))


@add(173, 103, sql=_G + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY gop_id DESC) AS n FROM g) SELECT stream_id, gop_id, frames, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY gop_id) AS BIGINT) AS rank FROM r WHERE n <= 5")
def recent_gops(spark, sf_dir):
    newest = op.by_age(groups(spark, sf_dir)).filter("rank <= 5").drop("rank")
    return op.by_age(newest, newest_first=False).select("stream_id", "gop_id", "frames", "rank")


@add(174, 102, sql=_F + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY gop_id DESC, pos) AS n FROM f WHERE frame_type = 'IDR') SELECT stream_id, gop_id, event_id, pts FROM r WHERE n = 1")
def latest_keyframe(spark, sf_dir):
    rows = frames(spark, sf_dir).filter(op.is_key())
    best = Window.partitionBy("stream_id").orderBy(F.desc("gop_id"), "pos")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").select("stream_id", "gop_id", "event_id", "pts")


@add(223, sql=_F + ", b AS (SELECT *, min(CASE WHEN event_id % 29 = 0 THEN pos END) OVER (PARTITION BY stream_id, gop_id) AS bad FROM f) SELECT stream_id, gop_id, count(*) AS kept FROM b WHERE bad IS NULL OR pos < bad GROUP BY stream_id, gop_id")
def corrupted_tails(spark, sf_dir):
    return op.without_tail(frames(spark, sf_dir), F.col("event_id") % 29 == 0).groupBy("stream_id", "gop_id").agg(F.count(F.lit(1)).alias("kept"))


@add(232, 230, 143, sql=_F + """, l AS (SELECT *, lag(dts) OVER w AS before, lag(pts) OVER w AS pts_before FROM f WINDOW w AS (PARTITION BY stream_id, gop_id ORDER BY arrival_idx)),
s AS (SELECT stream_id, gop_id, bool_or(pos = 0 AND frame_type = 'IDR') AS starts_with_key, count(*) FILTER (WHERE dts <= before) AS dts_steps_back, count(*) FILTER (WHERE pts <= pts_before) AS pts_steps_back, count(*) FILTER (WHERE dts <> before + 3000) AS gaps FROM l GROUP BY stream_id, gop_id)
SELECT stream_id, gop_id, starts_with_key, dts_steps_back, pts_steps_back, starts_with_key AND dts_steps_back = 0 AS valid, CAST(round(greatest(0.0, 1.0 - CASE WHEN starts_with_key THEN 0.0 ELSE 0.3 END - gaps * 0.1), 6) AS DOUBLE) AS health FROM s""")
def gop_validation(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("before", F.lag("dts").over(op.in_gop())).withColumn("pts_before", F.lag("pts").over(op.in_gop()))
    out = rows.groupBy("stream_id", "gop_id").agg(F.bool_or((F.col("pos") == 0) & op.is_key()).alias("starts_with_key"), F.count_if(F.col("dts") <= F.col("before")).alias("dts_steps_back"), F.count_if(F.col("pts") <= F.col("pts_before")).alias("pts_steps_back"), F.count_if(F.col("dts") != F.col("before") + 3000).alias("gaps"))
    health = F.greatest(F.lit(0.0), 1.0 - F.when(F.col("starts_with_key"), 0.0).otherwise(0.3) - F.col("gaps") * 0.1)
    return out.select("stream_id", "gop_id", "starts_with_key", "dts_steps_back", "pts_steps_back", (F.col("starts_with_key") & (F.col("dts_steps_back") == 0)).alias("valid"), F.round(health, 6).alias("health"))


@add(149, 169, sql=WITH + """, k AS (SELECT stream_id, arrival_idx, arrival_idx - lag(arrival_idx) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS gap FROM packets WHERE frame_type = 'IDR'),
a AS (SELECT *, avg(gap) OVER (PARTITION BY stream_id ORDER BY arrival_idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean FROM k) SELECT stream_id, arrival_idx, round(mean, 6) AS mean_interval, CAST(arrival_idx + coalesce(floor(mean), 30) AS BIGINT) AS predicted FROM a""")
def keyframe_intervals(spark, sf_dir):
    w = Window.partitionBy("stream_id").orderBy("arrival_idx")
    keys = packets(spark, sf_dir).filter(op.is_key()).withColumn("gap", F.col("arrival_idx") - F.lag("arrival_idx").over(w)).withColumn("mean", F.avg("gap").over(w.rowsBetween(-99, 0)))
    return keys.select("stream_id", "arrival_idx", F.round("mean", 6).alias("mean_interval"), (F.col("arrival_idx") + F.coalesce(F.floor("mean"), F.lit(30))).alias("predicted"))


@add(105, sql=_F + ", t AS (SELECT stream_id, pts + 1500 AS target FROM f WHERE event_id % 50 = 0), k AS (SELECT stream_id, pts, event_id FROM f WHERE frame_type = 'IDR') SELECT t.stream_id, t.target, k.pts AS key_pts, k.event_id AS key_event FROM t ASOF LEFT JOIN k ON t.stream_id = k.stream_id AND t.target >= k.pts")
def seek_to_keyframe(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return op.keyframe_at(rows.filter("event_id % 50 = 0").select("stream_id", (F.col("pts") + 1500).alias("target")), rows)


@add(106, 107, sql=WITH + """, l AS (SELECT *, lag(event_id) OVER w AS before_id, lead(event_id) OVER w AS after_id, lag(event_id) OVER (PARTITION BY stream_id, frame_type ORDER BY dts) AS same_id FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY dts))
SELECT stream_id, event_id, before_id, after_id, same_id AS same_type_id FROM l""")
def surrounding_frames(spark, sf_dir):
    w, same = Window.partitionBy("stream_id").orderBy("dts"), Window.partitionBy("stream_id", "frame_type").orderBy("dts")
    return packets(spark, sf_dir).select("stream_id", "event_id", F.lag("event_id").over(w).alias("before_id"), F.lead("event_id").over(w).alias("after_id"), F.lag("event_id").over(same).alias("same_type_id"))


@add(253, 104, sql=WITH + """, l AS (SELECT stream_id, dts, lead(dts) OVER w AS nd, size, lead(size) OVER w AS ns FROM packets WINDOW w AS (PARTITION BY stream_id ORDER BY dts)),
m AS (SELECT *, unnest(range(dts + 3000, nd, 3000)) AS missing_dts FROM l WHERE nd - dts > 3000) SELECT stream_id, missing_dts, dts AS before_dts, nd AS after_dts, (size + ns) // 2 AS size FROM m""")
def frame_recovery(spark, sf_dir):
    return op.missing_frames(packets(spark, sf_dir))


@add(108, 144, sql=_G + """, p AS (SELECT * FROM g WHERE frames < 12), c AS (SELECT p.stream_id, p.gop_id AS partial_id, w.gop_id, round((1 - abs(p.frames - w.frames) / CAST(greatest(p.frames, w.frames) AS DOUBLE) + CASE WHEN p.duration > 0 AND w.duration > 0 THEN 1 - abs(p.duration - w.duration) / CAST(greatest(p.duration, w.duration) AS DOUBLE) ELSE 0 END) / 2, 6) AS score
 FROM p JOIN g w ON p.stream_id = w.stream_id AND w.gop_id BETWEEN p.gop_id - 10 AND p.gop_id - 1),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, partial_id ORDER BY score DESC, gop_id DESC) AS n FROM c WHERE score >= 0.5) SELECT stream_id, partial_id, gop_id, score FROM r WHERE n = 1""")
def gop_similarity(spark, sf_dir):
    rows = groups(spark, sf_dir)
    return op.similar(rows.filter("frames < 12"), rows)


@add(185, sql=_F + """, t AS (SELECT stream_id, gop_id + 1 AS gop_id, pos, size FROM f), p AS (SELECT stream_id, gop_id, pos, size FROM f WHERE event_id % 13 <> 0)
SELECT stream_id, gop_id, pos, size, 'partial' AS origin FROM p UNION ALL SELECT t.stream_id, t.gop_id, t.pos, t.size, 'template' FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.stream_id = t.stream_id AND p.gop_id = t.gop_id AND p.pos = t.pos)""")
def gop_merge(spark, sf_dir):
    rows = frames(spark, sf_dir).select("stream_id", "gop_id", "pos", "size", "event_id")
    partial, template = rows.filter("event_id % 13 <> 0").drop("event_id"), rows.drop("event_id").withColumn("gop_id", F.col("gop_id") + 1)
    return partial.withColumn("origin", F.lit("partial")).unionByName(template.join(partial, ["stream_id", "gop_id", "pos"], "left_anti").withColumn("origin", F.lit("template")))


@add(89, sql=_F + """, r AS (SELECT stream_id, gop_id, event_id, unnest([lag(event_id) OVER w, lag(event_id, 2) OVER w]) AS ref FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_idx))
SELECT r.stream_id, r.gop_id, count(*) FILTER (WHERE r.ref IS NOT NULL AND f.event_id IS NULL) AS open_references FROM r LEFT JOIN f ON f.stream_id = r.stream_id AND f.gop_id = r.gop_id AND f.event_id = r.ref GROUP BY r.stream_id, r.gop_id""")
def gop_references(spark, sf_dir):
    rows = frames(spark, sf_dir)
    rows = rows.withColumn("one", F.lag("event_id").over(op.arrival())).withColumn("two", F.lag("event_id", 2).over(op.arrival()))
    refs = rows.select("stream_id", "gop_id", F.explode(F.array("one", "two")).alias("ref"))
    have = rows.select("stream_id", "gop_id", F.col("event_id").alias("ref"), F.lit(True).alias("held"))
    return refs.join(have, ["stream_id", "gop_id", "ref"], "left").groupBy("stream_id", "gop_id").agg(F.count_if(F.col("ref").isNotNull() & F.col("held").isNull()).alias("open_references"))


@add(180, 181, sql=_F + ", c AS (SELECT *, CASE WHEN frame_type = 'IDR' THEN 1.0 ELSE 0.15 * (size % 2) + 0.7 * CAST(frame_type = 'P' AND size % 5 = 0 AS INTEGER) END AS confidence FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, gop_id ORDER BY frame_type = 'IDR' DESC, confidence DESC, pos) AS n FROM c WHERE confidence >= 0.7) SELECT stream_id, gop_id, event_id, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM r WHERE n = 1")
def recovery_points(spark, sf_dir):
    conf = F.when(op.is_key(), 1.0).otherwise(0.15 * (F.col("size") % 2) + 0.7 * ((F.col("frame_type") == "P") & (F.col("size") % 5 == 0)).cast("int"))
    rows = frames(spark, sf_dir).withColumn("confidence", F.round(conf, 6)).filter("confidence >= 0.7")
    best = Window.partitionBy("stream_id", "gop_id").orderBy(op.is_key().desc(), F.desc("confidence"), "pos")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").select("stream_id", "gop_id", "event_id", "confidence")


@add(170, sql=WITH + ", l AS (SELECT stream_id, arrival_idx, pts < lag(pts) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS back FROM packets WHERE arrival_idx <= 30) SELECT stream_id, coalesce(bool_or(back), false) AS has_b_frames FROM l GROUP BY stream_id")
def b_frame_detection(spark, sf_dir):
    rows = packets(spark, sf_dir).filter("arrival_idx <= 30").withColumn("back", F.col("pts") < F.lag("pts").over(op.arrival()))
    return rows.groupBy("stream_id").agg(F.coalesce(F.bool_or("back"), F.lit(False)).alias("has_b_frames"))


@add(127, 175, sql=WITH + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pts DESC) AS n FROM packets) SELECT stream_id, frame_type, count(*) AS n, max(pts) AS newest_pts FROM r WHERE n <= 100 GROUP BY stream_id, frame_type")
def frame_preview(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("pts")))).filter("n <= 100")
    return rows.groupBy("stream_id", "frame_type").agg(F.count(F.lit(1)).alias("n"), F.max("pts").alias("newest_pts"))


@add(71, 145, 146, sql=WITH + """, e AS (SELECT *, sum(size) OVER (PARTITION BY stream_id, frame_type) // count(*) OVER (PARTITION BY stream_id, frame_type) AS expected FROM packets)
SELECT stream_id, arrival_idx, size * 8 * 90000 // 3000 AS bitrate, CAST(expected AS BIGINT) AS expected, CAST(round(CASE WHEN event_id % 29 = 0 THEN 0.1 ELSE 1.0 END * CASE WHEN expected > 0 AND (size / CAST(expected AS DOUBLE) < 0.5 OR size / CAST(expected AS DOUBLE) > 2.0) THEN 0.7 ELSE 1.0 END * CASE WHEN pts < dts THEN 0.5 ELSE 1.0 END, 6) AS DOUBLE) AS quality FROM e""")
def frame_quality(spark, sf_dir):
    same = Window.partitionBy("stream_id", "frame_type")
    rows = packets(spark, sf_dir).withColumn("total", F.sum("size").over(same)).withColumn("n", F.count(F.lit(1)).over(same)).withColumn("expected", F.expr("total div n"))
    ratio = F.col("size") / F.col("expected")
    score = F.when(F.col("event_id") % 29 == 0, 0.1).otherwise(1.0) * F.when((F.col("expected") > 0) & ((ratio < 0.5) | (ratio > 2.0)), 0.7).otherwise(1.0) * F.when(F.col("pts") < F.col("dts"), 0.5).otherwise(1.0)
    return rows.select("stream_id", "arrival_idx", F.expr("size * 8 * 90000 div 3000").alias("bitrate"), "expected", F.round(score, 6).alias("quality"))


@add(148, sql=WITH + """, d AS (SELECT stream_id, dts - lag(dts) OVER (PARTITION BY stream_id ORDER BY dts) AS step FROM packets), c AS (SELECT stream_id, step, count(*) AS n FROM d WHERE step BETWEEN 750 AND 9000 GROUP BY stream_id, step),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, step) AS k FROM c) SELECT stream_id, step AS frame_duration, n FROM r WHERE k = 1""")
def modal_frame_duration(spark, sf_dir):
    rows = packets(spark, sf_dir).select("stream_id", (F.col("dts") - F.lag("dts").over(Window.partitionBy("stream_id").orderBy("dts"))).alias("step")).filter("step between 750 and 9000")
    counted = rows.groupBy("stream_id", "step").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("stream_id").agg(F.max(F.struct("n", (-F.col("step")).alias("s"))).alias("m")).select("stream_id", (-F.col("m.s")).alias("frame_duration"), F.col("m.n").alias("n"))


@add(172, sql=WITH + """, d AS (SELECT *, max(dts) OVER (PARTITION BY stream_id ORDER BY arrival_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS sent FROM packets)
SELECT stream_id, event_id, dts, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY dts) AS BIGINT) AS out_idx FROM d WHERE sent IS NULL OR dts > sent""")
def decode_order(spark, sf_dir):
    """Frames by decode time, without those that come after a later frame must have left a buffer of
    depth three."""
    sent = F.max("dts").over(op.arrival().rowsBetween(Window.unboundedPreceding, -4))
    rows = packets(spark, sf_dir).withColumn("sent", sent).filter(F.col("sent").isNull() | (F.col("dts") > F.col("sent")))
    return rows.select("stream_id", "event_id", "dts", F.row_number().over(Window.partitionBy("stream_id").orderBy("dts")).cast("long").alias("out_idx"))


@add(208, 209, sql=WITH + """, s AS (SELECT *, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival_idx) AS frame_no FROM packets)
SELECT stream_id, CAST(frame_no AS BIGINT) AS frame_no, count(*) AS packets, CAST(sum(size) AS BIGINT) AS size, max(capture_us) - min(capture_us) > 200000 AS corrupted FROM s WHERE frame_no > 0 GROUP BY stream_id, frame_no""")
def frame_assembly(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("frame_no", F.sum((F.col("event_id") % 3 == 0).cast("int")).over(op.arrival())).filter("frame_no > 0")
    return rows.groupBy("stream_id", "frame_no").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("size"), (F.max("capture_us") - F.min("capture_us") > 200_000).alias("corrupted"))
