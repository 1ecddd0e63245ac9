"""Streaming jobs and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.rules import half_up
from tessella.operators.runs import merge_runs
from tessella.plans import q_eval  # noqa: F401  (brings the video_frames relation)
from tessella.plans.registry import query
from tessella.plans.relations import det, rel, with_recursive, with_views
from tessella.session import scratch
from tessella.streaming import metrics, tracker, videos


@query(
    "T01_streaming_request_metrics",
    """SELECT date_trunc('day', ts) AS window_start, event_type AS module, count(*) AS n, CAST(sum(CAST(user_id % 10 < 8 AS INT)) AS BIGINT) AS success, round(sum(value), 4) AS total_ms
FROM events GROUP BY ALL""",
)
def t01(spark, sf):
    """Events as log lines through a stream; the final state is read back."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_type").alias("module"), F.col("value").alias("duration_ms"),
        F.when(F.col("user_id") % 10 < 8, "success").otherwise("error").alias("status"),
    ))
    root = scratch(spark)
    metrics.run_to_folder(metrics.windowed_metrics(events.select(line.alias("value"))), f"{root}/result", f"{root}/state")
    return spark.read.parquet(f"{root}/result").select("window_start", "module", "n", "success", half_up("total_ms", 4).alias("total_ms"))


def _frames(spark, sf):
    return rel(spark, sf, "video_frames").withColumnRenamed("track_id", "det_id").withColumn("score", F.col("score") / 100000)


@query("T02_association")
def t02(spark, sf):
    return tracker.track(_frames(spark, sf), tracker.Settings(iou=0.4, iou_track=0.5, new_score=0.3)).select("video_id", "frame", "obj_id", "det_id", "event")


@query("T03_life_cycle")
def t03(spark, sf):
    t = tracker.track(_frames(spark, sf), tracker.Settings(iou=0.4))
    return t.select("video_id", "frame", "obj_id", "keep_alive", "suppressed", "removed")


@query("T06_delayed_emission")
def t06(spark, sf):
    return tracker.track(_frames(spark, sf), tracker.Settings(iou=0.4, emit_delay=4)).select("video_id", "frame", "obj_id", "x1", "y1", "x2", "y2")


def stream_of(spark, frames, folder: str, parts: int = 3):
    """A stream of frames in ``parts`` steps of time. Videos of even id end without a last row; a row an hour later only tells the time."""
    files = spark.sparkContext.defaultParallelism
    # Written once: every step, the ends and the clock would derive the frames anew.
    frames.write.parquet(f"{folder}_frames")
    frames = spark.read.schema(frames.schema).parquet(f"{folder}_frames")
    end = frames.groupBy("video_id").agg(F.max("frame").alias("end"))
    rows = frames.join(end, "video_id").withColumn("is_last", (F.col("frame") == F.col("end")) & (F.col("video_id") % 2 == 1)).withColumn("at", F.timestamp_seconds(F.col("frame") + 1_000_000_000)).drop("end")
    # Each step holds the frames of a stretch of every video, so none comes late.
    last = frames.agg(F.max("frame")).first()[0] or 0
    rows = rows.withColumn("part", F.floor(F.col("frame") / F.lit(last // parts + 1)))
    for part in range(parts):
        rows.where(F.col("part") == part).drop("part").repartition(files).write.mode("append").parquet(folder)
    clock = rows.drop("part").agg((F.max("at") + F.expr("INTERVAL 1 HOUR")).alias("at")).select(
        *[(F.lit(-1) if c == "video_id" else F.col("at") if c == "at" else F.lit(None)).cast(t).alias(c) for c, t in rows.drop("part").dtypes]
    )
    clock.repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("T02_streamed_tracking")
def t02_streamed(spark, sf):
    """The tracker over a stream of all videos, half of which a timer ends; what it has written is read back."""
    root = scratch(spark)
    stream = stream_of(spark, _frames(spark, sf), f"{root}/in")
    tracked = videos.track_stream(stream, tracker.Settings(iou=0.4, emit_delay=4), "at")
    job = tracked.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(tracker.OUTPUT).parquet(f"{root}/out").select("video_id", "frame", "obj_id", "det_id", "event", "keep_alive")


@query(
    "T04_confirmation",
    with_views("det", "video_frames")
    + """, m AS (SELECT video_id, track_id, frame, frame - row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS isl FROM video_frames WHERE score > 60000),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id, isl ORDER BY frame) AS k FROM m)
SELECT video_id, track_id, min(frame) AS confirmed_at FROM r WHERE k >= 3 GROUP BY video_id, track_id""",
)
def t04(spark, sf):
    return tracker.confirmations(rel(spark, sf, "video_frames").where("score > 60000"), ["video_id", "track_id"], 3)


@query(
    "T05_recent_occlusion",
    with_views("det", "video_frames")
    + """, o AS (SELECT video_id, frame, track_id AS obj_id, x1, y1, x2, y2, coalesce(max(CASE WHEN score < 50000 THEN frame END) OVER (PARTITION BY video_id, track_id ORDER BY frame), -1) AS lo FROM video_frames),
p AS (SELECT a.video_id, a.frame, CASE WHEN a.lo > b.lo AND b.lo > -1 THEN a.obj_id WHEN b.lo > a.lo AND a.lo > -1 THEN b.obj_id END AS obj_id FROM o a JOIN o b ON a.video_id = b.video_id AND a.frame = b.frame AND a.obj_id < b.obj_id
  WHERE greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)
    / (400 - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) >= 0.5)
SELECT DISTINCT video_id, frame, obj_id FROM p WHERE obj_id IS NOT NULL""",
)
def t05(spark, sf):
    f = rel(spark, sf, "video_frames").withColumnRenamed("track_id", "obj_id").withColumn("occluded", F.col("score") < 50000)
    return tracker.suppress_recently_occluded(f, ["video_id"], 0.5)


@query(
    "X07_merge_runs",
    with_recursive("det")
    + """, items AS (SELECT image_id, det_id, x1 * 4 AS x1, y1 * 6 AS y1, x1 * 4 + 5 AS x2, y1 * 6 + 4 AS y2 FROM det), ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x1, y1, det_id) AS rk FROM items),
walk AS (SELECT image_id, rk, 1 AS run, x1, y1, x2, y2, 1 AS members FROM ranked WHERE rk = 1
  UNION ALL SELECT r.image_id, r.rk, CASE WHEN hit THEN w.run ELSE w.run + 1 END, CASE WHEN hit THEN least(w.x1, r.x1) ELSE r.x1 END, CASE WHEN hit THEN least(w.y1, r.y1) ELSE r.y1 END,
    CASE WHEN hit THEN greatest(w.x2, r.x2) ELSE r.x2 END, CASE WHEN hit THEN greatest(w.y2, r.y2) ELSE r.y2 END, CASE WHEN hit THEN w.members + 1 ELSE 1 END
  FROM (SELECT w.*, r.rk AS nrk, r.x1 <= w.x2 AND r.y1 <= w.y2 AND r.x2 >= w.x1 AND r.y2 >= w.y1 AS hit FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rk = w.rk + 1) w
    JOIN ranked r ON r.image_id = w.image_id AND r.rk = w.nrk)
SELECT image_id, x1, y1, x2, y2, CAST(members AS BIGINT) AS members FROM (SELECT *, row_number() OVER (PARTITION BY image_id, run ORDER BY rk DESC) AS rn FROM walk) WHERE rn = 1""",
)
def x07(spark, sf):
    d = det(spark, sf).selectExpr("image_id", "det_id", "x1 * 4 AS x1", "y1 * 6 AS y1", "x1 * 4 + 5 AS x2", "y1 * 6 + 4 AS y2")
    return merge_runs(d, ["image_id"], "det_id")
