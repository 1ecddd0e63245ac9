"""Perfect predictions score 1; stream and batch agree."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import assign as asg, evalmetrics as ev
from tessella.operators.teta import teta
from tessella.session import scratch
from tessella.streaming import metrics, tracker, videos

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    from tessella.plans import load
    from tessella.plans.relations import rel
    from tessella.session import cut

    load()
    return cut(rel(spark, SF, "video_frames"))


def test_perfect_tracking(frames):
    f = frames.withColumnRenamed("frame", "t").withColumn("x1", F.col("track_id") * 30.0).withColumn("x2", F.col("track_id") * 30.0 + 20)
    g, k = f.withColumnRenamed("track_id", "gt_id"), f.withColumnRenamed("track_id", "trk_id")
    pairs = ev.iou_pairs(g, k, ["video_id", "t"], "gt_id", "trk_id").withColumnRenamed("iou", "sim")
    h = ev.hota(g, k, pairs, "video_id")
    assert h.where("abs(hota - 1) > 1e-9 OR abs(loc_a - 1) > 1e-9 OR fn <> 0 OR fp <> 0").isEmpty()
    total = ev.combine_sequences(h, ["alpha"])
    assert total.where("abs(hota - 1) > 1e-9").isEmpty() and total.count() == 19
    c = lambda d, i: d.withColumn("category_id", F.col(i) % 3)
    t = teta(c(g, "gt_id"), c(k, "trk_id"), pairs, "video_id")
    assert t.where("abs(teta - 1) > 1e-9").isEmpty() and not t.isEmpty()


def test_perfect_detection(frames):
    d = frames.where("track_id % 4 = 0").selectExpr(
        "video_id * 100 + frame AS image_id", "track_id AS det_id", "track_id * 30D AS x1", "y1", "track_id * 30D + 20 AS x2", "y2", "score"
    )
    g = d.withColumnRenamed("det_id", "gt_id")
    pairs = ev.iou_pairs(g, d, ["image_id"])
    matches = asg.assign(pairs, ["image_id"], "gt_id", "det_id", "iou")
    s = ev.dataset_scores(ev.image_scores(d.select("image_id").distinct(), g, d, matches, ["image_id"]))
    assert s.where("fp <> 0 OR fn <> 0 OR f1 < 0.999").isEmpty() and s.count() == 10
    hits = ev.greedy_matches(pairs.withColumn("is_crowd", F.lit(False)), d, ["image_id"])
    ap = ev.average_precision(hits, g)
    assert ap.where("abs(ap - 1) > 1e-9 OR abs(ar - 1) > 1e-9").isEmpty() and ap.count() == 10


def test_average_precision_by_hand(spark):
    rows = spark.createDataFrame([(1, 0.9, 50, 1), (2, 0.8, 50, 0), (3, 0.7, 50, 1), (4, 0.6, 50, None)], "det_id long, score double, threshold int, hit int")
    # Recall 0.5 at precision 1, recall 1 at precision 2/3: 51 points at 1, 50 at 2/3.
    r = ev.average_precision(rows, spark.range(2), buckets=4).first()
    assert r.ap == pytest.approx((51 + 50 * 2 / 3) / 101) and r.ar == 1.0


def test_greedy_match_takes_next_best(spark):
    dt = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7)], "image_id long, det_id long, score double")
    pairs = spark.createDataFrame(
        [(0, 10, 1, 0.9, False), (0, 11, 1, 0.6, False), (0, 10, 2, 0.95, False), (0, 11, 2, 0.55, False), (0, 12, 3, 0.7, True)],
        "image_id long, gt_id long, det_id long, iou double, is_crowd boolean",
    )
    got = {(r.det_id, r.threshold): r.hit for r in ev.greedy_matches(pairs, dt, ["image_id"], steps=[50, 60]).collect()}
    assert got == {(1, 50): 1, (2, 50): 1, (3, 50): None, (1, 60): 1, (2, 60): 0, (3, 60): None}


def test_unmatched_track_is_removed(spark):
    rows = [(0, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0)] + [(0, f, 2, 0.9, 100.0 * f, 50.0, 100.0 * f + 10, 60.0) for f in range(1, 4)]
    d = spark.createDataFrame(rows, "video_id long, frame long, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    out = tracker.track(d, tracker.Settings(start_delay=10, unmatched_limit=3)).where("obj_id = 0").orderBy("frame").collect()
    assert [(r.frame, r.event, r.removed) for r in out] == [(0, "new", False), (1, "unmatched", False), (2, "unmatched", False), (3, "unmatched", True)]


def test_delayed_emission_hides_removed(spark):
    rows = [(0, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0)] + [(0, f, 2, 0.9, 200.0, 50.0, 210.0, 60.0) for f in range(0, 6)]
    d = spark.createDataFrame(rows, "video_id long, frame long, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    out = tracker.track(d, tracker.Settings(start_delay=10, unmatched_limit=3, emit_delay=4))
    assert sorted((r.frame, r.obj_id) for r in out.collect()) == [(f, 1) for f in range(6)]


def test_stream_equals_batch(spark, frames):
    cfg = tracker.Settings(iou=0.4, emit_delay=3)
    d = frames.where("video_id < 4").withColumnRenamed("track_id", "det_id").withColumn("score", F.col("score") / 100000)
    end = d.groupBy("video_id").agg(F.max("frame").alias("end"))
    d = d.join(end, "video_id").withColumn("is_last", F.col("frame") == F.col("end")).drop("end")
    root = scratch(spark)
    for part in range(3):  # three files, frames in order
        d.where(F.floor(F.col("frame") / 7) == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = videos.track_stream(stream, cfg).writeStream.format("parquet").option("checkpointLocation", f"{root}/ck").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = tracker.COLUMNS
    got = sorted(map(tuple, spark.read.schema(tracker.OUTPUT).parquet(f"{root}/out").select(*cols).collect()), key=str)
    want = sorted(map(tuple, tracker.track(d, cfg).select(*cols).collect()), key=str)
    assert want and got == want


def test_windowed_metrics_batch(spark):
    from tessella.plans.relations import rel

    ev_ = rel(spark, SF, "events")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_type").alias("module"), F.col("value").alias("duration_ms")))
    m = metrics.windowed_metrics(ev_.select(line.alias("value")))
    assert m.agg(F.sum("n")).first()[0] == ev_.count()


def test_permutation_invariance(spark, crowd):
    from tessella.operators import greedy

    a = greedy.greedy_keep(crowd, ["image_id"], "det_id", [-F.col("score")], greedy.iou_above(0.5))
    b = greedy.greedy_keep(crowd.repartition(7, "score"), ["image_id"], "det_id", [-F.col("score")], greedy.iou_above(0.5))
    assert sorted(r.det_id for r in a.collect()) == sorted(r.det_id for r in b.collect())


def test_frames_without_detections_are_stepped(spark):
    rows = [(0, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 5, 2, 0.9, 50.0, 0.0, 60.0, 10.0)]
    d = spark.createDataFrame(rows, "video_id long, frame long, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    cfg = tracker.Settings(start_delay=10, unmatched_limit=3)
    first = {r.frame: r for r in tracker.track(d, cfg).where("obj_id = 0").collect()}
    # Missed in frames 1, 2 and 3, and removed on the third.
    assert sorted(first) == [0, 1, 2, 3] and first[3].removed and not first[2].removed
    every = spark.range(8).selectExpr("0L AS video_id", "id AS frame")
    second = tracker.track(d, cfg, every).where("obj_id = 1").orderBy("frame").collect()
    assert [r.frame for r in second] == [5, 6, 7] and second[-1].keep_alive < second[0].keep_alive


def test_late_frames_of_a_stream(spark, tmp_path):
    schema = "video_id long, frame long, det_id long, score double, x1 double, y1 double, x2 double, y2 double, is_last boolean"
    rows = [[(0, 0, 1), (0, 2, 3)], [(0, 1, 2), (0, 3, 4)], [(0, 0, 9), (0, 6, 7)], [(0, 7, 8)]]
    for i, part in enumerate(rows):
        full = [(v, f, d, 0.9, 0.0, 0.0, 10.0, 10.0, f == 7) for v, f, d in part]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    cfg = tracker.Settings(reorder=1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = videos.track_stream(stream, cfg).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema(tracker.OUTPUT).parquet(f"{tmp_path}/out")
    late = [(r.frame, r.det_id) for r in got.where("event = 'late'").collect()]
    assert late == [(0, 9)]
    whole = spark.createDataFrame([(0, f, d, 0.9, 0.0, 0.0, 10.0, 10.0) for part in rows for _, f, d in part if d != 9], schema.replace(", is_last boolean", ""))
    cols = ["frame", "obj_id", "det_id", "event"]
    assert sorted(map(tuple, got.where("event <> 'late'").select(*cols).collect()), key=str) == sorted(map(tuple, tracker.track(whole, cfg).select(*cols).collect()), key=str)


def test_a_silent_video_ends_by_timer(spark, frames, tmp_path):
    from tessella.plans.q_streaming import stream_of

    cfg = tracker.Settings(iou=0.4, emit_delay=3, reorder=1)
    d = frames.where("video_id < 5").withColumnRenamed("track_id", "det_id").withColumn("score", F.col("score") / 100000)
    stream = stream_of(spark, d, f"{tmp_path}/in")
    q = videos.track_stream(stream, cfg, "at").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = tracker.COLUMNS
    got = sorted(map(tuple, spark.read.schema(tracker.OUTPUT).parquet(f"{tmp_path}/out").select(*cols).collect()), key=str)
    want = sorted(map(tuple, tracker.track(d, cfg).select(*cols).collect()), key=str)
    assert {r[0] for r in want} >= {0, 1, 2} and got == want
    left = spark.read.format("statestore").option("stateVarName", "clock").load(f"{tmp_path}/ck")
    assert left.where("key.video_id >= 0").isEmpty()


def test_precision_of_packed_rows(spark):
    """All thresholds of a detection in one row: as by a plain walk, ignored rows and a threshold without hits included."""
    import random

    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 6)), [rng.choice([1, 0, 0, None]), rng.choice([1, 0, None]), 0, None]) for i in range(60)]
    packed = spark.createDataFrame(rows, "det_id long, score double, hits array<int>")
    got = {r.threshold: (r.ap, r.ar) for r in ev.packed_precision(packed, spark.range(40), steps=[50, 60, 70, 80], buckets=5).collect()}
    want = {}
    for i, step in enumerate([50, 60, 70]):
        tp, seen, curve = 0, 0, []
        for _, _, hits in sorted(rows, key=lambda r: (-r[1], r[0])):
            if hits[i] is not None:
                tp, seen = tp + hits[i], seen + 1
                curve.append((tp * 100 // 40, tp / seen))
        want[step] = (sum(max([p for at, p in curve if at >= k], default=0) for k in range(101)) / 101, tp / 40)
    assert got.keys() == want.keys()
    for step in want:
        assert got[step] == pytest.approx(want[step])


def test_images_are_dealt_once(spark):
    """Counting per image needs no shuffle beyond the one that deals the detections."""
    from tessella.plans.relations import det

    plan = det(spark, "/root/testdata/sf0.001").groupBy("image_id").agg(F.max("det_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
