"""Evaluation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tessella.operators import assign as asg, evalmetrics as ev, greedy
from tessella.functions.boxes import box
from tessella.functions.rules import half_up
from tessella.operators.boxlists import box_lists
from tessella.plans.q_windows import video_tracks
from tessella.plans.registry import query
from tessella.plans.relations import SQL, det, gt, rel, with_recursive, with_views
from tessella.session import cut


def _sets(spark, sf):
    """Images, ground truth, and the predictions over the score threshold."""
    d = det(spark, sf)
    return d.select("image_id").distinct(), gt(spark, sf), d.where("score >= 50000")


@query("X08_assignment")
def x08(spark, sf):
    """One-to-one pairs of ground truth and predictions with the largest total IoU per image."""
    _, g, d = _sets(spark, sf)
    return asg.assign(box_lists(g, d, ["image_id"], ["gt_id"], ["det_id"]), ["image_id"], "gt_id", "det_id", "iou")


def _rows_sql(truth: str) -> str:
    """Per image and threshold: counts, hits, F1 and flags against one set of ground truth, as CTEs."""
    return f"""o_{truth} AS (SELECT a.image_id, a.det_id, (least(a.x2, g.x2) - greatest(a.x1, g.x1)) * (a.y2 - a.y1) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS s FROM apart a JOIN {truth} g ON g.gt_id = a.det_id WHERE score >= 50000),
h_{truth} AS (SELECT image_id, threshold, count(*) AS tp FROM (SELECT image_id, i / (2 * s - i) AS iou, unnest(range(50, 100, 5)) AS threshold FROM o_{truth} WHERE i > 0) WHERE iou >= threshold / 100 GROUP BY ALL),
c_{truth} AS (SELECT i.image_id, coalesce(g.n, 0) AS n_gt, coalesce(d.n, 0) AS n_dt, unnest(range(50, 100, 5)) AS threshold FROM (SELECT DISTINCT image_id FROM apart) i
  LEFT JOIN (SELECT image_id, count(*) AS n FROM {truth} GROUP BY image_id) g ON g.image_id = i.image_id
  LEFT JOIN (SELECT image_id, count(*) AS n FROM apart WHERE score >= 50000 GROUP BY image_id) d ON d.image_id = i.image_id),
u_{truth} AS (SELECT c.*, coalesce(tp, 0) AS tp, n_dt - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn FROM c_{truth} c LEFT JOIN h_{truth} h ON h.image_id = c.image_id AND h.threshold = c.threshold),
p_{truth} AS (SELECT *, tp / (tp + fp + 1e-4) AS p, tp / (tp + fn + 1e-4) AS rc FROM u_{truth}),
rows_{truth} AS (SELECT *, CASE WHEN n_gt > 0 OR n_dt > 0 THEN 2 * p * rc / (p + rc + 1e-4) END AS f1 FROM p_{truth})"""


_ROWS = with_views("det", "apart", "gt_apart", "gt_other") + ", " + _rows_sql("gt_apart") + ", rows_ AS (SELECT image_id, CAST(threshold AS INT) AS threshold, n_gt, n_dt, tp, fp, fn, f1 FROM rows_gt_apart)\n"


def _rows(spark, sf, truth: str = "gt_apart", found: str = "apart"):
    """Scores of the assigned pairs, over all images, ground truth and predictions of half the top score."""
    return _rows_of_sets(spark, sf, [truth], found).drop("gt_set")


def _rows_of_sets(spark, sf, truths: list[str], found: str = "apart"):
    """``_rows`` against several sets of ground truth, numbered in ``gt_set``: all their boxes are listed and assigned at once."""
    every = rel(spark, sf, found)
    d = every.where("score >= 50000")
    sets = [rel(spark, sf, t).withColumn("gt_set", F.lit(k)) for k, t in enumerate(truths)]
    g = reduce(DataFrame.unionByName, [s.select("image_id", "gt_id", "x1", "y1", "x2", "y2", "gt_set") for s in sets])
    matches = asg.assign(box_lists(g, d, ["image_id"], ["gt_id", "gt_set"], ["det_id"]), ["image_id", "gt_set"], "gt_id", "det_id", "iou")
    images = every.select("image_id").distinct()
    rows = [ev.image_scores(images, s, d, matches.where(F.col("gt_set") == k), ["image_id"]).withColumn("gt_set", F.lit(k)) for k, s in enumerate(sets)]
    return reduce(DataFrame.unionByName, rows)


@query(
    "A07_image_scores",
    _ROWS
    + """SELECT image_id, threshold, tp, fp, fn, round(f1, 9) AS f1, CAST(n_gt > 0 AND n_dt > 0 AS INT) AS il_tp, CAST(n_gt = 0 AND n_dt > 0 AS INT) AS il_fp,
  CAST(n_gt = 0 AND n_dt = 0 AS INT) AS il_tn, CAST(n_gt > 0 AND n_dt = 0 AS INT) AS il_fn FROM rows_""",
)
def a07(spark, sf):
    return _rows(spark, sf).select("image_id", "threshold", "tp", "fp", "fn", half_up("f1", 9).alias("f1"), "il_tp", "il_fp", "il_tn", "il_fn")


# The queries named _crowded run on det and gt as they lie, where boxes have rivals; SQL cannot say those, so they have no
# oracle and are tested by brute force. Those of the same name without it are checked by SQL on boxes drawn apart.
_SCORES = ["precision", "recall", "f1", "positive_micro_f1", "positive_macro_f1", "il_mcc", "cgf1_micro"]


@query("A07_image_scores_crowded")
def a07_crowded(spark, sf):
    return _rows(spark, sf, "gt", "det").select("image_id", "threshold", "tp", "fp", "fn", half_up("f1", 9).alias("f1"), "il_tp", "il_fp", "il_tn", "il_fn")


@query("A08_dataset_scores_crowded")
def a08_crowded(spark, sf):
    return ev.dataset_scores(_rows(spark, sf, "gt", "det")).select("threshold", "tp", "fp", "fn", *[half_up(n, 9).alias(n) for n in _SCORES])


_DATASET = _ROWS + """, a AS (SELECT threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(CASE WHEN n_gt > 0 THEN fp ELSE 0 END) AS pfp,
  sum(CASE WHEN n_gt > 0 AND n_dt > 0 THEN f1 ELSE 0 END) AS macro, sum(CASE WHEN n_gt > 0 AND n_dt > 0 THEN 1 ELSE 0 END) AS nm,
  CAST(sum(CASE WHEN n_gt > 0 AND n_dt > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS itp, CAST(sum(CASE WHEN n_gt = 0 AND n_dt > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS ifp,
  CAST(sum(CASE WHEN n_gt = 0 AND n_dt = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS itn, CAST(sum(CASE WHEN n_gt > 0 AND n_dt = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS ifn,
  CAST(sum(CASE WHEN n_gt > 0 AND fp = 0 AND fn = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS perf FROM rows_ GROUP BY threshold),
b AS (SELECT *, tp / (tp + fp + 1e-4) AS p, tp / (tp + fn + 1e-4) AS rc, tp / (tp + pfp + 1e-4) AS pp, (itp * itn - ifp * ifn) / (sqrt((itp + ifp) * (itp + ifn) * (itn + ifp) * (itn + ifn)) + 1e-6) AS mcc FROM a)
"""


@query(
    "A08_dataset_scores",
    _DATASET
    + """SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 9) AS precision, round(rc, 9) AS recall, round(2 * p * rc / (p + rc + 1e-4), 9) AS f1,
  round(2 * pp * rc / (pp + rc + 1e-4), 9) AS positive_micro_f1, round(macro / nm, 9) AS positive_macro_f1, round(mcc, 9) AS il_mcc, round(2 * pp * rc / (pp + rc + 1e-4) * mcc, 9) AS cgf1_micro FROM b""",
)
def a08(spark, sf):
    s = ev.dataset_scores(_rows(spark, sf))
    names = ["precision", "recall", "f1", "positive_micro_f1", "positive_macro_f1", "il_mcc", "cgf1_micro"]
    return s.select("threshold", "tp", "fp", "fn", *[half_up(n, 9).alias(n) for n in names])


@query(
    "A09_demo_scores",
    _DATASET
    + """SELECT threshold, round(macro / nm * mcc, 9) AS cgf1_macro, round(perf / nullif(itp + ifn, 0), 9) AS il_perfect_pos, round(itn / nullif(itn + ifp, 0), 9) AS il_perfect_neg, round((0.5e0 + threshold / 100 * 0.25e0) / 2, 9) AS j_and_f FROM b""",
)
def a09(spark, sf):
    return _demo_scores(_rows(spark, sf))


@query("A09_demo_scores_crowded")
def a09_crowded(spark, sf):
    return _demo_scores(_rows(spark, sf, "gt", "det"))


def _demo_scores(rows):
    region = rows.select("threshold", F.lit(0.5).alias("j"), (F.col("threshold") / 100 * 0.25).alias("f"))
    s = ev.with_jf(ev.dataset_scores(rows), region, ["threshold"])
    return s.select("threshold", *[half_up(n, 9).alias(n) for n in ("cgf1_macro", "il_perfect_pos", "il_perfect_neg", "j_and_f")])


@query(
    "A10_best_ground_truth",
    _ROWS
    + ", "
    + _rows_sql("gt_other")
    + """, two AS (SELECT image_id, threshold, 0 AS gt_set, f1 FROM rows_ UNION ALL SELECT image_id, CAST(threshold AS INT), 1, f1 FROM rows_gt_other),
m AS (SELECT image_id, gt_set, avg(f1) AS mean FROM two GROUP BY ALL),
p AS (SELECT a.image_id, CASE WHEN b.mean IS NULL THEN 1 WHEN a.mean IS NULL THEN 0 WHEN b.mean > a.mean THEN 1 ELSE 0 END AS gt_set FROM m a JOIN m b ON a.image_id = b.image_id AND a.gt_set = 0 AND b.gt_set = 1)
SELECT two.image_id, two.threshold, two.gt_set FROM two JOIN p ON p.image_id = two.image_id AND p.gt_set = two.gt_set""",
)
def a10(spark, sf):
    two = _rows_of_sets(spark, sf, ["gt_apart", "gt_other"])
    return ev.best_ground_truth(two, ["image_id"], "gt_set").select("image_id", "threshold", "gt_set")


# The second annotator's set: the other side's detections, moved by one more.
SQL["gt_second"] = "SELECT image_id, det_id AS gt_id, x1 + category_id - 4 AS x1, y1, x2 + category_id - 4 AS x2, y2, category_id FROM det WHERE side = 'O'"


@query("A10_best_ground_truth_crowded")
def a10_crowded(spark, sf):
    two = _rows_of_sets(spark, sf, ["gt", "gt_second"], "det")
    return ev.best_ground_truth(two, ["image_id"], "gt_set").select("image_id", "threshold", "gt_set")


_HITS = with_views("det", "apart", "gt_apart") + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM apart) WHERE rn <= 100),
o AS (SELECT a.image_id, a.det_id, a.score, CAST(unnest(range(50, 100, 5)) AS INT) AS threshold, coalesce(is_crowd, false) AS is_crowd,
  CASE WHEN g.gt_id IS NULL THEN 0 ELSE greatest(least(a.x2, g.x2) - greatest(a.x1, g.x1), 0) * (a.y2 - a.y1) / (2 * (a.x2 - a.x1) * (a.y2 - a.y1) - greatest(least(a.x2, g.x2) - greatest(a.x1, g.x1), 0) * (a.y2 - a.y1)) END AS iou
  FROM top a LEFT JOIN gt_apart g ON g.gt_id = a.det_id),
h AS (SELECT image_id, det_id, score, threshold, CASE WHEN iou < threshold / 100 THEN 0 WHEN NOT is_crowd THEN 1 END AS hit FROM o)
"""


def _packed_hits(spark, sf, truth: str = "gt_apart", found: str = "apart"):
    """Hits of the greedy match at all thresholds, and the ground truth."""
    every, g = rel(spark, sf, found), rel(spark, sf, truth)
    if truth == "gt":
        g = g.withColumn("is_crowd", F.col("gt_id") % 17 == 0)
    return ev.greedy_hits_of_boxes(g, every, ["image_id"], max_dets=100), g


def _hits(spark, sf, *names: str):
    return ev.per_threshold(_packed_hits(spark, sf, *names)[0], ["image_id"])


def _precision(spark, sf, *names: str):
    hits, g = _packed_hits(spark, sf, *names)
    a = ev.packed_precision(hits, g.where("NOT is_crowd"), written=True)
    return a.select("threshold", half_up("ap", 9).alias("ap"), half_up("ar", 9).alias("ar"))


@query("A11_greedy_matches", _HITS + "SELECT image_id, det_id, score, threshold, hit FROM h")
def a11_match(spark, sf):
    """Which detections take a ground truth at each threshold (score order, best IoU first, crowds ignored)."""
    return _hits(spark, sf).select("image_id", "det_id", "score", "threshold", "hit")


@query("A11_greedy_matches_crowded")
def a11_match_crowded(spark, sf):
    return _hits(spark, sf, "gt", "det").select("image_id", "det_id", "score", "threshold", "hit")


@query("A11_average_precision_crowded")
def a11_crowded(spark, sf):
    return _precision(spark, sf, "gt", "det")


@query(
    "A11_average_precision",
    _HITS
    + """, npos AS (SELECT count(*) AS n FROM gt_apart WHERE NOT is_crowd),
c AS (SELECT threshold, score, sum(hit) OVER w AS tp, count(*) OVER w AS seen FROM h WHERE hit IS NOT NULL WINDOW w AS (PARTITION BY threshold ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT threshold, CAST(tp * 100 // n AS INT) AS level, max(tp / seen) AS prec, max(tp) AS tp FROM c, npos GROUP BY ALL),
pts AS (SELECT unnest(range(0, 101)) AS k),
best AS (SELECT threshold, k, coalesce(max(prec) FILTER (WHERE level >= k), 0) AS p FROM e, pts GROUP BY ALL)
SELECT threshold, round(sum(p) / 101, 9) AS ap, round((SELECT max(tp) FROM e WHERE e.threshold = best.threshold) / (SELECT n FROM npos), 9) AS ar FROM best GROUP BY threshold""",
)
def a11(spark, sf):
    return _precision(spark, sf)


@query(
    "A12_video_phrase_scores",
    _ROWS
    + """, v AS (SELECT image_id // 20 AS video_id, threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM rows_ GROUP BY ALL)
SELECT video_id, round(avg(tp), 9) AS tp, round(avg(fp), 9) AS fp, round(avg(fn), 9) AS fn, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 1 END), 9) AS f1 FROM v GROUP BY video_id""",
)
def a12(spark, sf):
    s = ev.per_pair_scores(_rows(spark, sf).withColumn("video_id", F.expr("image_id div 20")), ["video_id"])
    return s.select("video_id", *[half_up(c, 9).alias(c) for c in ("tp", "fp", "fn", "f1")])


@query("A12_video_phrase_scores_crowded")
def a12_crowded(spark, sf):
    s = ev.per_pair_scores(_rows(spark, sf, "gt", "det").withColumn("video_id", F.expr("image_id div 20")), ["video_id"])
    return s.select("video_id", *[half_up(c, 9).alias(c) for c in ("tp", "fp", "fn", "f1")])


SQL["video_frames"] = """
SELECT image_id // 20 AS video_id, CAST(category_id * 3 + det_id % 3 AS BIGINT) AS track_id, image_id % 20 AS frame, min(x1) AS x1, min(y1) AS y1, min(x1) + 20 AS x2, min(y1) + 10 AS y2, max(score) AS score
FROM det GROUP BY image_id // 20, CAST(category_id * 3 + det_id % 3 AS BIGINT), image_id % 20
"""
_PAIRS = "SELECT a.video_id, a.track_id AS a_id, b.track_id AS b_id FROM (SELECT DISTINCT video_id, track_id FROM video_frames) a JOIN (SELECT DISTINCT video_id, track_id FROM video_frames) b ON a.video_id = b.video_id AND b.track_id > a.track_id"
_TIOU = f""", pr AS ({_PAIRS}), tot AS (SELECT video_id, track_id, sum((x2 - x1) * (y2 - y1)) AS a FROM video_frames GROUP BY ALL),
sh AS (SELECT pr.video_id, a_id, b_id, sum(greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0)) AS i FROM pr
  JOIN video_frames p ON p.video_id = pr.video_id AND p.track_id = a_id JOIN video_frames q ON q.video_id = pr.video_id AND q.track_id = b_id AND q.frame = p.frame GROUP BY ALL)
SELECT pr.video_id, pr.a_id, pr.b_id, coalesce(i, 0) / (ta.a + tb.a - coalesce(i, 0)) AS iou FROM pr JOIN tot ta ON ta.video_id = pr.video_id AND ta.track_id = pr.a_id
JOIN tot tb ON tb.video_id = pr.video_id AND tb.track_id = pr.b_id LEFT JOIN sh ON sh.video_id = pr.video_id AND sh.a_id = pr.a_id AND sh.b_id = pr.b_id"""


@query("A13_tracklet_iou", with_views("det", "video_frames") + _TIOU)
def a13(spark, sf):
    f = rel(spark, sf, "video_frames")
    t = f.select("video_id", "track_id").distinct()
    pairs = t.withColumnRenamed("track_id", "a_id").join(t.withColumnRenamed("track_id", "b_id"), "video_id").where("a_id < b_id")
    return ev.tracklet_iou(f, pairs, ["video_id"])


@query(
    "A21_visible_mean_area",
    with_views("det")
    + """SELECT det_id AS id, CASE WHEN category_id % 2 = 0 AND side = 'F' THEN (x2 - x1) * (y2 - y1) WHEN category_id % 2 = 0 THEN (x2 - x1) * (y2 - y1) * 2 / 2 ELSE (x2 - x1) * (y2 - y1) END AS mean_area FROM det""",
)
def a21(spark, sf):
    t = video_tracks(spark, sf)
    t = t.withColumn("areas", F.transform("areas", lambda a, i: F.when(i != 1, a)))
    return t.select("id", ev.visible_mean_area(t).alias("mean_area"))


# --- HOTA -----------------------------------------------------------------------------
def _tracking(spark, sf):
    """Ground truth and tracker rows of the same videos; the tracker boxes are shifted."""
    f = cut(rel(spark, sf, "video_frames").select("video_id", "track_id", F.col("frame").alias("t"), "x1", "y1", "x2", "y2"))
    g = f.where("track_id % 3 <> 2").withColumnRenamed("track_id", "gt_id")
    k = f.where("track_id % 3 <> 1").withColumn("x1", F.col("x1") + F.col("track_id") % 4).withColumn("x2", F.col("x2") + F.col("track_id") % 4).withColumnRenamed("track_id", "trk_id")
    pairs = ev.iou_pairs(g, k, ["video_id", "t"], "gt_id", "trk_id").withColumnRenamed("iou", "sim")
    return g, k, pairs


@query("A15_hota")
def a15(spark, sf):
    return ev.hota(*_tracking(spark, sf), "video_id")


@query("A16_teta")
def a16(spark, sf):
    from tessella.operators.teta import teta

    g, k, pairs = _tracking(spark, sf)
    cls = lambda d, c, m: d.withColumn("category_id", F.col(c) % m)
    return teta(cls(g, "gt_id", 3), cls(k, "trk_id", 4), pairs, "video_id")


@query(
    "A17_sequence_counts",
    with_views("det", "video_frames")
    + "SELECT video_id, count(*) AS dets, count(DISTINCT track_id) AS ids, count(DISTINCT frame) AS frames FROM video_frames GROUP BY video_id",
)
def a17(spark, sf):
    return ev.sequence_counts(rel(spark, sf, "video_frames"), "video_id")


_MET = ", m AS (SELECT image_id, category_id AS cls, category_id % 3 AS super, unnest([5, 50]) AS alpha, count(*) AS tp, image_id % 7 AS fn, image_id % 5 AS fp, (image_id % 11) / 11 AS ass_a, (image_id % 13) / 13 AS loc_a FROM det GROUP BY image_id, category_id)"


def _metric_rows(spark, sf):
    m = det(spark, sf).groupBy("image_id", F.col("category_id").alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    return m.select(
        "*", (F.col("cls") % 3).alias("super"), F.explode(F.array(F.lit(5), F.lit(50))).alias("alpha"), (F.col("image_id") % 7).alias("fn"), (F.col("image_id") % 5).alias("fp"),
        *[((F.col("image_id") % 11) / 11).alias(c) for c in ev.ASSOCIATION], ((F.col("image_id") % 13) / 13).alias("loc_a"),
    )


@query(
    "A18_combine_sequences",
    with_views("det")
    + _MET
    + """, s AS (SELECT cls, alpha, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(ass_a * tp) / greatest(1, sum(tp)) AS a, greatest(1e-10, sum(loc_a * tp)) / greatest(1e-10, sum(tp)) AS l FROM m GROUP BY ALL)
SELECT cls, alpha, CAST(tp AS BIGINT) AS tp, round(a, 9) AS ass_a, round(l, 9) AS loc_a, round(tp / greatest(1, tp + fn + fp), 9) AS det_a, round(sqrt(tp / greatest(1, tp + fn + fp) * a), 9) AS hota FROM s""",
)
def a18(spark, sf):
    c = ev.combine_sequences(_metric_rows(spark, sf), ["cls", "alpha"])
    return c.select("cls", "alpha", "tp", *[half_up(n, 9).alias(n) for n in ("ass_a", "loc_a", "det_a", "hota")])


@query(
    "A18_class_average",
    with_views("det")
    + _MET
    + """, s AS (SELECT cls, alpha, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(ass_a * tp) / greatest(1, sum(tp)) AS a FROM m GROUP BY ALL)
SELECT alpha, CAST(sum(tp) AS BIGINT) AS tp, round(avg(a), 9) AS ass_a, round(avg(sqrt(tp / greatest(1, tp + fn + fp) * a)), 9) AS hota FROM s GROUP BY alpha""",
)
def a18_class(spark, sf):
    c = ev.combine_classes(ev.combine_sequences(_metric_rows(spark, sf), ["cls", "alpha"]), ["alpha"])
    return c.select("alpha", "tp", half_up("ass_a", 9).alias("ass_a"), half_up("hota", 9).alias("hota"))


@query(
    "A18_roll_up",
    with_views("det")
    + _MET
    + """SELECT alpha, super, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, round(sum(ass_a * tp) / greatest(1, sum(tp)), 9) AS ass_a FROM m GROUP BY GROUPING SETS ((alpha, super, cls), (alpha, super), (alpha))""",
)
def a18_roll(spark, sf):
    r = ev.roll_up(_metric_rows(spark, sf), "cls", "super")
    return r.select("alpha", "super", "cls", "tp", "fp", half_up("ass_a", 9).alias("ass_a"))


@query(
    "A20_duplicate_ids",
    with_views("tracks") + "SELECT video_id, frame, track_id, count(*) AS n FROM tracks GROUP BY ALL HAVING count(*) > 1",
)
def a20(spark, sf):
    return ev.duplicate_ids(rel(spark, sf, "tracks"), ["video_id", "frame", "track_id"])


@query(
    "A20_uneven_stages",
    with_views("find_queries")
    + """, n AS (SELECT datapoint_id, stage, count(*) AS n FROM find_queries GROUP BY ALL), v AS (SELECT datapoint_id, n, count(*) AS v FROM n GROUP BY ALL),
m AS (SELECT datapoint_id, n AS expected FROM (SELECT *, row_number() OVER (PARTITION BY datapoint_id ORDER BY v DESC, n) AS rn FROM v) WHERE rn = 1)
SELECT n.datapoint_id, n.stage, n.n, m.expected FROM n JOIN m ON m.datapoint_id = n.datapoint_id WHERE n.n <> m.expected""",
)
def a20_stages(spark, sf):
    return ev.uneven_stages(rel(spark, sf, "find_queries"), "datapoint_id", "stage")


@query("F11_drop_unmatched")
def f11(spark, sf):
    g, k, pairs = _tracking(spark, sf)
    flags = g.select("video_id").distinct().select("video_id", (F.col("video_id") % 3 == 0).alias("is_negative"), (F.col("video_id") % 4 == 0).alias("not_exhaustive"))
    return ev.drop_unmatched(k, g, pairs, flags, ["video_id", "t"]).select("video_id", "t", "trk_id")


# --- suppression over tracks and groups ------------------------------------------------
def _pair_kept(pairs: str) -> str:
    return f""", pairs AS ({pairs}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, track_id) AS rk FROM trk),
walk AS (SELECT video_id, rk, [track_id] AS kept FROM ranked WHERE rk = 1
  UNION ALL SELECT r.video_id, r.rk, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.video_id = r.video_id AND ((p.a_id = r.track_id AND list_contains(w.kept, p.b_id)) OR (p.b_id = r.track_id AND list_contains(w.kept, p.a_id)))) THEN w.kept
    ELSE list_append(w.kept, r.track_id) END FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.rk = w.rk + 1)
SELECT video_id, unnest(kept) AS track_id FROM (SELECT video_id, arg_max(kept, rk) AS kept FROM walk GROUP BY video_id)"""


_TNMS = """SELECT p.video_id, p.track_id AS a_id, q.track_id AS b_id FROM video_frames p JOIN video_frames q ON p.video_id = q.video_id AND p.frame = q.frame AND p.track_id < q.track_id
GROUP BY ALL HAVING sum(greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0)) >= 0.5e0 * sum(400 - greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0))"""


@query(
    "X05_track_nms",
    with_recursive("det", "video_frames") + ", trk AS (SELECT video_id, track_id, max(score) AS score FROM video_frames GROUP BY ALL)" + _pair_kept(_TNMS),
)
def x05(spark, sf):
    from tessella.operators.tracks import track_nms

    return track_nms(rel(spark, sf, "video_frames"), ["video_id"], 0.5)


@query(
    "X05_frame_nms",
    with_recursive("det", "video_frames")
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY score DESC, track_id) AS rk FROM video_frames),
walk AS (SELECT video_id, frame, rk, [{'id': track_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM ranked WHERE rk = 1
  UNION ALL SELECT r.video_id, r.frame, r.rk, CASE WHEN len(list_filter(w.kept, lambda k: greatest(least(r.x2,k.x2)-greatest(r.x1,k.x1),0)*greatest(least(r.y2,k.y2)-greatest(r.y1,k.y1),0)
    / (400 - greatest(least(r.x2,k.x2)-greatest(r.x1,k.x1),0)*greatest(least(r.y2,k.y2)-greatest(r.y1,k.y1),0)) >= 0.5)) > 0 THEN w.kept
    ELSE list_append(w.kept, {'id': r.track_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}) END FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.frame = w.frame AND r.rk = w.rk + 1)
SELECT video_id, frame, u.id AS track_id FROM (SELECT video_id, frame, unnest(kept) AS u FROM (SELECT video_id, frame, arg_max(kept, rk) AS kept FROM walk GROUP BY video_id, frame))""",
)
def x05_frames(spark, sf):
    return greedy.greedy_keep(
        rel(spark, sf, "video_frames"), ["video_id", "frame"], "track_id", [-F.col("score")], greedy.iou_above(0.5, inclusive=True)
    ).select("video_id", "frame", "track_id")


@query("X02_cross_group_nms")
def x02(spark, sf):
    """Cross-group suppression with shape/image pairs decided by the region class of the better row."""
    from tessella.functions import rules
    from tessella.operators.crossgroup import cross_group_keep

    b = box()
    d = det(spark, sf).withColumn("region_class", rules.region_class(b.x2 * 12, b.x1 * 2, b.y1 * 10, b.y2 / 100))
    return cross_group_keep(d, ["image_id"], "det_id").select("image_id", "det_id")
