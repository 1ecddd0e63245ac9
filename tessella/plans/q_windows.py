"""Ranking, shard merges, id maps, sampling, set operations, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.rules import half_up
from tessella.operators import datasets as ds
from tessella.operators.numbering import ordinal, top_k
from tessella.plans.q_filters import _FQ, find_queries
from tessella.plans.registry import query
from tessella.plans.relations import SQL, det, gt, rel, run, with_views

SQL["tracks"] = """
SELECT user_id % 50 AS video_id, user_id AS track_id, event_id, ts, value AS score, event_type,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS category_id,
  CAST(event_id // 7 AS BIGINT) AS frame, CAST(user_id % 30 * 10 + event_id % 7 AS DOUBLE) AS x1, CAST(user_id % 17 * 5 + event_id % 3 AS DOUBLE) AS y1,
  CAST(user_id % 30 * 10 + event_id % 7 + 20 AS DOUBLE) AS x2, CAST(user_id % 17 * 5 + event_id % 3 + 12 AS DOUBLE) AS y2
FROM events
"""


@query(
    "W01_top_k_per_image",
    with_views("det")
    + "SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM det) WHERE rn <= 5",
)
def w01(spark, sf):
    return top_k(det(spark, sf), ["image_id"], [F.col("score").desc(), F.col("det_id")], 5).select("image_id", "det_id")


_SHARDS = ", sh AS (SELECT *, det_id % 4 AS shard FROM det)"


@query(
    "W02_merge_shards",
    with_views("det")
    + _SHARDS
    + """, f AS (SELECT *, rank() OVER (PARTITION BY image_id, category_id ORDER BY shard) AS r FROM sh)
SELECT image_id, category_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM f WHERE r = 1) WHERE rn <= 10""",
)
def w02(spark, sf):
    d = det(spark, sf).withColumn("shard", F.col("det_id") % 4)
    return ds.merge_shards(d, "image_id", "category_id", "shard", "score", "det_id", 10).select("image_id", "category_id", "det_id")


@query(
    "W03_first_shard_wins",
    with_views("det")
    + _SHARDS
    + "SELECT video_id, category_id, det_id, shard FROM (SELECT *, image_id // 10 AS video_id, rank() OVER (PARTITION BY image_id // 10, category_id ORDER BY shard) AS r FROM sh) WHERE r = 1",
)
def w03(spark, sf):
    d = det(spark, sf).selectExpr("image_id div 10 AS video_id", "category_id", "det_id", "det_id % 4 AS shard")
    return ds.first_shard_rows(d, ["video_id", "category_id"], "shard")


@query(
    "W04_distinct_images",
    with_views("det") + "SELECT image_id, min(det_id) AS det_id FROM det GROUP BY image_id ORDER BY image_id",
)
def w04(spark, sf):
    return ds.first_occurrence(det(spark, sf).select("image_id", "det_id"), "image_id", "det_id").orderBy("image_id")


@query(
    "W05_unique_track_ids",
    with_views("det")
    + """, r AS (SELECT det_id, image_id // 10 AS video_id, CASE WHEN category_id = 7 THEN 1000 + image_id ELSE category_id * 10 + image_id % 3 END AS track_id FROM det),
s AS (SELECT track_id FROM r GROUP BY track_id HAVING count(DISTINCT video_id) > 1),
n AS (SELECT track_id, video_id, dense_rank() OVER (ORDER BY track_id, video_id) + (SELECT max(track_id) FROM r) AS new_id FROM (SELECT DISTINCT track_id, video_id FROM r WHERE track_id IN (SELECT track_id FROM s)))
SELECT r.det_id, coalesce(n.new_id, r.track_id) AS track_id FROM r LEFT JOIN n ON n.track_id = r.track_id AND n.video_id = r.video_id""",
)
def w05(spark, sf):
    r = det(spark, sf).selectExpr(
        "det_id", "image_id div 10 AS video_id", "CASE WHEN category_id = 7 THEN 1000 + image_id ELSE category_id * 10 + image_id % 3 END AS track_id"
    )
    return ds.unique_track_ids(r, "video_id", "track_id").select("det_id", "track_id")


_PAIRIDS = """, pos AS (SELECT DISTINCT image_id // 10 AS video_id, category_id FROM det WHERE category_id <= 4),
neg AS (SELECT DISTINCT image_id // 10 AS video_id, category_id FROM det WHERE category_id >= 4 AND image_id % 2 = 0),
al AS (SELECT video_id, category_id, 0 AS neg FROM pos UNION ALL SELECT video_id, category_id, 1 FROM neg WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.video_id = neg.video_id AND pos.category_id = neg.category_id))
SELECT video_id, category_id, row_number() OVER (ORDER BY neg, video_id, category_id) AS new_id FROM al"""


@query("W06_video_category_ids", with_views("det") + _PAIRIDS)
def w06(spark, sf):
    d = det(spark, sf).selectExpr("image_id div 10 AS video_id", "category_id", "image_id")
    return ds.pair_ids(d.where("category_id <= 4"), d.where("category_id >= 4 AND image_id % 2 = 0"), "video_id", "category_id")


@query(
    "W07_class_agnostic_ids",
    with_views("tracks")
    + "SELECT event_id, dense_rank() OVER (ORDER BY video_id, track_id) AS new_track, 1 AS category_id FROM tracks",
)
def w07(spark, sf):
    return ds.class_agnostic_ids(rel(spark, sf, "tracks"), "video_id", "track_id").select("event_id", "new_track", "category_id")


@query(
    "W08_one_based_ids",
    "SELECT n_nationkey + 1 AS id, n_regionkey + 1 AS image_id, n_nationkey % 3 + 1 AS category_id FROM nation",
)
def w08(spark, sf):
    nation, region = rel(spark, sf, "nation"), rel(spark, sf, "region")
    cats = nation.select((F.col("n_nationkey") % 3).alias("id")).distinct()
    anns = nation.selectExpr("n_nationkey AS id", "n_regionkey AS image_id", "n_nationkey % 3 AS category_id")
    return ds.one_based(region.select(F.col("r_regionkey").alias("id")), cats, anns)[2]


@query(
    "W09_timesteps",
    with_views("tracks")
    + "SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS timestep FROM (SELECT DISTINCT video_id, frame FROM tracks)",
)
def w09(spark, sf):
    return ds.timesteps(rel(spark, sf, "tracks").select("video_id", "frame").distinct(), "video_id", "frame")


_TRK = "SELECT image_id // 10 AS video_id, det_id AS id, category_id, [CASE WHEN category_id % 2 = 0 THEN NULL ELSE [x1, y1, x2 - x1, y2 - y1] END, [x1 + 1, y1, x2 - x1, y2 - y1], CASE WHEN side = 'F' THEN NULL ELSE [x1 + 2, y1, x2 - x1, y2 - y1] END] AS bboxes, side FROM det"
VIDEO_TRACKS = """image_id div 10 AS video_id, det_id AS id, category_id, array(CASE WHEN category_id % 2 = 0 THEN NULL ELSE array(x1, y1, x2 - x1, y2 - y1) END, array(x1 + 1, y1, x2 - x1, y2 - y1),
  CASE WHEN side = 'F' THEN NULL ELSE array(x1 + 2, y1, x2 - x1, y2 - y1) END) AS bboxes"""


def video_tracks(spark, sf):
    d = run(spark, sf, f"SELECT {VIDEO_TRACKS.replace(' div ', ' // ')} FROM det")
    return d.withColumn("areas", F.transform("bboxes", lambda b: F.get(b, F.lit(2)) * F.get(b, F.lit(3))))


@query(
    "W10_track_arrays_to_frames",
    with_views("det")
    + f""", t AS ({_TRK}), f AS (SELECT video_id, id, category_id, unnest([0, 1, 2]) AS frame, bboxes FROM t)
SELECT video_id, id AS track_id, category_id, CAST(frame AS INT) AS frame, bboxes[frame + 1][1] AS x, bboxes[frame + 1][3] * bboxes[frame + 1][4] AS area FROM f WHERE bboxes[frame + 1] IS NOT NULL""",
)
def w10(spark, sf):
    f = ds.tracks_to_frames(video_tracks(spark, sf))
    return f.select("video_id", "track_id", "category_id", "frame", F.get("bbox", F.lit(0)).alias("x"), "area")


@query(
    "W11_sample_stages",
    _FQ
    + """, st AS (SELECT datapoint_id, stage, row_number() OVER (PARTITION BY datapoint_id ORDER BY stage) - 1 AS i FROM (SELECT DISTINCT datapoint_id, stage FROM q)),
n AS (SELECT datapoint_id, count(*) AS n FROM st GROUP BY datapoint_id HAVING count(*) >= 2),
p AS (SELECT st.*, CASE WHEN 2 <= n - 1 THEN 2 ELSE n - 1 END AS step, n FROM st JOIN n ON n.datapoint_id = st.datapoint_id),
k AS (SELECT *, datapoint_id % (n - step) AS f FROM p)
SELECT q.query_id, CAST(1 - (k.i - k.f) // k.step AS INT) AS new_stage FROM q JOIN k ON k.datapoint_id = q.datapoint_id AND k.stage = q.stage
WHERE k.i >= k.f AND k.i <= k.f + k.step AND (k.i - k.f) % k.step = 0""",
)
def w11(spark, sf):
    return ds.sample_stages(
        rel(spark, sf, "find_queries"), "datapoint_id", "stage", 2, 2, F.col("datapoint_id"), reverse=True
    ).select("query_id", "new_stage")


@query(
    "W12_cap_queries",
    _FQ
    + "SELECT query_id FROM (SELECT query_id, row_number() OVER (PARTITION BY datapoint_id ORDER BY CAST(len(object_ids) = 0 AS INT), md5(concat('s1:', query_id)), query_id) AS rn FROM q) WHERE rn <= 6",
)
def w12(spark, sf):
    return ds.cap_queries(find_queries(spark, sf), "datapoint_id", 6, ds.draw("s1", "query_id")).select("query_id")


_POS = ", pq AS (SELECT *, row_number() OVER (PARTITION BY datapoint_id, image_no ORDER BY query_id) - 1 AS pos FROM q)"


@query(
    "W12_cap_queries_per_frame",
    _FQ
    + _POS
    + """, full_points AS (SELECT DISTINCT datapoint_id FROM (SELECT datapoint_id, image_no FROM pq GROUP BY datapoint_id, image_no HAVING count(*) > 3)),
pp AS (SELECT * FROM pq),
kept AS (SELECT datapoint_id, pos FROM (SELECT datapoint_id, pos, row_number() OVER (PARTITION BY datapoint_id ORDER BY CAST(len(object_ids) = 0 AS INT), md5(concat('s2:', query_id)), pos) AS rn
  FROM pp WHERE image_no = 0 AND datapoint_id IN (SELECT datapoint_id FROM full_points)) WHERE rn <= 3)
SELECT query_id FROM pp WHERE datapoint_id NOT IN (SELECT datapoint_id FROM full_points) OR EXISTS (SELECT 1 FROM kept WHERE kept.datapoint_id = pp.datapoint_id AND kept.pos = pp.pos)""",
)
def w12_frames(spark, sf):
    q = ordinal(find_queries(spark, sf), ["datapoint_id", "image_no"], [F.floor(F.col("query_id") / 4096)], [F.col("query_id")], "pos", start=0)
    return ds.cap_queries_per_frame(q, "datapoint_id", "image_no", "pos", 3, ds.draw("s2", "query_id")).select("query_id")


@query(
    "W13_prune_conversations",
    """WITH t AS (SELECT *, max(CASE WHEN role = 'assistant' AND turn > 1 AND contains(text, 'th') THEN turn END) OVER (PARTITION BY conv_id) AS last_call FROM conversations)
SELECT conv_id, turn, role FROM t WHERE turn < 2 OR turn >= last_call""",
)
def w13(spark, sf):
    from tessella.operators.messages import prune

    return prune(rel(spark, sf, "conversations"), F.col("text").contains("th")).select("conv_id", "turn", "role")


@query(
    "W13_count_images",
    "SELECT conv_id, CAST(sum(CASE WHEN turn % 3 = 0 THEN 2 WHEN turn % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_images FROM conversations GROUP BY conv_id",
)
def w13_images(spark, sf):
    from tessella.operators.messages import count_images

    part = lambda t: F.struct(F.lit(t).alias("type"))
    parts = F.when(F.col("turn") % 3 == 0, F.array(part("image"), part("text"), part("image"))).when(
        F.col("turn") % 3 == 1, F.array(part("text"), part("image"))
    ).otherwise(F.array(part("text")))
    return count_images(rel(spark, sf, "conversations").withColumn("content", parts))


_RAW = """, raw AS (SELECT det_id, image_id, [score / 20000 - 3, x1 / 10 - 2, y1 - 4] AS logits, category_id * 0.5e0 AS presence, (x1 + x2) / 200 AS cx, (y1 + y2) / 40 AS cy, (x2 - x1) / 100 AS w, (y2 - y1) / 20 AS h FROM det),
s AS (SELECT *, greatest(logits[1], logits[2], logits[3]) AS m, (1 / (1 + exp(-greatest(logits[1], logits[2], logits[3])))) * (1 / (1 + exp(-presence))) AS score FROM raw)
"""


@query(
    "W14_raw_to_detections",
    with_views("det")
    + _RAW
    + """SELECT image_id, det_id, CASE WHEN logits[1] = m THEN 0 WHEN logits[2] = m THEN 1 ELSE 2 END AS label, round((cx - w / 2) * 640, 6) AS x1, round((cy + h / 2) * 480, 6) AS y2, round(score, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM s WHERE score > 0.5) WHERE rn <= 8""",
)
def w14(spark, sf):
    from tessella.operators.detections import from_raw

    raw = det(spark, sf).select(
        "det_id", "image_id", F.expr("array(score / 20000 - 3, x1 / 10 - 2, y1 - 4)").alias("logits"), F.expr("category_id * 0.5D").alias("presence"),
        F.expr("(x1 + x2) / 200").alias("cx"), F.expr("(y1 + y2) / 40").alias("cy"), F.expr("(x2 - x1) / 100").alias("w"), F.expr("(y2 - y1) / 20").alias("h"),
        F.lit(640.0).alias("img_w"), F.lit(480.0).alias("img_h"),
    )
    d = from_raw(raw, "image_id", "det_id", threshold=0.5, k=8, presence=True)
    return d.select("image_id", "det_id", "label", half_up("x1", 6).alias("x1"), half_up("y2", 6).alias("y2"), half_up("score", 9).alias("score"))


@query(
    "A19_count_above_threshold",
    with_views("det") + _RAW + "SELECT image_id, CAST(sum(CAST(score > 0.5 AS INT)) AS BIGINT) AS n FROM s GROUP BY image_id",
)
def a19(spark, sf):
    from tessella.operators.detections import count_above

    raw = det(spark, sf).select("image_id", F.expr("greatest(score / 20000 - 3, x1 / 10 - 2, y1 - 4)").alias("logit"), F.expr("category_id * 0.5D").alias("presence"))
    return count_above(raw, "image_id", 0.5)


@query(
    "W15_assemble_tracks",
    with_views("det")
    + """, f AS (SELECT image_id, category_id, CAST(det_id % 5 AS INT) AS frame, min(det_id) AS det_id FROM det GROUP BY ALL),
r AS (SELECT f.image_id, f.category_id AS obj_id, f.frame, d.x1, d.score, CAST(d.det_id % 3 AS INT) AS label FROM f JOIN det d ON d.det_id = f.det_id),
v AS (SELECT image_id, obj_id, label, count(*) AS n FROM r GROUP BY ALL),
l AS (SELECT image_id, obj_id, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id, obj_id ORDER BY n DESC, label) AS rn FROM v) WHERE rn = 1),
a AS (SELECT image_id, obj_id, round(avg(score), 4) AS score, count(*) AS seen, max(CASE WHEN frame = 0 THEN x1 END) AS x_at_0 FROM r GROUP BY ALL)
SELECT a.image_id, a.obj_id, l.label, a.score, 5 AS n_frames, CAST(5 - a.seen AS INT) AS n_gaps, a.x_at_0 FROM a JOIN l ON l.image_id = a.image_id AND l.obj_id = a.obj_id""",
)
def w15(spark, sf):
    d = det(spark, sf).withColumn("frame", (F.col("det_id") % 5).cast("int"))
    first = d.groupBy("image_id", F.col("category_id").alias("obj_id"), "frame").agg(
        F.min(F.struct("det_id", "x1", "y1", "x2", "y2", "score")).alias("m")
    )
    frames = first.select(
        "image_id", "obj_id", "frame", F.array("m.x1", "m.y1", "m.x2", "m.y2").alias("bbox"), "m.score", (F.col("m.det_id") % 3).cast("int").alias("label")
    )
    length = frames.select("image_id").distinct().withColumn("n_frames", F.lit(5))
    t = ds.assemble_tracks(frames, ["image_id", "obj_id"], "frame", length, ["image_id"])
    return t.select(
        "image_id", "obj_id", "label", half_up("score", 4).alias("score"), F.size("bboxes").alias("n_frames"),
        F.size(F.filter("scores", lambda s: s < -1e7)).alias("n_gaps"), F.get(F.get("bboxes", F.lit(0)), F.lit(0)).alias("x_at_0"),
    )


@query(
    "W16_class_sequence_ids",
    with_views("tracks")
    + """, r AS (SELECT video_id, category_id, track_id, count(*) AS dets, max(score) AS score FROM tracks GROUP BY ALL)
SELECT video_id, category_id, track_id, dense_rank() OVER (PARTITION BY video_id, category_id ORDER BY track_id) - 1 AS new_id, row_number() OVER (PARTITION BY video_id, category_id ORDER BY score DESC, track_id) AS score_rank,
  CAST(sum(dets) OVER (PARTITION BY video_id, category_id) AS BIGINT) AS num_dets, count(*) OVER (PARTITION BY video_id, category_id) AS num_ids FROM r""",
)
def w16(spark, sf):
    from tessella.operators.tracks import class_sequences

    return class_sequences(rel(spark, sf, "tracks"), ["video_id", "category_id"], "track_id", "score")


# --- order and set operations -------------------------------------------------
_LAYER = "CASE WHEN element_type = 'section_panel' THEN 0 WHEN element_type = 'rectangle' THEN 1 WHEN element_type IN ('icon', 'picture') THEN 2 WHEN element_type = 'arrow' THEN 3 WHEN element_type = 'text' THEN 4 ELSE 5 END"


@query(
    "O01_z_order",
    with_views("det")
    + f"SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY {_LAYER}, (x2 - x1) * (y2 - y1) DESC, det_id) + 1 AS cell_id FROM det",
)
def o01(spark, sf):
    from tessella.operators.cells import z_order
    from tessella.functions import rules

    d = det(spark, sf).withColumn("layer_level", rules.layer_level(F.col("element_type")))
    return z_order(d, "image_id", "det_id").select("image_id", "det_id", "cell_id")


@query(
    "O02_cap_new_objects",
    with_views("det")
    + "SELECT image_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) AS rn FROM det) WHERE rn <= 3",
)
def o02(spark, sf):
    return top_k(det(spark, sf), ["image_id", "category_id"], [F.col("score").desc(), F.col("det_id")], 3).select("image_id", "det_id")


@query("O03_regions_by_area", with_views("det") + "SELECT det_id, (x2 - x1) * (y2 - y1) AS area FROM det ORDER BY area DESC, det_id")
def o03(spark, sf):
    return det(spark, sf).selectExpr("det_id", "(x2 - x1) * (y2 - y1) AS area").orderBy(F.col("area").desc(), "det_id")


@query(
    "U01_fragment_union",
    with_views("det")
    + """, a AS (SELECT CAST(det_id AS VARCHAR) AS element_id, 'direct' AS source FROM det WHERE category_id <= 3),
b AS (SELECT CAST(det_id AS VARCHAR) AS element_id, 'element' AS source FROM det WHERE category_id BETWEEN 2 AND 5),
c AS (SELECT concat('text_', det_id) AS element_id, 'text' AS source FROM det WHERE category_id >= 6)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE element_id NOT IN (SELECT element_id FROM a) UNION ALL SELECT * FROM c""",
)
def u01(spark, sf):
    from tessella.operators.cells import collect_fragments

    d = det(spark, sf)
    frag = lambda w, s, i=F.col("det_id").cast("string"): d.where(w).select(i.alias("element_id"), F.lit(s).alias("source"))
    text = frag("category_id >= 6", "text", F.concat(F.lit("text_"), F.col("det_id").cast("string")))
    return collect_fragments(frag("category_id <= 3", "direct"), frag("category_id BETWEEN 2 AND 5", "element"), text)


@query(
    "U03_set_operations",
    with_views("det", "apart", "gt_apart")
    + """, im AS (SELECT DISTINCT image_id FROM det), g AS (SELECT DISTINCT image_id FROM gt_apart)
SELECT image_id, 'missing' AS kind FROM im WHERE image_id NOT IN (SELECT image_id FROM g)
UNION ALL SELECT image_id, 'excluded' FROM (SELECT image_id FROM g UNION SELECT image_id FROM det WHERE category_id = 7)""",
)
def u03(spark, sf):
    images = det(spark, sf).select("image_id").distinct()
    g = rel(spark, sf, "gt_apart").select("image_id").distinct()
    seven = det(spark, sf).where("category_id = 7").select("image_id")
    return images.subtract(g).withColumn("kind", F.lit("missing")).unionByName(g.union(seven).distinct().withColumn("kind", F.lit("excluded")))


# --- joins over sets --------------------------------------------------------------
@query(
    "J07_per_image_fill",
    with_views("det", "gt")
    + """, im AS (SELECT DISTINCT image_id FROM det) SELECT im.image_id, coalesce(g.n, 0) AS n_gt, coalesce(d.n, 0) AS n_dt FROM im
LEFT JOIN (SELECT image_id, count(*) AS n FROM gt GROUP BY image_id) g ON g.image_id = im.image_id
LEFT JOIN (SELECT image_id, count(*) AS n FROM det WHERE score > 50000 GROUP BY image_id) d ON d.image_id = im.image_id""",
)
def j07(spark, sf):
    from tessella.operators.evalmetrics import per_image_counts

    d = det(spark, sf)
    return per_image_counts(d.select("image_id").distinct(), gt(spark, sf), d.where("score > 50000"), ["image_id"])


@query(
    "J08_positive_split",
    with_views("det", "gt") + "SELECT det_id FROM det WHERE EXISTS (SELECT 1 FROM gt WHERE gt.image_id = det.image_id AND gt.category_id = det.category_id)",
)
def j08(spark, sf):
    keys = ["image_id", "category_id"]
    return det(spark, sf).join(gt(spark, sf).select(*keys).distinct(), keys, "left_semi").select("det_id")


@query(
    "J09_fill_foreign_keys",
    """SELECT o_orderkey AS ann_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE c_nationkey END, c_nationkey) AS video_id FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def j09(spark, sf):
    img = rel(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS video_id")
    ann = run(spark, sf, "SELECT o_orderkey AS ann_id, o_custkey AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS INT) ELSE c_nationkey END AS video_id FROM orders JOIN customer ON o_custkey = c_custkey")
    return ds.fill_video_ids(ann, img).select("ann_id", "video_id")


@query(
    "J09_unresolved_keys",
    "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)",
)
def j09_check(spark, sf):
    known = rel(spark, sf, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return ds.unresolved(rel(spark, sf, "orders"), known, ["o_custkey"]).select("o_orderkey")


@query(
    "J14_image_category_grid",
    with_views("det")
    + """SELECT i.image_id, c.category_id, coalesce(n, 0) AS n_anns FROM (SELECT DISTINCT image_id FROM det) i, (SELECT DISTINCT category_id FROM det) c
LEFT JOIN (SELECT image_id, category_id, count(*) AS n FROM det GROUP BY ALL) h ON h.image_id = i.image_id AND h.category_id = c.category_id""",
)
def j14(spark, sf):
    d = det(spark, sf).withColumn("ann_id", F.col("det_id"))
    q = ds.image_category_queries(d, d.select("category_id"), d, negatives=True, chunk=4)
    return q.select("image_id", "category_id", F.size("ann_ids").cast("bigint").alias("n_anns"))


@query(
    "J16_frame_objects",
    with_views("det")
    + f", t AS ({_TRK}) SELECT id, concat('phrase ', category_id) AS phrase, bboxes[2][1] AS x FROM t WHERE bboxes[2] IS NOT NULL AND video_id = 3",
)
def j16(spark, sf):
    from tessella.operators.tracks import frame_objects

    t = video_tracks(spark, sf)
    phrases = det(spark, sf).select("category_id").distinct().withColumn("phrase", F.concat(F.lit("phrase "), F.col("category_id").cast("string")))
    return frame_objects(t, phrases, 3, 1).select("id", "phrase", F.get("bbox", F.lit(0)).alias("x"))
