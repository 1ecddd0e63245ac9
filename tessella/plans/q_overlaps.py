"""Overlap joins, containment, coverage, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import boxes as bx, rules
from tessella.functions.boxes import box
from tessella.operators import greedy, overlaps as ov
from tessella.operators.cluster import components
from tessella.operators.spatial import self_pairs
from tessella.plans.q_boxes import REL_SQL, _AA, _AB, _I
from tessella.plans.registry import query
from tessella.plans.relations import det, gt, paths, rel, with_recursive, with_views

_REN = "det_id AS {p}_det_id, x1 AS {p}_x1, y1 AS {p}_y1, x2 AS {p}_x2, y2 AS {p}_y2, score AS {p}_score, layer AS {p}_layer, element_type AS {p}_type"
_SIDE = "(SELECT image_id, " + _REN + " FROM lay)"
_LAY = """, lay AS (SELECT *, CASE WHEN element_type = 'section_panel' THEN 0 WHEN element_type = 'rectangle' THEN 1 WHEN element_type IN ('icon', 'picture') THEN 2
  WHEN element_type = 'arrow' THEN 3 WHEN element_type = 'text' THEN 4 ELSE 5 END AS layer FROM det)
"""
_PAIRS = _LAY + f""", pairs AS (SELECT a.image_id, a.* EXCLUDE (image_id), b.* EXCLUDE (image_id), {_I} / ({_AA} + {_AB} - {_I}) AS iou, {REL_SQL} AS relationship
  FROM {_SIDE.format(p='a')} a JOIN {_SIDE.format(p='b')} b ON a.image_id = b.image_id AND a_det_id < b_det_id WHERE {_I} / ({_AA} + {_AB} - {_I}) >= 0.1)
"""


def _some(spark, sf):
    return det(spark, sf).withColumn("layer_level", rules.layer_level(F.col("element_type")))


def _pairs(spark, sf):
    return ov.overlap_pairs(_some(spark, sf), ["image_id"], "det_id", carry=["score", "layer_level"])


@query("J01_overlap_pairs", with_views("det") + _PAIRS + "SELECT image_id, a_det_id, b_det_id, iou, relationship FROM pairs")
def j01(spark, sf):
    return _pairs(spark, sf).select("image_id", "a_det_id", "b_det_id", "iou", "relationship")




@query(
    "J02_drop_existing",
    with_views("det", "gt")
    + f"""SELECT g.image_id, g.gt_id FROM gt g WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.side = 'O' AND d.image_id = g.image_id AND
  greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) >
  0.8e0 * ((d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0)))""",
)
def j02(spark, sf):
    return ov.drop_existing(gt(spark, sf), det(spark, sf).where("side = 'O'"), ["image_id"], 0.8).select("image_id", "gt_id")


def _removal_sql(events: str) -> str:
    """Walk the events of an image in order; each fires while both its rows are alive."""
    return f""", ev AS ({events}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY t1, t2) AS rk FROM ev),
walk AS (SELECT image_id, rk, [l] AS dead FROM ranked WHERE rk = 1
  UNION ALL SELECT r.image_id, r.rk, CASE WHEN list_contains(w.dead, r.w) OR list_contains(w.dead, r.l) THEN w.dead ELSE list_append(w.dead, r.l) END
  FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rk = w.rk + 1),
gone AS (SELECT image_id, unnest(dead) AS id FROM (SELECT image_id, arg_max(dead, rk) AS dead FROM walk GROUP BY image_id))
"""


_CONT = f"""SELECT image_id, a_det_id AS t1, b_det_id AS t2, CASE WHEN {{ab}} THEN b_det_id ELSE a_det_id END AS w, CASE WHEN {{ab}} THEN a_det_id ELSE b_det_id END AS l
  FROM (SELECT a.image_id, a.* EXCLUDE (image_id), b.* EXCLUDE (image_id) FROM {_SIDE.format(p='a')} a JOIN {_SIDE.format(p='b')} b ON a.image_id = b.image_id AND a_det_id < b_det_id) p
  WHERE ({{ab}}) OR ({{ba}})"""


@query(
    "J10_contained_in_image_types",
    with_recursive("det")
    + _LAY
    + _removal_sql(
        _CONT.format(
            ab=f"{_AA} < {_AB} AND {_I} / ({_AA}) > 0.85e0 AND b_type IN ('icon', 'picture')",
            ba=f"{_AB} < {_AA} AND {_I} / ({_AB}) > 0.85e0 AND a_type IN ('icon', 'picture')",
        )
    )
    + "SELECT image_id, det_id FROM lay WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.image_id = lay.image_id AND g.id = lay.det_id)",
)
def j10(spark, sf):
    return ov.drop_contained(_some(spark, sf), ["image_id"], "det_id").select("image_id", "det_id")


@query(
    "J10_contained_in_any",
    with_recursive("det")
    + _LAY
    + _removal_sql(
        _CONT.format(ab=f"{_AA} < {_AB} AND {_I} / ({_AA}) > 0.8e0", ba=f"{_AB} <= {_AA} AND {_I} / ({_AB}) > 0.8e0")
    )
    + "SELECT image_id, det_id FROM lay WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.image_id = lay.image_id AND g.id = lay.det_id)",
)
def j10_any(spark, sf):
    d = _some(spark, sf)
    return ov.drop_contained(d, ["image_id"], "det_id", 0.8, image_types_only=False, equal_area_counts=True).select("image_id", "det_id")


def _d(a: str, b: str) -> str:
    return f"sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2))"


_PLEN = " + ".join(_d(f"pts[{i}]", f"pts[{i + 1}]") for i in range(1, 5))


def _any_near(p: str, q: str) -> str:
    return f"len(list_filter({q}, lambda z: {_d(p, 'z')} < 15)) > 0"


@query(
    "J11_duplicate_paths",
    with_recursive("det", "paths")
    + f", pl AS (SELECT image_id, path_id, pts, {_PLEN} AS len FROM paths)"
    + _removal_sql(
        f"""SELECT a.image_id, a.path_id AS t1, b.path_id AS t2, CASE WHEN a.len >= b.len THEN a.path_id ELSE b.path_id END AS w,
  CASE WHEN a.len >= b.len THEN b.path_id ELSE a.path_id END AS l FROM pl a JOIN pl b ON a.image_id = b.image_id AND a.path_id < b.path_id
  WHERE ({_d('a.pts[1]', 'b.pts[1]')} < 15 AND {_d('a.pts[5]', 'b.pts[5]')} < 15) OR ({_d('a.pts[1]', 'b.pts[5]')} < 15 AND {_d('a.pts[5]', 'b.pts[1]')} < 15)
  OR (a.len < 30 AND ({_any_near('a.pts[1]', 'b.pts')} OR {_any_near('a.pts[5]', 'b.pts')})) OR (b.len < 30 AND ({_any_near('b.pts[1]', 'a.pts')} OR {_any_near('b.pts[5]', 'a.pts')}))"""
    )
    + "SELECT image_id, id AS path_id FROM gone",
)
def j11(spark, sf):
    return ov.duplicate_paths(paths(spark, sf), ["image_id"], "path_id").select("image_id", "path_id")


@query(
    "X10_resolve_merge",
    with_views("det")
    + _PAIRS
    + f"SELECT image_id, det_id FROM lay WHERE det_id NOT IN (SELECT CASE WHEN {_AA} >= {_AB} THEN b_det_id ELSE a_det_id END FROM pairs WHERE iou > 0.8)",
)
def x10_merge(spark, sf):
    return ov.resolve_merge(_some(spark, sf), _pairs(spark, sf), ["image_id"], "det_id").select("image_id", "det_id")


@query(
    "X10_resolve_priority",
    with_views("det")
    + _PAIRS
    + "SELECT image_id, det_id FROM lay WHERE det_id NOT IN (SELECT CASE WHEN a_score >= b_score THEN b_det_id ELSE a_det_id END FROM pairs)",
)
def x10_priority(spark, sf):
    return ov.resolve_priority(_some(spark, sf), _pairs(spark, sf), ["image_id"], "det_id").select("image_id", "det_id")


@query(
    "X10_resolve_layers",
    with_views("det")
    + _PAIRS
    + """SELECT l.image_id, l.det_id, CAST(CASE WHEN m.below IS NULL THEN l.layer ELSE least(l.layer, m.below) END AS INT) AS layer_level
  FROM lay l LEFT JOIN (SELECT a_det_id, min(b_layer) - 1 AS below FROM pairs WHERE relationship = 'contains' GROUP BY a_det_id) m ON m.a_det_id = l.det_id""",
)
def x10_layers(spark, sf):
    return ov.resolve_layers(_some(spark, sf), _pairs(spark, sf), ["image_id"], "det_id").select("image_id", "det_id", "layer_level")


@query(
    "X10_structure_suggestions",
    with_views("det")
    + _PAIRS
    + """SELECT image_id, a_det_id AS lower_id, b_det_id AS upper_id, CASE relationship WHEN 'contains' THEN 'container_child' WHEN 'stacked' THEN 'stacked_layers' ELSE 'partial_overlap' END AS suggestion
  FROM pairs WHERE relationship <> 'contained'""",
)
def x10_suggest(spark, sf):
    return ov.structure_suggestions(_pairs(spark, sf), ["image_id"], "det_id")


# --- A14 / J15 ----------------------------------------------------------------
_COVER = """, bx AS (SELECT DISTINCT image_id, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 60) AS x2, least(y2, 14) AS y2 FROM det),
xs AS (SELECT image_id, x, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS xe FROM (SELECT image_id, x1 AS x FROM bx UNION SELECT image_id, x2 FROM bx)),
ys AS (SELECT image_id, y, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS ye FROM (SELECT image_id, y1 AS y FROM bx UNION SELECT image_id, y2 FROM bx)),
cov AS (SELECT xs.image_id, sum((xe - x) * (ye - y)) AS covered FROM xs JOIN ys ON xs.image_id = ys.image_id WHERE xe IS NOT NULL AND ye IS NOT NULL
  AND EXISTS (SELECT 1 FROM bx WHERE bx.image_id = xs.image_id AND bx.x1 <= x AND bx.x2 >= xe AND bx.y1 <= y AND bx.y2 >= ye) GROUP BY xs.image_id)
"""


@query(
    "A14_coverage_score",
    with_views("det") + _COVER + "SELECT image_id, covered, greatest(0, 100 - covered / 840 * 100) AS overall_score FROM cov",
)
def a14(spark, sf):
    c = bx.clip(box(), F.lit(60.0), F.lit(14.0))
    d = det(spark, sf).select("image_id", *[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))])
    return ov.union_area(d, ["image_id"], cell=16.0).withColumn(
        "overall_score", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("covered") / 840 * 100)
    )


@query(
    "J15_covered_candidates",
    with_views("det")
    + """, c AS (SELECT image_id, det_id, x1, y1, x2, y2 FROM det WHERE category_id % 2 = 1),
px AS (SELECT c.*, u.ux, v.vy FROM c, (SELECT unnest(range(0, 110)) AS ux) u, (SELECT unnest(range(0, 20)) AS vy) v WHERE ux >= x1 AND ux < x2 AND vy >= y1 AND vy < y2),
hit AS (SELECT DISTINCT px.image_id, px.det_id, ux, vy FROM px JOIN det d ON d.image_id = px.image_id AND d.category_id % 2 = 0 AND d.x1 <= ux AND d.x2 > ux AND d.y1 <= vy AND d.y2 > vy)
SELECT c.image_id, c.det_id, coalesce(n, 0) / ((x2 - x1) * (y2 - y1)) AS covered_share FROM c LEFT JOIN (SELECT det_id, count(*) AS n FROM hit GROUP BY det_id) h ON h.det_id = c.det_id
WHERE coalesce(n, 0) / ((x2 - x1) * (y2 - y1)) <= 0.7e0""",
)
def j15(spark, sf):
    d = det(spark, sf)
    c = ov.covered_share(d.where("category_id % 2 = 1").select("image_id", "det_id", "x1", "y1", "x2", "y2"), d.where("category_id % 2 = 0"), ["image_id"], "det_id")
    return c.where("covered_share <= 0.7D").select("image_id", "det_id", "covered_share")


# --- X06 ------------------------------------------------------------------------
def _component_sql(nodes: str, edge: str) -> str:
    """Smallest reachable id per node, by repeated relaxation along the edges."""
    return f""", nodes AS ({nodes}),
e0 AS (SELECT a.image_id, a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND a.id < b.id WHERE {edge}),
e AS (SELECT image_id, a, b FROM e0 UNION ALL SELECT image_id, b, a FROM e0),
reach AS (SELECT image_id, id, id AS comp FROM nodes UNION SELECT r.image_id, e.b, r.comp FROM reach r JOIN e ON e.image_id = r.image_id AND e.a = r.id AND r.comp < e.b)
"""


def _comp(spark, sf, pad, condition, span=None):
    d = det(spark, sf)
    pairs = self_pairs(d, ["image_id"], "det_id", condition, pad=pad, span=span)
    edges = pairs.select("image_id", F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"))
    return components(d, edges, ["image_id"], "det_id")


_NODES = "SELECT image_id, det_id AS id, x1, y1, x2, y2 FROM det"
_IAB = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_UAB = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IAB})"
_MIN_COMP = "SELECT image_id, id AS det_id, min(comp) AS component FROM reach GROUP BY image_id, id"


@query("X06_overlap_groups", with_recursive("det") + _component_sql(_NODES, f"{_IAB} / {_UAB} >= 0.8e0") + _MIN_COMP)
def x06(spark, sf):
    from tessella.operators.spatial import span_for_ratio

    return _comp(spark, sf, 0.0, lambda a, b: bx.iou(box(a), box(b)) >= 0.8, span_for_ratio(0.8)).select("image_id", "det_id", "component")


@query(
    "X06_nearby_regions",
    with_recursive("det")
    + _component_sql(
        "SELECT image_id, det_id AS id, x1 * 20 AS x1, y1 * 30 AS y1, x1 * 20 + 9 AS x2, y1 * 30 + 9 AS y2 FROM det",
        "greatest(greatest(b.x1 - a.x2, a.x1 - b.x2, 0), greatest(b.y1 - a.y2, a.y1 - b.y2, 0)) < 12",
    )
    + """SELECT r.image_id, r.component, min(n.x1) AS x1, min(n.y1) AS y1, max(n.x2) AS x2, max(n.y2) AS y2, count(*) AS members
  FROM (SELECT image_id, id, min(comp) AS component FROM reach GROUP BY image_id, id) r JOIN nodes n ON n.image_id = r.image_id AND n.id = r.id GROUP BY r.image_id, r.component""",
)
def x06_regions(spark, sf):
    d = det(spark, sf).selectExpr("image_id", "det_id", "x1 * 20 AS x1", "y1 * 30 AS y1", "x1 * 20 + 9 AS x2", "y1 * 30 + 9 AS y2")
    pairs = self_pairs(d, ["image_id"], "det_id", lambda a, b: bx.gap(box(a), box(b)) < 12, pad=24.0)
    comp = components(d, pairs.select("image_id", F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b")), ["image_id"], "det_id")
    return (
        d.join(comp, ["image_id", "det_id"]).groupBy("image_id", "component")
        .agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("members"))
    )


# --- X09 ------------------------------------------------------------------------
_PTS = "SELECT image_id, det_id AS id, det_id % 101 AS px, image_id % 40 + category_id * 6 AS py FROM det"


@query(
    "X09_merge_close_points",
    with_recursive("det")
    + f""", p AS ({_PTS}), ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY id) AS rk FROM p),
walk AS (SELECT image_id, rk, [{{'id': id, 'px': px, 'py': py}}] AS kept FROM ranked WHERE rk = 1
  UNION ALL SELECT r.image_id, r.rk, CASE WHEN len(list_filter(w.kept, lambda k: sqrt(pow(k.px - r.px, 2) + pow(k.py - r.py, 2)) < 20)) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'id': r.id, 'px': r.px, 'py': r.py}}) END FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rk = w.rk + 1),
anchors AS (SELECT image_id, u.id AS id, u.px AS px, u.py AS py FROM (SELECT image_id, unnest(kept) AS u FROM (SELECT image_id, arg_max(kept, rk) AS kept FROM walk GROUP BY image_id))),
mem AS (SELECT p.image_id, p.id, p.px, p.py, min(a.id) AS anchor FROM p JOIN anchors a ON a.image_id = p.image_id AND sqrt(pow(a.px - p.px, 2) + pow(a.py - p.py, 2)) < 20 AND a.id <= p.id GROUP BY ALL)
SELECT image_id, anchor AS anchor_id, CAST(trunc(avg(px)) AS BIGINT) AS x, CAST(trunc(avg(py)) AS BIGINT) AS y, count(*) AS members FROM mem GROUP BY image_id, anchor""",
)
def x09(spark, sf):
    p = det(spark, sf).selectExpr(
        "image_id", "det_id", "CAST(det_id % 101 AS DOUBLE) AS x1", "CAST(image_id % 40 + category_id * 6 AS DOUBLE) AS y1"
    )
    p = p.withColumn("x2", F.col("x1")).withColumn("y2", F.col("y1"))
    c = greedy.greedy_cover(p, ["image_id"], "det_id", [], greedy.closer_than(20.0))
    return c.groupBy("image_id", "anchor_id").agg(
        F.avg("x1").cast("bigint").alias("x"), F.avg("y1").cast("bigint").alias("y"), F.count(F.lit(1)).alias("members")
    )


@query(
    "X09_merge_lines",
    with_recursive("det")
    + """, p AS (SELECT image_id, det_id AS id, CAST(det_id % 101 AS DOUBLE) AS pos, x1, x2 FROM det), ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY id) AS rk FROM p),
walk AS (SELECT image_id, rk, [{'id': id, 'pos': pos}] AS kept FROM ranked WHERE rk = 1
  UNION ALL SELECT r.image_id, r.rk, CASE WHEN len(list_filter(w.kept, lambda k: abs(k.pos - r.pos) < 10)) > 0 THEN w.kept ELSE list_append(w.kept, {'id': r.id, 'pos': r.pos}) END
  FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rk = w.rk + 1),
anchors AS (SELECT image_id, u.id AS id, u.pos AS pos FROM (SELECT image_id, unnest(kept) AS u FROM (SELECT image_id, arg_max(kept, rk) AS kept FROM walk GROUP BY image_id))),
mem AS (SELECT p.image_id, p.id, p.pos, p.x1, p.x2, min(a.id) AS anchor FROM p JOIN anchors a ON a.image_id = p.image_id AND abs(a.pos - p.pos) < 10 AND a.id <= p.id GROUP BY ALL)
SELECT image_id, anchor AS anchor_id, CAST(trunc(avg(pos)) AS BIGINT) AS pos, min(x1) AS start_at, max(x2) AS end_at FROM mem GROUP BY image_id, anchor""",
)
def x09_lines(spark, sf):
    d = det(spark, sf)
    p = d.select(
        "image_id", "det_id", (F.col("det_id") % 101).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("det_id") % 101).cast("double").alias("x2"),
        F.lit(0.0).alias("y2"), F.col("x1").alias("s"), F.col("x2").alias("e"),
    )
    c = greedy.greedy_cover(p, ["image_id"], "det_id", [], greedy.closer_than(10.0), carry=["s", "e"])
    return c.groupBy("image_id", "anchor_id").agg(F.avg("x1").cast("bigint").alias("pos"), F.min("s").alias("start_at"), F.max("e").alias("end_at"))


# --- X06 over text blocks ---------------------------------------------------------
_BLOCKS = """SELECT image_id, det_id AS id, x1 * 20 AS x1, y1 * 30 + category_id AS y1, x1 * 20 + (x2 - x1) AS x2, y1 * 30 + category_id + 10 + det_id % 4 AS y2, 6 + det_id % 9 AS font_size,
  CASE det_id % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Georgia' ELSE NULL END AS font, CASE det_id % 3 WHEN 0 THEN '#101010' WHEN 1 THEN '#181818' ELSE '#ff0000' END AS color FROM det"""
_VGAP, _HGAP = "least(abs(a.y1 - b.y2), abs(b.y1 - a.y2))", "least(abs(a.x1 - b.x2), abs(b.x1 - a.x2))"
_AH, _AW = "((a.y2 - a.y1 + b.y2 - b.y1) / 2)", "((a.x2 - a.x1 + b.x2 - b.x1) / 2)"
_YO, _XO = "(a.y2 >= b.y1 AND b.y2 >= a.y1)", "(a.x2 >= b.x1 AND b.x2 >= a.x1)"


def _blocks(spark, sf):
    return det(spark, sf).selectExpr(
        "image_id", "det_id", "x1 * 20 AS x1", "y1 * 30 + category_id AS y1", "x1 * 20 + (x2 - x1) AS x2", "y1 * 30 + category_id + 10 + det_id % 4 AS y2",
        "CAST(6 + det_id % 9 AS DOUBLE) AS font_size", "CASE det_id % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Georgia' END AS font",
        "CASE det_id % 3 WHEN 0 THEN '#101010' WHEN 1 THEN '#181818' ELSE '#ff0000' END AS color",
    )


_SIZES = """(CASE WHEN b.y1 - a.y2 < 0 AND a.y1 - b.y2 < 0 THEN 0 ELSE least(abs(b.y1 - a.y2), abs(a.y1 - b.y2)) END < least(a.y2 - a.y1, b.y2 - b.y1) * 0.5e0)
  AND a.x2 >= b.x1 AND b.x2 >= a.x1 AND (abs(a.font_size - b.font_size) < 2 OR abs(a.font_size - b.font_size) / ((a.font_size + b.font_size) / 2) < 0.05e0)"""


@query(
    "X06_font_size_clusters",
    with_recursive("det") + _component_sql(_BLOCKS, _SIZES)
    + """, c AS (SELECT image_id, id, min(comp) AS component FROM reach GROUP BY image_id, id)
SELECT n.id AS det_id, c.component, CAST(min(n.font_size) OVER (PARTITION BY c.image_id, c.component) AS DOUBLE) AS font_size FROM nodes n JOIN c ON c.image_id = n.image_id AND c.id = n.id""",
)
def x06_sizes(spark, sf):
    from tessella.operators import textblocks as tb, textclusters as tc

    c = tc.cluster_font_sizes(_blocks(spark, sf), "image_id", "det_id", near=2.0, relative=0.05)
    return tb.unify_minimum(c, ["image_id", "component"], "font_size").select("det_id", "component", "font_size")


@query(
    "X06_font_family_clusters",
    with_recursive("det")
    + _component_sql(
        _BLOCKS,
        f"(a.font IS NULL OR b.font IS NULL OR a.font = b.font) AND ((({_YO} OR {_VGAP} < {_AH} * 0.5e0) AND {_HGAP} < {_AW} * 0.2e0) OR (({_XO} OR {_HGAP} < {_AW} * 0.3e0) AND {_VGAP} < {_AH} * 0.4e0))",
    )
    + _MIN_COMP,
)
def x06_fonts(spark, sf):
    from tessella.operators import textclusters as tc

    return tc.cluster_fonts(_blocks(spark, sf), "image_id", "det_id", row_gap=0.2, col_gap=0.4).select("image_id", "det_id", "component")


@query(
    "X06_color_clusters",
    with_recursive("det")
    + _component_sql(_BLOCKS, f"{_YO} AND {_HGAP} < {_AW} * 0.5e0 AND ((a.color = '#ff0000') = (b.color = '#ff0000'))")
    + _MIN_COMP,
)
def x06_colors(spark, sf):
    from tessella.operators import textclusters as tc

    return tc.cluster_colors(_blocks(spark, sf), "image_id", "det_id").select("image_id", "det_id", "component")
