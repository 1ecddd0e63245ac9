from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import greedy
from tessella.plans.registry import query
from tessella.plans.relations import det, with_recursive

IOU_SQL = """
CASE WHEN greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) > 0
THEN greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)
 / ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)
    -greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0))
ELSE 0 END
"""


def first_fit_sql(view: str, order: str, conflict: str, final: str) -> str:
    """Greedy keep as a recursive walk over ranked rows with a list of kept boxes."""
    return f"""{with_recursive(*view.split())},
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rk FROM items),
walk AS (
  SELECT image_id, rk, [{{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'grp': grp}}] AS kept
  FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.image_id, r.rk,
    CASE WHEN len(list_filter(w.kept, lambda k: {conflict})) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'id': r.det_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'grp': r.grp}}) END
  FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rk = w.rk + 1
),
done AS (SELECT image_id, arg_max(kept, rk) AS kept FROM walk GROUP BY image_id)
{final}"""


INTER = "greatest(least(r.x2,k.x2)-greatest(r.x1,k.x1),0)*greatest(least(r.y2,k.y2)-greatest(r.y1,k.y1),0)"
AREA_R, AREA_K = "(r.x2-r.x1)*(r.y2-r.y1)", "(k.x2-k.x1)*(k.y2-k.y1)"


def _iou_over(t: str, op: str = ">") -> str:
    return f"({INTER}) / ({AREA_R} + {AREA_K} - {INTER}) {op} {t}"


def _kept_sql(items: str, order: str, conflict: str) -> str:
    sql = first_fit_sql("det", order, conflict, "SELECT image_id, u.id AS det_id FROM (SELECT image_id, unnest(kept) AS u FROM done)")
    return sql.replace("ranked AS (", f"items AS ({items}),\nranked AS (", 1)


@query(
    "X01_score_first_nms",
    _kept_sql("SELECT * FROM det", "score DESC, det_id", _iou_over("0.5")),
)
def x01(spark, sf):
    """Deduplicated detections per image (suppress IoU > 0.5, best score first)."""
    return greedy.greedy_keep(det(spark, sf), ["image_id"], "det_id", [-F.col("score")], greedy.iou_above(0.5)).select(
        "image_id", "det_id"
    )


@query(
    "X01_within_group_nms",
    # The walk goes by image_id: image and group in one number, parted again at the end.
    "SELECT image_id // 10 AS image_id, image_id % 10 AS priority, det_id FROM ("
    + _kept_sql("SELECT * REPLACE (image_id * 10 + priority AS image_id) FROM det WHERE score > 20000", "score DESC, det_id", _iou_over("0.85"))
    + ")",
)
def x01_group(spark, sf):
    """Within every group of an image, with a score prefilter and threshold 0.85."""
    d = det(spark, sf).where("score > 20000")
    return greedy.greedy_keep(d, ["image_id", "priority"], "det_id", [-F.col("score")], greedy.iou_above(0.85)).select("image_id", "priority", "det_id")


@query(
    "X03_smallest_first_nms",
    _kept_sql("SELECT * FROM det", "(x2-x1)*(y2-y1), det_id", _iou_over("0.3")),
)
def x03(spark, sf):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return greedy.greedy_keep(det(spark, sf), ["image_id"], "det_id", [area], greedy.iou_above(0.3)).select("image_id", "det_id")


@query(
    "X04_over_min_keep",
    first_fit_sql(
        "det",
        "score DESC, det_id",
        f"({INTER}) / least({AREA_R}, {AREA_K}) > 0.3",
        "SELECT image_id, det_id, det_id IN (SELECT u.id FROM (SELECT unnest(kept) AS u FROM done)) AS kept FROM items",
    ).replace("ranked AS (", "items AS (SELECT * FROM det),\nranked AS (", 1),
)
def x04(spark, sf):
    """Kept and removed rows when intersection over the smaller area must stay <= 0.3."""
    d = greedy.greedy_cover(det(spark, sf), ["image_id"], "det_id", [-F.col("score")], greedy.over_min_above(0.3))
    return d.select("image_id", "det_id", (F.col("anchor_id") == F.col("det_id")).alias("kept"))
