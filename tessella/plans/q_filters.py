"""Filters over detections, queries, objects and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import boxes as bx, rules
from tessella.functions.boxes import box
from tessella.operators import datasets as ds
from tessella.plans.registry import query
from tessella.plans.relations import det, rel, with_views


@query(
    "F01_score_area_per_group",
    with_views("det")
    + """
SELECT det_id, grp FROM det WHERE score / 100000 > CASE grp WHEN 'arrow' THEN 0.45e0 ELSE 0.5e0 END
  AND (x2 - x1) * (y2 - y1) >= CASE grp WHEN 'arrow' THEN 50 WHEN 'image' THEN 100 ELSE 200 END""",
)
def f01(spark, sf):
    g = rules.PROMPT_GROUPS
    score = rules.lookup(F.col("grp"), {k: v[0] for k, v in g.items()})
    area = rules.lookup(F.col("grp"), {k: v[1] for k, v in g.items()})
    return det(spark, sf).where((F.col("score") / 100000 > score) & (box().area >= area)).select("det_id", "grp")


def not_text_like(prompt):
    """Prompts that name text, as whole words and as parts."""
    p = F.lower(prompt)
    return ~p.isin("text", "word", "label") & ~p.contains("text") & ~p.contains("word")


@query(
    "F02_text_prompts",
    with_views("det")
    + "SELECT det_id, concat(element_type, ' ', grp) AS prompt FROM det WHERE NOT contains(concat(element_type, ' ', grp), 'text')",
)
def f02(spark, sf):
    p = F.concat_ws(" ", "element_type", "grp")
    return det(spark, sf).where(not_text_like(p)).select("det_id", p.alias("prompt"))


@query("F03_full_size", with_views("det") + "SELECT det_id FROM det WHERE (x2 - x1) * (y2 - y1) / 520e0 < 0.95e0")
def f03(spark, sf):
    return det(spark, sf).where(box().area / F.lit(520.0) < 0.95).select("det_id")


@query(
    "F04_border_margin",
    with_views("det")
    + "SELECT det_id FROM det WHERE (x1 + x2) / 2 / 40 > 0.025e0 AND (x1 + x2) / 2 / 40 < 0.975e0 AND (y1 + y2) / 2 / 20 > 0.025e0 AND (y1 + y2) / 2 / 20 < 0.975e0",
)
def f04(spark, sf):
    cx, cy, _, _ = bx.xyxy_to_cxcywh(box())
    u, v, m = cx / 40, cy / 20, 0.025
    return det(spark, sf).where((u > m) & (u < 1 - m) & (v > m) & (v < 1 - m)).select("det_id")


_CHANNEL = """SELECT det_id, '{n}' AS channel FROM det WHERE (x2 - x1) * (y2 - y1) >= 2000 * {lo} AND (x2 - x1) * (y2 - y1) <= 2000 * {hi}
  AND greatest(x2 - x1, y2 - y1) / greatest(1, least(x2 - x1, y2 - y1)) <= 8 AND (y1 * 40) / ((x2 - x1) * (y2 - y1)) >= {fill}"""


@query(
    "F05_component_channels",
    with_views("det")
    + _CHANNEL.format(n="fine", lo="0.0005e0", hi="0.2e0", fill="0.15e0")
    + " UNION ALL "
    + _CHANNEL.format(n="coarse", lo="0.002e0", hi="0.3e0", fill="0.2e0"),
)
def f05(spark, sf):
    b, image = box(), F.lit(2000.0)

    def channel(name, lo, hi, fill):
        aspect = F.greatest(b.width, b.height) / F.greatest(F.lit(1.0), F.least(b.width, b.height))
        ok = (b.area >= image * lo) & (b.area <= image * hi) & (aspect <= 8) & (F.col("y1") * 40 / b.area >= fill)
        return det(spark, sf).where(ok).select("det_id", F.lit(name).alias("channel"))

    return channel("fine", 0.0005, 0.2, 0.15).unionByName(channel("coarse", 0.002, 0.3, 0.2))


@query(
    "F06_region_skip_rules",
    with_views("det") + "SELECT det_id FROM det WHERE category_id <> 7 AND (x2 - x1) * (y2 - y1) >= 100 AND (x2 - x1) * (y2 - y1) >= 2000 * 0.0005e0",
)
def f06(spark, sf):
    d = det(spark, sf).withColumn("bbox", F.when(F.col("category_id") == 7, F.array("x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2")))
    b = bx.box_from_array(F.col("bbox"))
    return d.where((F.size("bbox") == 4) & (b.area >= 100) & (b.area >= F.lit(2000.0) * 0.0005)).select("det_id")


def is_zero_box(b):
    return b.isNull() | (F.size(b) < 4) | F.forall(F.slice(b, 1, 4), lambda v: v <= 0)


@query(
    "F07_zero_boxes",
    with_views("det") + "SELECT det_id FROM det WHERE category_id NOT IN (1, 2) AND NOT (x1 - 40 <= 0 AND y1 - 40 <= 0 AND x2 - 40 <= 0 AND y2 - 40 <= 0)",
)
def f07(spark, sf):
    b = F.when(F.col("category_id") == 2, F.array("x1", "y1")).when(F.col("category_id") > 2, F.transform(F.array("x1", "y1", "x2", "y2"), lambda v: v - 40))
    return det(spark, sf).withColumn("b", b).where(~is_zero_box(F.col("b"))).select("det_id")


@query(
    "F08_exhaustive_images",
    """SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def f08(spark, sf):
    first = rel(spark, sf, "documents").where("doc_id % 5 <> 0").select("doc_id")
    labels = rel(spark, sf, "labels")
    out = labels.where("toxic = 1").select("doc_id").union(labels.where("quality = 0").select("doc_id")).distinct()
    return first.join(out, "doc_id", "left_anti")


_FQ = with_views("det", "find_queries", "query_objects") + """
, q AS (SELECT f.*, coalesce(o.object_ids, []) AS object_ids FROM find_queries f LEFT JOIN
  (SELECT query_id, array_agg(object_id ORDER BY object_id) AS object_ids FROM query_objects GROUP BY query_id) o ON f.query_id = o.query_id)
"""


def find_queries(spark, sf):
    return ds.attach_objects(rel(spark, sf, "find_queries"), rel(spark, sf, "query_objects"))


@query("F09_query_text", _FQ + "SELECT query_id FROM q WHERE query_text <> '1-URGENT'")
def f09a(spark, sf):
    return ds.without_text(find_queries(spark, sf), "1-URGENT").select("query_id")


@query(
    "F09_zero_area_hits",
    _FQ + "SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM query_objects WHERE x1 = x2 OR y1 = y2)",
)
def f09b(spark, sf):
    return ds.without_zero_area_hits(rel(spark, sf, "find_queries"), rel(spark, sf, "query_objects")).select("query_id")


@query("F09_too_many_objects", _FQ + "SELECT query_id, len(object_ids) AS n FROM q WHERE len(object_ids) <= 4")
def f09c(spark, sf):
    return ds.without_many_objects(find_queries(spark, sf), 4).select("query_id", F.size("object_ids").alias("n"))


@query(
    "F09_exhaustive_queries",
    _FQ + "SELECT query_id, 'instance' AS kind FROM q WHERE is_exhaustive UNION ALL SELECT query_id, 'pixel' FROM q WHERE is_pixel_exhaustive IS NULL OR is_pixel_exhaustive",
)
def f09d(spark, sf):
    q = rel(spark, sf, "find_queries")
    kinds = [ds.exhaustive_only(q, k).select("query_id", F.lit(k).alias("kind")) for k in ("instance", "pixel")]
    return kinds[0].unionByName(kinds[1])


@query("F09_empty_geometric", _FQ + "SELECT query_id FROM q WHERE NOT (has_box AND query_text = 'geometric' AND len(object_ids) = 0)")
def f09e(spark, sf):
    return ds.without_empty_geometric(find_queries(spark, sf)).select("query_id")


@query("F09_semantic_only", _FQ + "SELECT query_id FROM q WHERE NOT has_box")
def f09f(spark, sf):
    return ds.semantic_only(rel(spark, sf, "find_queries")).select("query_id")


_CASCADE = _FQ + """
, s AS (SELECT * FROM q WHERE NOT has_box),
m AS (SELECT *, dense_rank() OVER (PARTITION BY datapoint_id ORDER BY stage) - 1 AS new_stage, dense_rank() OVER (PARTITION BY datapoint_id ORDER BY image_no) - 1 AS new_image_no FROM s),
l AS (SELECT m.datapoint_id, m.query_id, m.image_no, o.object_id FROM query_objects o JOIN m ON o.query_id = m.query_id AND o.datapoint_id = m.datapoint_id WHERE NOT (o.area < 1e-6 OR o.is_crowd)),
n AS (SELECT *, dense_rank() OVER (PARTITION BY datapoint_id, image_no ORDER BY object_id) - 1 AS new_object_id FROM l)
"""


def _cascade(spark, sf):
    survivors = ds.semantic_only(rel(spark, sf, "find_queries"))
    return ds.cascade(survivors, rel(spark, sf, "query_objects"), (F.col("area") < 1e-6) | F.col("is_crowd"))


@query("F10_cascade_queries", _CASCADE + "SELECT query_id, CAST(new_stage AS INT) AS new_stage, CAST(new_image_no AS INT) AS new_image_no FROM m")
def f10a(spark, sf):
    return _cascade(spark, sf)[0].select("query_id", "new_stage", "new_image_no")


@query("F10_cascade_objects", _CASCADE + "SELECT query_id, object_id, new_object_id FROM n")
def f10b(spark, sf):
    return _cascade(spark, sf)[1].select("query_id", "object_id", "new_object_id")


@query("F10_cascade_failures", _CASCADE + "SELECT datapoint_id FROM m GROUP BY datapoint_id HAVING min(stage) > 0")
def f10c(spark, sf):
    return _cascade(spark, sf)[2]


@query(
    "F12_category_split",
    with_views("det")
    + "SELECT det_id, CASE WHEN category_id IN (1, 2, 3) THEN 'known' WHEN category_id = 4 THEN 'distractor' ELSE 'unknown' END AS split FROM det WHERE category_id NOT IN (1, 2, 3)",
)
def f12(spark, sf):
    d = det(spark, sf)
    split = ds.category_split(d.select("category_id").distinct(), [1, 2, 3], [4])
    parts = [ds.keep_split(d, split, s).select("det_id", F.lit(s).alias("split")) for s in ("distractor", "unknown")]
    return parts[0].unionByName(parts[1])
