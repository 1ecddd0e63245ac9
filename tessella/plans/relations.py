"""Relations the queries run on, derived from the supplied tables.

Each relation exists twice: as a DataFrame and as the text of a SQL view, so that the
query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TYPES = ("icon", "picture", "rectangle", "arrow", "section_panel", "text", "container")

_BOX = """
  CAST(l_partkey % 50 AS DOUBLE) AS x1,
  CAST(l_suppkey % 7 AS DOUBLE) AS y1,
  CAST(l_partkey % 50 AS DOUBLE) + l_quantity AS x2,
  CAST(l_suppkey % 7 AS DOUBLE) + 10 AS y2
"""

_DET_BODY = f"""
SELECT image_id, l_orderkey * 1000 + l_linenumber * 100 + dup AS det_id, x1, y1, x2, y2, score,
  CASE l_linenumber WHEN 1 THEN 'icon' WHEN 2 THEN 'picture' WHEN 3 THEN 'rectangle' WHEN 4 THEN 'arrow'
    WHEN 5 THEN 'section_panel' WHEN 6 THEN 'text' ELSE 'container' END AS element_type,
  CASE l_returnflag WHEN 'A' THEN 'shape' WHEN 'N' THEN 'image' ELSE 'arrow' END AS grp,
  CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 4 END AS priority,
  l_linestatus AS side, l_linenumber AS category_id
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice AS score,
  {{imgdiv}} AS image_id, {_BOX},
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS dup
  FROM lineitem) AS src
"""

DET = _DET_BODY.replace("{imgdiv}", "l_orderkey // 15")
# An order lies in one image, so Spark deals the rows by image and numbers copies inside it: what works image by image
# goes on in the same tasks instead of being shuffled again. The order ends with the columns it leaves open, so that every reader
# needs the same columns and Spark deals the rows once for all readers of a query.
_SPARK_DET = (
    _DET_BODY.replace("{imgdiv} AS image_id", "image_id")
    .replace("PARTITION BY l_orderkey", "PARTITION BY image_id, l_orderkey")
    .replace("l_shipdate)", "l_shipdate, l_linestatus, l_returnflag)")
    .replace("FROM lineitem", "FROM (SELECT /*+ REPARTITION(image_id) */ * FROM (SELECT *, l_orderkey div 15 AS image_id FROM lineitem))")
)

GT = """
SELECT image_id, det_id AS gt_id, x1 + category_id - 3 AS x1, y1, x2 + category_id - 3 AS x2, y2, category_id
FROM det WHERE side = 'F'
"""

LOG = """
SELECT event_id, ts, event_type AS module, value AS duration_ms,
  CASE WHEN user_id % 10 < 8 THEN 'success' ELSE 'error' END AS status
FROM events
"""

SQL: dict[str, str] = {"det": DET, "gt": GT, "request_log": LOG}


def with_views(*names: str) -> str:
    """``WITH`` prefix for the named relations, in order."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].strip()})" for n in names) + "\n"


def with_recursive(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n].strip()})" for n in names)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ROWS = 1 << 20  # that one task sorts


def det(spark: SparkSession, sf: str, rows: int = ROWS) -> DataFrame:
    """Detections: lineitem rows as boxes, 15 orders to an image.

    A larger table is dealt to more tasks than the session's shuffles have, so that a task takes about ``rows`` of it and no more memory.
    """
    li = table(spark, sf, "lineitem")
    parts = -(-li.count() // rows)
    dealt = _SPARK_DET if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")) else _SPARK_DET.replace("REPARTITION(", f"REPARTITION({parts}, ")
    return spark.sql(dealt.replace("FROM lineitem", "FROM {li}"), li=li)


def gt(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth: part of the detections, moved sideways by category."""
    return spark.sql(GT.replace("FROM det", "FROM {d}"), d=det(spark, sf))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(LOG.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))


# Detections drawn apart inside their image: each can only meet the ground truth made from it, so what
# matches what is beyond doubt and SQL can say it. Every fifth image is a negative one.
SQL["apart"] = """
SELECT image_id, det_id, x1 + 200 * (det_id - image_id * 15000) AS x1, y1, x2 + 200 * (det_id - image_id * 15000) AS x2, y2, score, category_id, side FROM det
"""
for _name, _side, _shift in (("gt_apart", "F", 3), ("gt_other", "O", 4)):
    SQL[_name] = f"""
SELECT image_id, det_id AS gt_id, x1 + category_id - {_shift} AS x1, y1, x2 + category_id - {_shift} AS x2, y2, det_id % 17 = 0 AS is_crowd FROM apart WHERE side = '{_side}' AND image_id % 5 <> 0
"""


# --- more relations ---------------------------------------------------------
TWO_BOXES = """
SELECT det_id, image_id, score, element_type, category_id, x1 AS a_x1, y1 AS a_y1, x2 AS a_x2, y2 AS a_y2,
  CAST(det_id % 40 AS DOUBLE) AS b_x1, CAST(category_id AS DOUBLE) AS b_y1,
  CAST(det_id % 40 + image_id % 20 + 1 AS DOUBLE) AS b_x2, CAST(category_id + det_id % 11 + 1 AS DOUBLE) AS b_y2
FROM det
"""

PATH_POINTS = (
    ("det_id % 101", "image_id % 40"),
    ("x2", "category_id * 6"),
    ("x2 + det_id % 2", "category_id * 6 + det_id % 3"),
    ("det_id % 89", "x1"),
    ("image_id % 97", "y1 * 5"),
)

SQL["two_boxes"] = TWO_BOXES
SQL["paths"] = (
    "SELECT det_id AS path_id, image_id, category_id, ["
    + ", ".join(f"{{'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE)}}" for x, y in PATH_POINTS)
    + "] AS pts FROM det"
)
QUAD_POINTS = (("x1", "y1"), ("x2", "y1 + category_id - 3"), ("x2", "y2 + category_id - 3"), ("x1", "y2"))
SQL["quads"] = (
    "SELECT det_id, image_id, category_id, score, ["
    + ", ".join(f"{{'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE)}}" for x, y in QUAD_POINTS)
    + "] AS poly FROM det"
)


def two_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TWO_BOXES.replace("FROM det", "FROM {d}"), d=det(spark, sf))


def _points(points) -> str:
    return "array(" + ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in points) + ")"


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf).selectExpr("det_id AS path_id", "image_id", "category_id", f"{_points(PATH_POINTS)} AS pts")


def quads(spark: SparkSession, sf: str) -> DataFrame:
    return det(spark, sf).selectExpr("det_id", "image_id", "category_id", "score", f"{_points(QUAD_POINTS)} AS poly")


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def run(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run SQL over the tables and relations it names after FROM and JOIN."""
    names = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql)) & (set(TABLES) | set(SQL))
    bound = {n: rel(spark, sf, n) for n in names}
    text = re.sub(r"\b(FROM|JOIN)\s+([a-z_]+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in bound else m[0], sql)
    return spark.sql(text.replace("//", " div "), **bound)


def _truth_apart(name: str):
    """Ground truth drawn apart. A condition on the image alone would be moved below the dealing of its detections, and Spark would
    deal them once more for readers without it; side and image in one condition keep the dealing common to all."""
    text = re.sub(r"WHERE side = ('\w') AND image_id % 5 <> 0", r"WHERE CAST(side = \1 AS INT) * (image_id % 5) <> 0", SQL[name])
    return lambda spark, sf: run(spark, sf, text)


_FRAMES = {
    "det": det, "gt": gt, "request_log": request_log, "two_boxes": two_boxes, "paths": paths, "quads": quads,
    "gt_apart": _truth_apart("gt_apart"), "gt_other": _truth_apart("gt_other"),
}


def rel(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table or a derived relation by name."""
    if name in TABLES:
        return table(spark, sf, name)
    if name in _FRAMES:
        return _FRAMES[name](spark, sf)
    return run(spark, sf, SQL[name])


SQL["find_queries"] = """
SELECT o_orderkey AS query_id, o_orderkey // 15 AS datapoint_id, o_orderkey % 3 AS image_no, (o_custkey % 4) * 2 AS stage,
  CASE WHEN o_custkey % 10 = 0 THEN 'geometric' ELSE o_orderpriority END AS query_text, o_custkey % 6 = 0 AS has_box,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 5 <> 0 END AS is_exhaustive,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 8 <> 0 END AS is_pixel_exhaustive
FROM orders
"""
SQL["query_objects"] = """
SELECT det_id // 1000 AS query_id, image_id AS datapoint_id, det_id AS object_id, category_id = 6 AS is_crowd,
  CASE WHEN category_id = 5 THEN 0e0 ELSE (x2 - x1) * (y2 - y1) END AS area, x1, y1, CASE WHEN category_id = 5 THEN x1 ELSE x2 END AS x2, y2
FROM det
"""
SQL["cells"] = """
SELECT r_regionkey AS doc, concat('r', r_regionkey) AS id, '1' AS parent, TRUE AS vertex, CAST(NULL AS STRING) AS source, CAST(NULL AS STRING) AS target,
  'swimlane;html=1' AS style, r_name AS value, CAST(r_regionkey * 100 AS DOUBLE) AS x, 10e0 AS y, 400e0 AS width, 300e0 AS height FROM region
UNION ALL SELECT n_regionkey, concat('n', n_nationkey), concat('r', n_regionkey), TRUE, NULL, NULL, 'rounded=1;html=1', n_name,
  CAST(n_nationkey * 7 AS DOUBLE), 20e0, 80e0, 60e0 FROM nation
UNION ALL SELECT n_regionkey, concat('s', s_suppkey), concat('n', s_nationkey), TRUE, NULL, NULL, 'ellipse;html=1', s_name,
  CAST(s_suppkey % 50 AS DOUBLE), CAST(s_suppkey % 11 AS DOUBLE), 20e0, 10e0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, concat('c', c_custkey), concat('n', c_nationkey), TRUE, NULL, NULL, 'text;html=1', c_name,
  CAST(c_custkey % 60 AS DOUBLE), CAST(c_custkey % 13 AS DOUBLE), 16e0, 8e0 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, concat('o', o_orderkey), CASE WHEN o_orderkey % 5 = 0 THEN concat('n', c_nationkey) ELSE '1' END, FALSE, concat('c', o_custkey),
  CASE WHEN o_orderkey % 11 = 0 THEN 's-none' ELSE concat('c', c_custkey) END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'edgeStyle=orthogonalEdgeStyle;dashed=1' WHEN o_orderkey % 3 = 1 THEN 'curved=1;edgeStyle=curvedEdge;endArrow=open' ELSE 'html=1;dashed=dotted' END,
  o_orderpriority, CAST(o_orderkey % 90 AS DOUBLE), CAST(o_orderkey % 40 AS DOUBLE), 0e0, 0e0
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
