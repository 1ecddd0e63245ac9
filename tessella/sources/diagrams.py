"""Diagram markup: cell tables and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CELL = (
    "_id string, _parent string, _style string, _value string, _vertex string, _edge string, _source string, _target string, _connectable string, "
    "mxGeometry struct<_x: double, _y: double, _width: double, _height: double, mxPoint: array<struct<_as: string, _x: double, _y: double>>, "
    "Array: struct<_as: string, mxPoint: array<struct<_x: double, _y: double>>>>"
)
PAGE_SMALL, PAGE_WIDE = (800.0, 600.0), (1920.0, 1080.0)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of many diagram files as one table; the root cells 0 and 1 are dropped.

    Edges carry their free ends (``source_point``, ``target_point``) and waypoints (``points``). Unset flags are false.
    """
    raw = spark.read.format("xml").option("rowTag", "mxCell").schema(CELL).load(path)
    zero = F.lit(0.0)
    flag = lambda c: F.coalesce(F.col(c) == "1", F.lit(False))
    point = lambda p: F.struct(F.coalesce(p["_x"], zero).alias("x"), F.coalesce(p["_y"], zero).alias("y"))
    end = lambda name: F.get(F.transform(F.filter("mxGeometry.mxPoint", lambda p: p["_as"] == name), point), 0)
    waypoints = F.when(F.col("mxGeometry.Array._as") == "points", F.transform("mxGeometry.Array.mxPoint", point))
    return raw.select(
        F.col("_metadata.file_name").alias("doc"), F.col("_id").alias("id"), F.col("_parent").alias("parent"), F.col("_style").alias("style"), F.col("_value").alias("value"),
        flag("_vertex").alias("vertex"), flag("_edge").alias("edge"), F.col("_connectable").alias("connectable"), F.col("_source").alias("source"), F.col("_target").alias("target"),
        F.coalesce("mxGeometry._x", zero).alias("x"), F.coalesce("mxGeometry._y", zero).alias("y"), F.coalesce("mxGeometry._width", zero).alias("width"),
        F.coalesce("mxGeometry._height", zero).alias("height"), end("sourcePoint").alias("source_point"), end("targetPoint").alias("target_point"),
        F.coalesce(waypoints, F.array().cast("array<struct<x:double,y:double>>")).alias("points"),
    ).where("id NOT IN ('0', '1')")


def read_page_sizes(spark: SparkSession, path: str, default: tuple[float, float] = PAGE_SMALL) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "mxGraphModel").schema("_pageWidth string, _pageHeight string").load(path)
    return raw.select(
        F.col("_metadata.file_name").alias("doc"), F.coalesce(F.col("_pageWidth").try_cast("double"), F.lit(default[0])).alias("page_width"),
        F.coalesce(F.col("_pageHeight").try_cast("double"), F.lit(default[1])).alias("page_height"),
    )


def cells_from_column(df: DataFrame, xml: str) -> DataFrame:
    """Cells out of a column of markup: one row per cell with id, parent, style, value and geometry."""
    cells = df.withColumn("_c", F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(<mxCell\b(?:[^>]*/>|[\s\S]*?</mxCell>))"), 1)))
    # Both tags are columns, not expressions, so that each is searched for once and not by every attribute.
    cells = cells.withColumn("_tag", F.regexp_extract("_c", r"^(<mxCell\b[^>]*>)", 1)).withColumn("_geo", F.regexp_extract("_c", r"(<mxGeometry\b[^>]*>)", 1))
    tag, geo = F.col("_tag"), F.col("_geo")

    def attr(src, name):
        return F.get(F.regexp_extract_all(src, F.lit(rf'\s{name}="([^"]*)"'), 1), F.lit(0))

    num = lambda n: F.coalesce(attr(geo, n).try_cast("double"), F.lit(0.0))
    return cells.select(
        *[c for c in df.columns if c != xml], attr(tag, "id").alias("id"), attr(tag, "parent").alias("parent"), attr(tag, "style").alias("style"), attr(tag, "value").alias("value"),
        (F.coalesce(attr(tag, "vertex"), F.lit("")) == "1").alias("vertex"), (F.coalesce(attr(tag, "edge"), F.lit("")) == "1").alias("edge"),
        num("x").alias("x"), num("y").alias("y"), num("width").alias("width"), num("height").alias("height"), F.col("_c").alias("markup"),
    ).where("id IS NULL OR id NOT IN ('0', '1')")


def geometry_boxes(df: DataFrame, xml: str, width: int, height: int) -> DataFrame:
    """Boxes of all geometry tags of a markup column, cut to the page; empty ones are dropped."""
    pattern = r'<mxGeometry\s+x="([^"]+)"\s+y="([^"]+)"\s+width="([^"]+)"\s+height="([^"]+)"'
    found = [F.transform(F.regexp_extract_all(F.col(xml), F.lit(pattern), i), lambda s: s.try_cast("double")) for i in (1, 2, 3, 4)]
    rows = df.select(*[c for c in df.columns if c != xml], F.posexplode(F.arrays_zip(*[a.alias(n) for a, n in zip(found, "xywh")])).alias("k", "g"))
    x, y, w, h = (F.col(f"g.{n}") for n in "xywh")
    cutoff = lambda v: v.cast("bigint")
    out = rows.select(
        *[c for c in rows.columns if c != "g"], F.greatest(F.lit(0), cutoff(x)).alias("x1"), F.greatest(F.lit(0), cutoff(y)).alias("y1"),
        F.least(F.lit(width), cutoff(x + w)).alias("x2"), F.least(F.lit(height), cutoff(y + h)).alias("y2"),
    )
    return out.where("x2 > x1 AND y2 > y1")
