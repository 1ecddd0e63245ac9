"""Diagram cells: parent chains, edges, z-order, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import styles
from tessella.functions.boxes import box
from tessella.operators.numbering import ordinal
from tessella.session import cut


def z_order(elements: DataFrame, doc: str, arrival: str) -> DataFrame:
    """Cell ids from 2 in drawing order: layer up, area down, then arrival."""
    size_class = F.ceil(F.log2(F.greatest(box().area, F.lit(1.0))))
    return ordinal(
        elements, [doc], [F.col("layer_level"), -size_class], [-box().area, F.col(arrival)], "cell_id", start=2
    )


def collect_fragments(*sources: DataFrame) -> DataFrame:
    """Union in order; a fragment whose id an earlier source already has is skipped."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select("element_id").distinct(), "element_id", "left_anti"), allowMissingColumns=True)
    return out


def parent_offsets(cells: DataFrame) -> DataFrame:
    """(doc, id, off_x, off_y): summed positions of all ancestors of a cell.

    Chains end at ids 0 and 1 or at a missing parent. Pointers are doubled, so a chain of
    depth d takes log2(d) joins; a chain that never ends (a cycle) is reported.
    """
    nodes = cells.select("doc", "id", F.when(F.col("parent").isin("0", "1"), None).otherwise(F.col("parent")).alias("ptr"), "x", "y")
    known = nodes.select("doc", F.col("id").alias("ptr"))
    live = nodes.join(known.withColumn("_ok", F.lit(True)), ["doc", "ptr"], "left")
    step = live.select("doc", "id", F.when(F.col("_ok"), F.col("ptr")).alias("ptr"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    # sx, sy of a node: its own position plus that of the ancestors skipped so far.
    for _ in range(64):
        step = cut(step)
        if step.where("ptr IS NOT NULL").isEmpty():
            break
        up = step.select("doc", F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("sx").alias("_x"), F.col("sy").alias("_y"))
        step = step.join(up, ["doc", "ptr"], "left").select(
            "doc", "id", F.col("_p").alias("ptr"), (F.col("sx") + F.coalesce("_x", F.lit(0.0))).alias("sx"), (F.col("sy") + F.coalesce("_y", F.lit(0.0))).alias("sy")
        )
    else:
        raise ValueError("parent chain without end: the cell table has a cycle")
    own = cells.select("doc", "id", "x", "y")
    return step.join(own, ["doc", "id"]).select("doc", "id", (F.col("sx") - F.col("x")).alias("off_x"), (F.col("sy") - F.col("y")).alias("off_y"))


def resolve_edges(cells: DataFrame, arrows_default: bool = True) -> DataFrame:
    """Edges with their end shapes: dangling edges go, free ends become zero-size shapes.

    Needs source/target ids and, for free edges, ``source_point``/``target_point`` structs.
    """
    shapes = cells.where("vertex").select("doc", "id", "x", "y", "width", "height")
    edges = cells.where("NOT vertex")
    free = (F.col("source").isNull() | F.col("target").isNull()) & F.col("source_point").isNotNull() & F.col("target_point").isNotNull()
    src = shapes.select("doc", F.col("id").alias("source"), *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "width", "height")])
    dst = shapes.select("doc", F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in ("x", "y", "width", "height")])
    tied = edges.where("source IS NOT NULL AND target IS NOT NULL").join(src, ["doc", "source"]).join(dst, ["doc", "target"])
    zero = F.lit(0.0)
    loose = edges.where(free).select(
        "*", F.col("source_point.x").alias("s_x"), F.col("source_point.y").alias("s_y"), zero.alias("s_width"), zero.alias("s_height"),
        F.col("target_point.x").alias("t_x"), F.col("target_point.y").alias("t_y"), zero.alias("t_width"), zero.alias("t_height"),
    )
    name = F.lower(F.coalesce(styles.value(F.col("style"), "edgeStyle"), F.lit("")))
    dashed = styles.value(F.col("style"), "dashed")
    return (
        tied.unionByName(loose)
        .withColumn("edge_style", F.when(name.contains("orthogonal") | name.contains("elbow"), "orthogonal").when(name.contains("curved"), "curved").otherwise("straight"))
        .withColumn("dash", F.when(dashed.isin("1", "true"), "dashed").otherwise(dashed))
        .withColumn("end_arrow", F.coalesce(styles.value(F.col("style"), "endArrow"), F.lit("classic" if arrows_default else None)))
    )


def edge_labels(cells: DataFrame) -> DataFrame:
    """Label cells: vertices whose parent is an edge, styled as edge label or not connectable."""
    edges = cells.where("NOT vertex").select("doc", F.col("id").alias("parent"))
    labels = cells.where(F.col("vertex") & (F.col("style").contains("edgeLabel") | (F.col("connectable") == "0")))
    return labels.join(edges, ["doc", "parent"], "left_semi")


def shift_waypoints(edges: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add the absolute position of the edge's parent chain to its waypoints.

    ``offsets`` gives each cell the sum over its ancestors, so the shift of an edge is its own row.
    """
    moved = F.transform("points", lambda p: F.struct((p["x"] + F.col("off_x")).alias("x"), (p["y"] + F.col("off_y")).alias("y")))
    return edges.join(offsets, ["doc", "id"], "left").withColumn("points", F.when(F.col("off_x").isNull(), F.col("points")).otherwise(moved)).drop("off_x", "off_y")


def scaled_geometry(c: Column, factor: float) -> Column:
    """Scaled coordinate cut to an integer."""
    return (c * factor).cast("bigint")
