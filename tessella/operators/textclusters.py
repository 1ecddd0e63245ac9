"""Clusters and groups of text blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import styles, texts
from tessella.functions.boxes import Box
from tessella.operators.cluster import components
from tessella.operators.numbering import ordinal
from tessella.operators.spatial import self_pairs

_XY = ("x1", "y1", "x2", "y2")


def _cluster(blocks: DataFrame, key: str, id_col: str, reach_x: float, reach_y: float, carry: list[str], rule: Callable) -> DataFrame:
    """Components of ``rule`` over blocks that come within a share of their own size of each other.

    A gap below ``r`` times the mean (or smaller) size is at most ``r/2`` of either block's own
    size on its side, so blocks are searched by boxes grown by that share; ``rule`` sees the true ones.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    true_box = F.struct(*_XY)
    grown = blocks.select(
        key, id_col, *carry, true_box.alias("t"), (F.col("x1") - w * reach_x / 2).alias("x1"), (F.col("y1") - h * reach_y / 2).alias("y1"),
        (F.col("x2") + w * reach_x / 2).alias("x2"), (F.col("y2") + h * reach_y / 2).alias("y2"),
    )

    def where(a, b):
        side = lambda p: Box(*(F.col(f"{p}t")[c] for c in _XY))
        return rule(side(a), side(b), a, b)

    pairs = self_pairs(grown, [key], id_col, where, carry=["t", *carry])
    comp = components(blocks, pairs.select(key, F.col(f"a_{id_col}").alias("a"), F.col(f"b_{id_col}").alias("b")), [key], id_col)
    return blocks.join(comp, [key, id_col])


def _gaps(a: Box, b: Box) -> tuple[Column, Column]:
    """Smallest distance between facing edges, horizontal and vertical (not 0 when overlapping)."""
    return F.least(F.abs(a.x1 - b.x2), F.abs(b.x1 - a.x2)), F.least(F.abs(a.y1 - b.y2), F.abs(b.y1 - a.y2))


def _overlap_x(a: Box, b: Box) -> Column:
    return (a.x2 >= b.x1) & (b.x2 >= a.x1)


def _overlap_y(a: Box, b: Box) -> Column:
    return (a.y2 >= b.y1) & (b.y2 >= a.y1)


def cluster_font_sizes(blocks: DataFrame, key: str, id_col: str, line_share: float = 0.5, near: float = 5.0, relative: float = 0.3) -> DataFrame:
    """Blocks stacked closely, overlapping sideways and alike in size."""

    def rule(a, b, p, q):
        down, up = b.y1 - a.y2, a.y1 - b.y2
        gap = F.when((down < 0) & (up < 0), 0.0).otherwise(F.least(F.abs(down), F.abs(up)))
        low = F.least(a.height, b.height)
        fa, fb = F.col(f"{p}font_size"), F.col(f"{q}font_size")
        diff, mean = F.abs(fa - fb), (fa + fb) / 2
        alike = (diff < near) | (diff / F.when(mean > 0, mean).otherwise(1.0) < relative)
        return (gap < F.when(low > 0, low).otherwise(1.0) * line_share) & _overlap_x(a, b) & alike

    return _cluster(blocks, key, id_col, 0.0, line_share, ["font_size"], rule)


def cluster_fonts(blocks: DataFrame, key: str, id_col: str, row_gap: float = 1.0, col_gap: float = 1.5, line_share: float = 0.5, side_share: float = 0.3) -> DataFrame:
    """Blocks of one row or column whose fonts agree or are unknown."""

    def rule(a, b, p, q):
        hgap, vgap = _gaps(a, b)
        ah, aw = (a.height + b.height) / 2, (a.width + b.width) / 2
        fa, fb = F.coalesce(f"{p}font", F.lit("")), F.coalesce(f"{q}font", F.lit(""))
        row = (_overlap_y(a, b) | (vgap < ah * line_share)) & (hgap < aw * row_gap)
        col = (_overlap_x(a, b) | (hgap < aw * side_share)) & (vgap < ah * col_gap)
        return ((fa == "") | (fb == "") | (fa == fb)) & (row | col)

    return _cluster(blocks, key, id_col, max(row_gap, side_share), max(col_gap, line_share), ["font"], rule)


def cluster_colors(blocks: DataFrame, key: str, id_col: str, row_gap: float = 0.5, color_gap: float = 50.0) -> DataFrame:
    """Blocks side by side in one row whose colours are close or unknown."""

    def rule(a, b, p, q):
        hgap, _ = _gaps(a, b)
        ca, cb = F.coalesce(f"{p}color", F.lit("")), F.coalesce(f"{q}color", F.lit(""))
        same = (ca == "") | (cb == "") | (styles.distance(ca, cb) <= color_gap)
        return _overlap_y(a, b) & (hgap < (a.width + b.width) / 2 * row_gap) & same

    return _cluster(blocks, key, id_col, row_gap, 0.0, ["color"], rule)


# --- groups of neighbouring blocks to refine together ------------------------------
# A line that begins with capitalised words, and the shares that make blocks neighbours.
CAPITALISED = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,})\s+(.*?)$"
ROW_SLACK, ROW_GAP, ROW_ALIKE = 0.2, 1.2, 0.6
STACK_SHARE, STACK_GAP = 0.2, 0.2


def _mixed(text: Column) -> Column:
    """Capitalised words followed by what looks like a formula."""
    return texts.any_pattern(F.regexp_extract(text, CAPITALISED, 2), texts.FORMULA_TAIL)


def _shared(a: Column, b: Column, low: str, high: str) -> Column:
    """Length that two spans have in common; below 0 it is the distance between them."""
    return F.least(a[high], b[high]) - F.greatest(a[low], b[low])


def neighbours(a: Column, b: Column) -> Column:
    """Boxes of one row (level, near, of like height) or stacked with hardly a gap."""
    across, down = _shared(a, b, "x1", "x2"), _shared(a, b, "y1", "y2")
    heights, widths = [p["y2"] - p["y1"] for p in (a, b)], [p["x2"] - p["x1"] for p in (a, b)]
    tall, flat = F.greatest(*heights), F.least(*heights)
    row = (down > -ROW_SLACK * tall) & (-across < ROW_GAP * tall) & (tall > 0) & (flat > ROW_ALIKE * tall)
    stack = (across > STACK_SHARE * F.least(*widths)) & (F.greatest(-down, F.lit(0.0)) < STACK_GAP * tall)
    return row | stack


def refine_groups(blocks: DataFrame, key: str, order: str, gate: Column) -> DataFrame:
    """Runs of gated neighbouring blocks: (key, order, grp) with grp the order of the run's first block.

    A block that fails the gate ends every run, so stretches of gated blocks are independent and
    are folded one by one, each in the order of its blocks: the run's hull decides whether the next block joins, and two
    mixed text-and-formula lines are never joined.
    """
    gated = blocks.where(gate).select(key, order, "text", *[F.col(c).cast("double").alias(c) for c in _XY])
    numbered = ordinal(gated, [key], [F.floor(F.col(order) / 1024)], [F.col(order)], "_n", start=0)
    stretch = numbered.withColumn("_isle", F.col(order) - F.col("_n")).groupBy(key, "_isle").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "text", *_XY))).alias("_b")
    )

    def step(run, block):
        joins = neighbours(run["hull"], block) & ~(_mixed(run["words"]) & _mixed(block["text"]))
        hull = F.struct(*[(F.least if c in ("x1", "y1") else F.greatest)(run["hull"][c], block[c]).alias(c) for c in _XY])
        own = F.struct(*[block[c].alias(c) for c in _XY])
        head = F.when(joins, run["head"]).otherwise(block["o"])
        return F.struct(
            head.alias("head"), F.when(joins, hull).otherwise(own).alias("hull"),
            F.when(joins, F.concat_ws(" ", run["words"], block["text"])).otherwise(block["text"]).alias("words"),
            F.concat(run["heads"], F.array(head)).alias("heads"),
        )

    first = F.col("_b")[0]
    start = F.struct(first["o"].alias("head"), F.struct(*[first[c].alias(c) for c in _XY]).alias("hull"), first["text"].alias("words"), F.array(first["o"]).alias("heads"))
    heads = F.aggregate(F.slice("_b", 2, F.greatest(F.size("_b") - 1, F.lit(0))), start, step, lambda run: run["heads"])
    pairs = F.arrays_zip(F.transform("_b", lambda x: x["o"]).alias("o"), heads.alias("grp"))
    return stretch.select(key, F.explode(pairs).alias("p")).select(key, F.col("p")["o"].alias(order), F.col("p")["grp"].alias("grp"))
