"""Suppression across prompt groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessella.functions import boxes as bx
from tessella.functions.boxes import box
from tessella.session import cut
from tessella.operators.greedy import Conflict, np_area, np_inter, np_ratio, greedy_cover

# Codes carried through the fold.
GROUPS = {"arrow": 1, "shape": 2, "image": 3}
CLASSES = {"image_only": 1, "shape_only": 2, "shape_with_content": 3}


def _code(col: str, table: dict[str, int]):
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(F.col(col) == k, v).otherwise(out)
    return out


def cross_group_conflict(general: float = 0.7, arrow: float = 0.85, mixed: float = 0.6) -> Conflict:
    """IoU rule whose threshold depends on the pair; a shape over an image with content keeps both.

    The second row of a pair is the better one: its region class decides.
    """

    def rows(c, i, s):
        inter = np_inter(c, i, s)
        v = np_ratio(inter, np_area(c, i) + np_area(c, s) - inter)
        g, h = c["_g"][i], c["_g"][s]
        limit = np.where((g == 1) | (h == 1), arrow, general)
        special = (v > mixed) & (((g == 2) & (h == 3)) | ((g == 3) & (h == 2)))
        return np.where(special, c["_k"][i] != 3, v > limit)

    def columns(a, b):
        v = bx.iou(box(a), box(b))
        g, h = F.col(f"{b}_g"), F.col(f"{a}_g")
        limit = F.when((g == 1) | (h == 1), arrow).otherwise(general)
        special = (v > mixed) & (((g == 2) & (h == 3)) | ((g == 3) & (h == 2)))
        return F.when(special, F.col(f"{b}_k") != 3).otherwise(v > limit)

    from tessella.operators.spatial import span_for_ratio

    return Conflict(rows, columns, span=span_for_ratio(mixed), extra=("_g", "_k"))


def cross_group_keep(df: DataFrame, keys: Sequence[str], id_col: str, mixed: float = 0.6) -> DataFrame:
    """Rows left after cross-group suppression by (priority, score), both descending.

    When a shape meets an image, the region class of the better row may prefer the worse one:
    the pair is then swapped (the worse row stays, the better one goes), although the better row
    still suppresses everything else it overlaps.
    """
    ready = df.withColumn("_g", _code("grp", GROUPS)).withColumn("_k", _code("region_class", CLASSES))
    cover = greedy_cover(ready, keys, id_col, [-F.col("priority"), -F.col("score")], cross_group_conflict(mixed=mixed), carry=["_g", "_k"])
    cover = cut(cover)
    anchors = cover.where(F.col(id_col) == F.col("anchor_id"))
    better = anchors.select(*keys, F.col(id_col).alias("anchor_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2", "_g", "_k")])
    dropped = cover.where(F.col(id_col) != F.col("anchor_id")).join(better, [*keys, "anchor_id"])
    g, k, h = F.col("b__g"), F.col("b__k"), F.col("_g")
    meets = bx.iou(box(), box("b_")) > mixed
    swap = meets & (
        ((k == 1) & (g == 2) & (h == 3)) | ((k == 2) & (g == 3) & (h == 2)) | ((k == 0) & (g == 2) & (h == 3))
    )
    swapped = dropped.where(swap).select(*keys, id_col, "anchor_id")
    stay = anchors.join(swapped.select(*keys, F.col("anchor_id").alias(id_col)).distinct(), [*keys, id_col], "left_anti")
    return stay.select(*keys, id_col).unionByName(swapped.select(*keys, id_col))
