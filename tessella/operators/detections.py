"""Raw model rows to detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.boxes import cxcywh_to_xyxy, scale
from tessella.operators.numbering import top_k


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def from_raw(raw: DataFrame, image: str, id_col: str, threshold: float, k: int, presence: bool = False) -> DataFrame:
    """Best class and score per row, threshold, boxes in pixels, top ``k`` per image."""
    best = F.array_max("logits")
    score = sigmoid(best) * sigmoid(F.col("presence")) if presence else sigmoid(best)
    b = scale(cxcywh_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), F.col("img_w"), F.col("img_h"))
    rows = raw.select(
        image, id_col, (F.array_position("logits", best) - 1).cast("int").alias("label"), score.alias("score"),
        *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))],
    ).where(F.col("score") > threshold)
    return top_k(rows, [image], [F.col("score").desc(), F.col(id_col)], k)


def count_above(raw: DataFrame, image: str, threshold: float) -> DataFrame:
    score = sigmoid(F.col("logit")) * sigmoid(F.col("presence"))
    return raw.groupBy(image).agg(F.sum((score > threshold).cast("int")).alias("n"))
