"""What the two searches share: which vectors take part, blocks of them as rows, and merging of best lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) as doubles, without null ids and vectors that are null, empty or hold a null or non-finite component.

    Where lengths differ, the most frequent one (the greatest of several) takes part.
    """
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = held.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return held.where(F.size("vec") == (sizes["d"] if sizes else 1))


def few_copies(held: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids, and of each of those k rows: all that a list of k can hold.

    Ties go to the smaller id, and a query leaves out every row of its own id, so k other ids have to be left.
    """
    rows = held.groupBy("vec", "id").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("vec").orderBy("id")
    few = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k + 1)
    return few.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(k))))).select(*held.columns)


def blocks(df: DataFrame, keys: list[str], name: str, *columns: str) -> DataFrame:
    """One row per block: ``name`` holds its rows; the caller's keys bound their number."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def members(column: pa.Array, row: int) -> pa.StructArray:
    """The rows of one block."""
    return column[row].values


def matrix(block: pa.StructArray, field: str, dtype) -> np.ndarray:
    lists = block.field(field)
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(block), -1)


def merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the smaller id."""
    by_id = np.argsort(ids, 1, kind="stable")
    ids, scores = np.take_along_axis(ids, by_id, 1), np.take_along_axis(scores, by_id, 1)
    best = np.argsort(-scores, 1, kind="stable")[:, :k]
    return np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all that the blocks found."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
