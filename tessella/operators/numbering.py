"""Row numbers and top-k that stay parallel inside a hot group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.taskcontext import TaskContext

from tessella.session import cut


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark limits each map task to ``k`` rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def ordinal(
    df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], order: Sequence[Column], name: str, start: int = 1
) -> DataFrame:
    """``row_number`` over ``keys`` ordered by ``coarse`` then ``order``, in two levels.

    ``coarse`` must be non-decreasing along the wanted order. Rows are counted per coarse
    value first (a small table), its running sum gives each coarse bucket its offset, and
    rows are only numbered inside a bucket, so a group with a third of all rows is still
    spread over its buckets. Without ``keys`` the rows are dealt by ranges of the order and written; each range
    goes on from the count of those before it, of which the driver only sees one number per range.
    """
    keys = list(keys)
    if not keys:
        return _by_range(df, [*coarse, *order], name, start)
    cs = [f"_c{i}" for i in range(len(coarse))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(coarse, cs)])
    counts = tagged.groupBy(*keys, *cs).agg(F.count(F.lit(1)).alias("_k"))
    before = W.partitionBy(*keys).orderBy(*cs).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, *cs, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(W.partitionBy(*keys, *cs).orderBy(*order))
    same = [tagged[c].eqNullSafe(offsets[c]) for c in (*keys, *cs)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    numbered = tagged.withColumn("_in", inside)
    joined = numbered.alias("n").join(
        offsets.alias("o"),
        [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*keys, *cs)],
    )
    return joined.select(
        *[F.col(f"n.{c}") for c in df.columns], (F.col("n._in") + F.col("o._off") + F.lit(start - 1)).cast("bigint").alias(name)
    )


def _by_range(df: DataFrame, order: Sequence[Column], name: str, start: int) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    counts = {r.p: r.n for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, total = {}, start
    for p in sorted(counts):
        first[p] = total
        total += counts[p]

    def number(batches):
        at = first.get(TaskContext.get().partitionId(), start)
        for rb in batches:
            yield rb.append_column(name, pa.array(np.arange(at, at + rb.num_rows)))
            at += rb.num_rows

    return dealt.mapInArrow(number, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def running_sum(
    df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], order: Sequence[Column], sums: dict[str, Column]
) -> DataFrame:
    """Cumulative sums in two levels: per coarse bucket, then inside it (see ``ordinal``)."""
    return _running(df, keys, coarse, order, sums, F.sum, lambda a, b: a + b, F.lit(0))


def running_max(
    df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], order: Sequence[Column], values: dict[str, Column]
) -> DataFrame:
    """Largest value so far, in the same two levels."""
    return _running(df, keys, coarse, order, values, F.max, F.greatest, None)


def _running(df, keys, coarse, order, sums, agg, join, empty):
    keys = list(keys)
    cs = [f"_c{i}" for i in range(len(coarse))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(coarse, cs)], *[c.alias(f"_v_{n}") for n, c in sums.items()])
    totals = tagged.groupBy(*keys, *cs).agg(*[agg(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy(*cs).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, *cs, *[_else(agg(f"_t_{n}").over(before), empty).alias(f"_off_{n}") for n in sums])
    inside = W.partitionBy(*keys, *cs).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = tagged.select("*", *[agg(f"_v_{n}").over(inside).alias(f"_in_{n}") for n in sums])
    joined = local.join(offsets, [*keys, *cs])
    return joined.select(*df.columns, *[join(F.col(f"_in_{n}"), F.col(f"_off_{n}")).alias(n) for n in sums])


def _else(c: Column, empty: Column | None) -> Column:
    return c if empty is None else F.coalesce(c, empty)
