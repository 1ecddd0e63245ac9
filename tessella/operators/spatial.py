"""Spatial joins without a spatial index.

Pairs of boxes are found with one equi-join on (keys, bin) plus a residual predicate.
A group of at most ``small`` rows is one bin. A larger group is cut into square cells
whose edge follows the size of the boxes: a box of level L (largest side <= 2^L) covers
at most four cells of edge 2^L, so a hot image spreads over many join keys instead of
one, and a pair is only looked for at the level of its larger box.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.boxes import Box, box

SMALL = 256
_XY = ("x1", "y1", "x2", "y2")

Predicate = Callable[[str, str], Column]
"""Builds the residual condition from two column prefixes (``a_``, ``b_``)."""


def _with_bins(df: DataFrame, levels: DataFrame, keys: Sequence[str], pad: float, span: int | None, small: int):
    """Add ``_lv`` (own level, -1 in small groups), ``_own`` and ``_probe`` bin arrays."""
    half = pad / 2.0
    df = (
        df.join(levels, list(keys))
        .withColumn("_bx1", F.col("x1") - half)
        .withColumn("_by1", F.col("y1") - half)
        .withColumn("_bx2", F.col("x2") + half)
        .withColumn("_by2", F.col("y2") + half)
        .withColumn("_lv", F.when(F.col("_n") <= small, F.lit(-1)).otherwise(_level(half)))
    )
    reach = "true" if span is None else f"l <= _lv + {span}"

    def cells(level: str) -> str:
        lo_x, hi_x = (f"cast(floor({c} / pow(2D, {level})) as bigint)" for c in ("_bx1", "_bx2"))
        lo_y, hi_y = (f"cast(floor({c} / pow(2D, {level})) as bigint)" for c in ("_by1", "_by2"))
        return (
            f"flatten(transform(sequence({lo_x}, {hi_x}), cx -> transform(sequence({lo_y}, {hi_y}), "
            f"cy -> named_struct('lv', {level}, 'cx', cx, 'cy', cy))))"
        )

    single = "array(named_struct('lv', -1, 'cx', 0L, 'cy', 0L))"
    return df.withColumn("_own", F.expr(f"if(_lv < 0, {single}, {cells('_lv')})")).withColumn(
        "_probe",
        F.expr(
            f"if(_lv < 0, {single}, flatten(transform(filter(_levels, l -> l >= _lv and {reach}), "
            f"l -> {cells('l')})))"
        ),
    )


def _level(half: float) -> Column:
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0)) + 2 * half
    return F.ceil(F.log2(side)).cast("int")


def _levels(dfs: Sequence[DataFrame], keys: Sequence[str], pad: float) -> DataFrame:
    """Rows per group and the levels present in it (at most a few dozen values)."""
    one = [d.select(*keys, _level(pad / 2.0).alias("_l")) for d in dfs]
    both = one[0] if len(one) == 1 else one[0].unionByName(one[1])
    return (
        both.groupBy(*keys, "_l")
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(*keys)
        .agg(F.sum("_c").alias("_n"), F.collect_set("_l").alias("_levels"))
    )


def _side(df: DataFrame, keys, bins: str, cols, prefix: str) -> DataFrame:
    out = df.select(
        *keys,
        F.explode_outer(bins).alias("_bin"),
        F.col("_lv").alias(f"_{prefix}lv"),
        F.col("_bx1").alias(f"_{prefix}bx"),
        F.col("_by1").alias(f"_{prefix}by"),
        *[F.col(c).alias(f"{prefix}{c}") for c in cols],
    )
    return out.select("*", F.col("_bin.lv").alias("_bl"), F.col("_bin.cx").alias("_cx"), F.col("_bin.cy").alias("_cy")).drop("_bin")


def _owner_cell() -> Column:
    """True in exactly one of the cells a pair shares."""
    edge = F.pow(F.lit(2.0), F.col("_bl"))
    return (F.col("_bl") < 0) | (
        (F.floor(F.greatest("_a_bx", "_b_bx") / edge) == F.col("_cx"))
        & (F.floor(F.greatest("_a_by", "_b_by") / edge) == F.col("_cy"))
    )


def span_for_ratio(min_ratio: float) -> int:
    """Levels apart two boxes can be when their larger sides differ by at most ``min_ratio``."""
    return max(0, math.ceil(math.log2(1.0 / min_ratio)))


def self_pairs(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    where: Predicate,
    carry: Sequence[str] = (),
    pad: float = 0.0,
    span: int | None = None,
    small: int = SMALL,
    extra: dict[str, Predicate] | None = None,
) -> DataFrame:
    """Every pair a < b (by id) of one group whose boxes, padded by ``pad``, meet and satisfy ``where``.

    Columns: keys, then ``a_*`` and ``b_*`` for id, box and ``carry``. ``where`` must not care
    which row is a. ``extra`` columns are computed on the unordered pair; ``flipped`` then tells
    whether a and b were exchanged afterwards.
    """
    cols = [id_col, *_XY, *carry]
    binned = _with_bins(df.select(*keys, *cols), _levels([df], keys, pad), keys, pad, span, small)
    a = _side(binned, keys, "_probe", cols, "a_")
    b = _side(binned, keys, "_own", cols, "b_")
    joined = a.join(b, [*keys, "_bl", "_cx", "_cy"]).where(
        ((F.col("_a_lv") < F.col("_b_lv")) | ((F.col("_a_lv") == F.col("_b_lv")) & (F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))))
        & _owner_cell()
    )
    # The predicate and the extras are symmetric: they read the joined columns as they are,
    # and only surviving pairs are turned round.
    found = joined.where(where("a_", "b_"))
    found = found.select("*", *[fn("a_", "b_").alias(n) for n, fn in (extra or {}).items()])
    flip = F.col(f"a_{id_col}") > F.col(f"b_{id_col}")
    return found.select(
        *keys,
        *[F.when(flip, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in cols],
        *[F.when(flip, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in cols],
        *(extra or {}),
        *([flip.alias("flipped")] if extra else []),
    )


def cross_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    where: Predicate,
    left_cols: Sequence[str] = (),
    right_cols: Sequence[str] = (),
    pad: float = 0.0,
    span: int | None = None,
    small: int = SMALL,
) -> DataFrame:
    """Pairs (left ``a_``, right ``b_``) of one group whose padded boxes meet and satisfy ``where``."""
    lc, rc = [*_XY, *left_cols], [*_XY, *right_cols]
    levels = _levels([left, right], keys, pad)
    lb = _with_bins(left.select(*keys, *lc), levels, keys, pad, span, small)
    rb = _with_bins(right.select(*keys, *rc), levels, keys, pad, span, small)

    def tagged(d, cols, prefix, probe_tag):
        # In a small group everything meets in the single bin, under tag 0 only.
        roles = F.array(
            F.struct(F.lit(probe_tag).alias("t"), F.col("_probe").alias("b")),
            F.struct(F.lit(1 - probe_tag).alias("t"), F.col("_own").alias("b")),
        )
        keep = F.filter(roles, lambda r: (F.col("_lv") >= 0) | (r["t"] == 0))
        d = d.withColumn(
            "_bins",
            F.flatten(F.transform(keep, lambda r: F.transform(r["b"], lambda b: F.struct(r["t"].alias("t"), b["lv"].alias("lv"), b["cx"].alias("cx"), b["cy"].alias("cy"))))),
        )
        out = d.select(
            *keys,
            F.explode_outer("_bins").alias("_bin"),
            F.col("_lv").alias(f"_{prefix}lv"),
            F.col("_bx1").alias(f"_{prefix}bx"),
            F.col("_by1").alias(f"_{prefix}by"),
            *[F.col(c).alias(f"{prefix}{c}") for c in cols],
        )
        return out.select(
            "*", F.col("_bin.t").alias("_t"), F.col("_bin.lv").alias("_bl"), F.col("_bin.cx").alias("_cx"), F.col("_bin.cy").alias("_cy")
        ).drop("_bin")

    a, b = tagged(lb, lc, "a_", 0), tagged(rb, rc, "b_", 1)
    once = F.when(F.col("_bl") < 0, F.lit(True)).when(F.col("_t") == 0, F.col("_a_lv") <= F.col("_b_lv")).otherwise(F.col("_a_lv") > F.col("_b_lv"))
    return (
        a.join(b, [*keys, "_t", "_bl", "_cx", "_cy"])
        .where(once & _owner_cell())
        .where(where("a_", "b_"))
        .select(*keys, *[f"a_{c}" for c in lc], *[f"b_{c}" for c in rc])
    )


def without_overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], where: Predicate, cols: Sequence[str] = (), span: int | None = None
) -> DataFrame:
    """Rows of ``left`` that meet no box of ``right`` under ``where`` (built on box, ``cols`` of left).

    Copies of a box are looked at once on either side, whatever their number.
    """
    probe = [*keys, *_XY, *cols]
    hits = cross_pairs(
        left.select(*probe).distinct(), right.select(*keys, *_XY).distinct(), keys, where, left_cols=cols, span=span
    )
    gone = hits.select(*keys, *[F.col(f"a_{c}").alias(c) for c in (*_XY, *cols)]).distinct()
    return left.join(gone, probe, "left_anti")


def prefixed(prefix: str) -> Box:
    return box(prefix)
