"""Text blocks: style spans, colours, voting, fusion of two sources, run merging."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import boxes as bx, styles, texts
from tessella.functions.boxes import box
from tessella.operators.spatial import cross_pairs
from tessella.session import cut


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Pairs of [start, stop) intervals of one key that share a position.

    Both sides name the blocks of ``width`` positions they touch; the pair is kept in the block
    of the later start. Equi-join on (key, block), so a long document is many join keys.
    ``left`` has l_start/l_stop, ``right`` has r_start/r_stop; other column names must differ.
    """

    def blocks(start, stop):
        lo, hi = F.floor(F.col(start) / width), F.floor((F.greatest(F.col(stop), F.col(start) + 1) - 1) / width)
        return F.explode_outer(F.sequence(lo, hi))

    a = left.withColumn("_blk", blocks("l_start", "l_stop"))
    b = right.withColumn("_blk", blocks("r_start", "r_stop"))
    meet = F.greatest("l_start", "r_start") < F.least("l_stop", "r_stop")
    owner = F.floor(F.greatest("l_start", "r_start") / width) == F.col("_blk")
    return a.join(b, [key, "_blk"]).where(meet & owner).drop("_blk")


def _pick(fn, attr: str) -> Column:
    """Attribute of the first or last style that has one."""
    return fn(F.when(F.col(attr).isNotNull(), F.struct("style_ord", attr)))[attr]


ATTRS = ("font_style", "font_weight", "font_name", "color", "background")


def apply_styles_last_wins(blocks: DataFrame, styles_: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each attribute from the last overlapping style that sets it (blocks without any stay NULL)."""
    hits = interval_join(blocks.select(key, "ord", "l_start", "l_stop"), styles_, key)
    won = hits.groupBy(key, "ord").agg(*[_pick(F.max, a).alias(a) for a in ATTRS])
    return blocks.join(won, [key, "ord"], "left")


def apply_styles_own_first(blocks: DataFrame, styles_: DataFrame, key: str = "doc_id") -> DataFrame:
    """A block with its own weight, slant or colour keeps them; else any bold or italic style
    counts and the first colours win."""
    bare = blocks.where(~F.coalesce("is_bold", F.lit(False)) & ~F.coalesce("is_italic", F.lit(False)) & F.col("own_color").isNull())
    hits = interval_join(bare.select(key, "ord", "l_start", "l_stop"), styles_, key)
    won = hits.groupBy(key, "ord").agg(
        F.max(F.coalesce(F.col("font_weight") == "bold", F.lit(False))).alias("_b"),
        F.max(F.coalesce(F.col("font_style") == "italic", F.lit(False))).alias("_i"),
        _pick(F.min, "color").alias("color"),
        _pick(F.min, "background").alias("background"),
    )
    return (
        blocks.join(won, [key, "ord"], "left")
        .withColumn("is_bold", F.coalesce("is_bold", F.lit(False)) | F.coalesce("_b", F.lit(False)))
        .withColumn("is_italic", F.coalesce("is_italic", F.lit(False)) | F.coalesce("_i", F.lit(False)))
        .withColumn("color", F.coalesce("own_color", "color"))
        .drop("_b", "_i")
    )


def dominant_colors(blocks: DataFrame, styles_: DataFrame, key: str = "doc_id") -> DataFrame:
    """Colour covering most characters of each block; the colour met first wins ties."""
    hits = interval_join(blocks.select(key, "ord", "l_start", "l_stop"), styles_.where("color IS NOT NULL"), key)
    share = (
        hits.withColumn("color", styles.dark_to_black(F.col("color")))
        .groupBy(key, "ord", "color")
        .agg(F.sum(F.least("l_stop", "r_stop") - F.greatest("l_start", "r_start")).alias("chars"), F.min("style_ord").alias("_first"))
    )
    return share.groupBy(key, "ord").agg(F.max_by("color", F.struct("chars", -F.col("_first"))).alias("color"))


def color_of_longest(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Colour of the longest text per group among rows with a colour; the first wins ties."""
    return blocks.where((F.col("color") != "") & (F.length("text") > 0)).groupBy(*keys).agg(
        F.max_by("color", F.struct(F.length("text"), -F.col("ord"))).alias("color")
    )


def majority(rows: DataFrame, keys: Sequence[str], col: str, order: str | None) -> DataFrame:
    """Most frequent value per group; ties go to the largest value, or with ``order`` to the first seen."""
    n = rows.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(
        F.count(F.lit(1)).alias("_n"), *([F.min(order).alias("_first")] if order else [])
    )
    rank = F.struct("_n", -F.col("_first")) if order else F.struct("_n", F.col(col))
    return n.groupBy(*keys).agg(F.max_by(col, rank).alias(f"voted_{col}"))


def unify_majority(rows: DataFrame, keys: Sequence[str], col: str, exempt: Column | None = None, order: str | None = None) -> DataFrame:
    """Give the voted value to every row of groups of two or more; exempt rows neither vote nor change."""
    off = F.lit(False) if exempt is None else exempt
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    votes = majority(rows.where(~off), keys, col, order).join(sizes.where("_size >= 2").drop("_size"), list(keys), "left_semi")
    return rows.join(votes, list(keys), "left").withColumn(col, F.when(off, F.col(col)).otherwise(F.coalesce(f"voted_{col}", col))).drop(f"voted_{col}")


def unify_minimum(rows: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Groups of two or more take their smallest value, rounded to one decimal."""
    low = rows.groupBy(*keys).agg(F.min(col).alias("_m"), F.count(F.lit(1)).alias("_size")).where("_size >= 2").drop("_size")
    return rows.join(low, list(keys), "left").withColumn(col, F.when(F.col("_m").isNull(), F.col(col)).otherwise(F.bround("_m", 1))).drop("_m")


def unify_median(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Line width of shapes alike in ``keys`` (image and type) and size: the whole part of the median, for groups of two or more."""
    keys = list(keys)
    keyed = rows.withColumn("size_key", F.bround(F.sqrt(box().width * box().width + box().height * box().height) / 20).cast("int"))
    mid = keyed.groupBy(*keys, "size_key").agg(F.expr(f"percentile({value}, 0.5)").cast("int").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return keyed.join(mid.where("_n >= 2").drop("_n"), [*keys, "size_key"], "left").withColumn(value, F.coalesce(F.col("_m").cast("double"), F.col(value))).drop("_m")


def main_font(blocks: DataFrame, key: str, default: str = texts.DEFAULT_FONT) -> DataFrame:
    """Font of the largest block of each document, ``default`` when it has none."""
    return blocks.groupBy(key).agg(
        F.coalesce(F.max_by("font", F.struct(box().area, -F.col("ord"))), F.lit(default)).alias("main_font")
    )


# --- J05 fusion ---------------------------------------------------------------------
def fuse_sources(blocks: DataFrame, formulas: DataFrame, key: str, overlap: float = 0.2, similarity: float = 0.8) -> DataFrame:
    """Valid formulas plus the text blocks none of them covers or repeats.

    A block goes when a formula covers more than ``overlap`` of it or its text is more than
    ``similarity`` alike. Which formula claims it does not matter, so this is two anti-joins.
    """
    # Both sides are read by two pair searches each; they are written once.
    good = cut(formulas.where(texts.is_valid_formula(F.col("text"))))
    covered = cross_pairs(
        blocks.select(key, "x1", "y1", "x2", "y2").distinct(), good.select(key, "x1", "y1", "x2", "y2").distinct(), [key],
        lambda a, b: bx.containment(box(b), box(a)) > overlap,
    ).select(key, *[F.col(f"a_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).distinct()
    rest = cut(blocks.join(covered, [key, "x1", "y1", "x2", "y2"], "left_anti"))
    alike = similar_texts(rest, good, key, similarity)
    rest = rest.join(alike, [key, "text"], "left_anti")
    cleaned = good.withColumn("text", texts.clean_latex(F.col("text"))).withColumn("font_size", (F.col("y2") - F.col("y1")) * 0.35).withColumn("is_latex", F.lit(True))
    return cleaned.unionByName(rest.withColumn("is_latex", F.lit(False)), allowMissingColumns=True)


def common_length(a: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of a text of ``n`` characters, given by the places of each as bits, and ``b``."""
    full = rest = (1 << n) - 1
    for c in b:
        at = a.get(c)
        if at is not None:
            hit = rest & at
            rest = ((rest + hit) | (rest - hit)) & full
    return n - rest.bit_count()


def ratios(a: Iterable[str], b: Iterable[str], threshold: float) -> list[float]:
    """Matching-block ratio of each pair, or 0 where it can't exceed ``threshold``.

    Matching blocks are a common subsequence, so the longest one bounds them; few pairs of unlike texts come near the threshold.
    """
    from difflib import SequenceMatcher

    out, last, places = [], None, {}
    for p, q in zip(a, b):
        if p == q:
            out.append(1.0)
            continue
        if p != last:
            last, places = p, {}
            for i, c in enumerate(p):
                places[c] = places.get(c, 0) | 1 << i
        near = 2 * common_length(places, len(p), q) / (len(p) + len(q)) > threshold
        out.append(SequenceMatcher(None, p, q).ratio() if near else 0.0)
    return out


def similar_texts(left: DataFrame, right: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, text) of left texts whose matching-block ratio with a right text exceeds ``threshold``.

    A ratio r needs lengths within r/(2-r) of each other, so distinct stripped texts only meet
    in neighbouring length classes, and the multiset bound is tested before the exact ratio.
    """
    step = math.log((2 - threshold) / threshold)

    def distinct(d, name):
        t = d.select(key, F.col("text"), texts.comparable(F.col("text")).alias(name)).where(F.col(name) != "")
        return t.withColumn("_cls", F.floor(F.log(F.length(name).cast("double")) / step))

    lt = distinct(left, "_a")
    rt = distinct(right, "_b").select(key, "_b", "_cls").distinct()
    near = rt.select(key, "_b", F.explode(F.array(F.col("_cls") - 1, F.col("_cls"), F.col("_cls") + 1)).alias("_cls"))
    la, lb = F.length("_a"), F.length("_b")
    pairs = lt.select(key, "_a", "_cls").distinct().join(near, [key, "_cls"]).where(
        (F.least(la, lb) / F.greatest(la, lb) >= 0.3) & (2 * F.least(la, lb) / (la + lb) > threshold)
    )

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios(a, b, threshold), dtype="float64")

    hits = pairs.where(ratio("_a", "_b") > threshold).select(key, "_a").distinct()
    return lt.join(hits, [key, "_a"], "left_semi").select(key, "text").distinct()
