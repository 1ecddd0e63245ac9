"""TETA: localisation, association and classification terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.operators.assign import _numbered, assign
from tessella.operators.evalmetrics import ALPHA_STEPS, thresholds
from tessella.operators.sequences import ROWS, agreed_pairs, by_sequence, count_among, find_among, share_mark
from tessella.session import cut

EPS = 2.220446049250313e-16


def teta(gt: DataFrame, trk: DataFrame, pairs: DataFrame, seq: str, overlap_threshold: int = 50, steps=ALPHA_STEPS, limit: int = ROWS) -> DataFrame:
    """TETA terms per sequence, class and alpha (hundredths); alpha 0, at which anything matches, is left out.

    ``gt``: seq, t, gt_id, category_id; ``trk`` likewise with trk_id; ``pairs``: seq, t, gt_id,
    trk_id, sim, of all rows that overlap.

    First pass, blind to classes: tracks that overlap any object by ``overlap_threshold`` in any frame are assigned in each
    frame, and matches of at least one half are taken. Second pass, for each class: a tracker row is near if it overlaps an object
    of the class by the threshold and is not taken by an object of another class. Tracks that are near in some frame are
    assigned to the class's objects in all frames, whatever their own class. A near row that stays unmatched is a
    false positive of the class; a match with the wrong class is a class miss of the object's class and a
    class false positive of the tracker's. Classes are those of ``gt``; a sequence has a row for each of its classes
    and for others that its tracker rows name wrongly.

    A sequence of up to ``limit`` rows goes through both passes inside one task; larger ones go through joins.
    """
    done = _found(gt, trk, pairs, seq, overlap_threshold / 100.0, limit)
    unit = [seq, "cls"]
    matched = done.where("gt_id IS NOT NULL")
    at = matched.withColumn("alpha", F.explode(F.filter(thresholds(steps), lambda s: F.col("sim") >= s / 100.0 - EPS)))
    right = (F.col("trk_cls") == F.col("cls")).cast("int")
    n = at.groupBy(*unit, "alpha").agg(
        F.count(F.lit(1)).alias("loc_tp"), F.sum(F.when(F.col("alpha") >= 50, right)).alias("cls_tp"), F.sum(F.when(F.col("alpha") >= 50, 1 - right)).alias("cls_fn")
    )
    wrong = at.where((F.col("alpha") >= 50) & (F.col("trk_cls") != F.col("cls"))).groupBy(seq, F.col("trk_cls").alias("cls"), "alpha").agg(F.count(F.lit(1)).alias("cls_fp"))
    # A near row has at most one match, so it is false at the thresholds its match does not reach.
    missed = F.filter(thresholds(steps), lambda s: F.coalesce(F.col("sim") < s / 100.0 - EPS, F.lit(True)))
    fp = done.where("near").withColumn("alpha", F.explode(missed)).groupBy(*unit, "alpha").agg(F.count(F.lit(1)).alias("loc_fp"))
    m = F.col("m")
    one = F.lit(1.0)
    assoc = at.groupBy(*unit, "alpha", "gt_id", "trk_id").agg(F.count(F.lit(1)).alias("m"), F.max("_gc").alias("_gc"), F.max("_tc").alias("_tc"))
    assoc = assoc.groupBy(*unit, "alpha").agg(
        F.sum(m * m / F.greatest(one, F.col("_gc") + F.col("_tc") - m)).alias("_a"), F.sum(m * m / F.greatest(one, F.col("_gc"))).alias("_re"),
        F.sum(m * m / F.greatest(one, F.col("_tc"))).alias("_pr"),
    )
    objects = gt.groupBy(seq, F.col("category_id").alias("cls")).agg(F.count(F.lit(1)).alias("_gc"))
    named = wrong.join(objects.select("cls").distinct(), "cls", "left_semi").select(*unit, F.lit(0).cast("long").alias("_gc"))
    rows = objects.unionByName(named).groupBy(*unit).agg(F.sum("_gc").alias("n_gt")).withColumn("alpha", F.explode(thresholds(steps)))
    for part in (n, wrong, fp, assoc):
        rows = rows.join(part, [*unit, "alpha"], "left")
    rows = rows.fillna(0, ["loc_tp", "cls_tp", "cls_fn", "cls_fp", "loc_fp"]).fillna(0.0, ["_a", "_re", "_pr"])
    tp, fn, lfp = F.col("loc_tp"), F.col("n_gt") - F.col("loc_tp"), F.col("loc_fp")
    ctp, cfn, cfp = F.col("cls_tp"), F.col("cls_fn"), F.col("cls_fp")
    rows = (
        rows.withColumn("loc_fn", fn).withColumn("loc_re", tp / F.greatest(one, tp + fn)).withColumn("loc_pr", tp / F.greatest(one, tp + lfp))
        .withColumn("loc_a", tp / F.greatest(one, tp + fn + lfp)).withColumn("assoc_a", F.col("_a") / F.greatest(one, tp))
        .withColumn("assoc_re", F.col("_re") / F.greatest(one, tp)).withColumn("assoc_pr", F.col("_pr") / F.greatest(one, tp))
        .withColumn("_c", F.when(F.col("alpha") >= 50, ctp / F.greatest(one, ctp + cfn + cfp)))
        .drop("_a", "_re", "_pr", "n_gt")
    )
    cls = rows.groupBy(*unit).agg(F.avg("_c").alias("cls_a"))
    return rows.join(cls, unit).withColumn("teta", (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3).drop("_c")


def _found(gt: DataFrame, trk: DataFrame, pairs: DataFrame, seq: str, over: float, limit: int) -> DataFrame:
    """Tracker rows that are near objects of a class or matched with one: seq, t, cls, gt_id and sim of the match, trk_id, trk_cls, near, and
    the rows of both tracks (_gc, _tc)."""
    long, yes, real = T.LongType(), T.BooleanType(), T.DoubleType()
    fields = [T.StructField(n, k) for n, k in (
        ("t", long), ("cls", long), ("gt_id", long), ("trk_id", long), ("trk_cls", long), ("sim", real), ("near", yes), ("_gc", long), ("_tc", long)
    )]

    def solve(g, t, a, b, s, objects, tracked):
        og, ot, oa, oc = objects
        kg, kt, kb, kc = tracked
        cls, has_cls = find_among((g, t, a), (og, ot, oa), oc)
        trk_cls, has_row = find_among((g, t, b), (kg, kt, kb), kc)
        n_b, close = count_among((g, b), (kg, kb)), s >= over
        # First pass: blind to classes.
        i = np.flatnonzero(share_mark((g, b), close))
        i = i[agreed_pairs(g[i], t[i], np.zeros(len(i)), a[i], b[i], s[i], count_among((g[i], a[i]), (og, oa)), n_b[i], EPS)]
        i = i[(s[i] >= 0.5 - EPS) & has_cls[i]]
        other, taken = find_among((g, t, b), (g[i], t[i], b[i]), cls[i])
        near = has_cls & has_row & close & (~taken | (other == cls))
        # Second pass: for each class.
        i = np.flatnonzero(share_mark((g, cls, b), near) & has_cls & has_row)
        i = i[np.lexsort((b[i], a[i], cls[i], t[i], g[i]))]
        n_a = count_among((g[i], cls[i], a[i]), (og, oc, oa))
        k = agreed_pairs(g[i], t[i], cls[i], a[i], b[i], s[i], n_a, n_b[i], EPS)
        match, n_a = i[k], n_a[k]
        rest = np.flatnonzero(near)
        row = _numbered(*[c[np.append(match, rest)] for c in (g, t, cls, b)])
        is_near = np.isin(row[: len(match)], row[len(match) :])
        first = np.unique(row[len(match) :], return_index=True)[1]
        rest = rest[first[~np.isin(row[len(match) :][first], row[: len(match)])]]
        at, blank = np.append(match, rest), np.append(np.zeros(len(match), bool), np.ones(len(rest), bool))
        return g[at], [
            t[at], cls[at], pa.array(a[at], mask=blank), b[at], trk_cls[at], pa.array(s[at], mask=blank), np.append(is_near, np.ones(len(rest), bool)),
            np.append(n_a, np.zeros(len(rest), np.int64)), n_b[at],
        ]

    done, large = by_sequence(gt, trk, pairs, seq, solve, fields, limit)
    if large.isEmpty():
        return done
    gt, trk, pairs = (d.join(large, seq, "left_semi") for d in (gt, trk, pairs))
    return done.unionByName(_found_by_joins(gt, trk, pairs, seq, over).select(*done.columns))


def _found_by_joins(gt: DataFrame, trk: DataFrame, pairs: DataFrame, seq: str, threshold: float) -> DataFrame:
    """``_found`` of sequences of any size."""
    frame, unit = [seq, "t"], [seq, "cls"]
    # Both passes read these again and again: they are written once, with the columns that count.
    gt, trk = cut(gt.select(*frame, "gt_id", "category_id")), cut(trk.select(*frame, "trk_id", "category_id"))
    pairs = cut(pairs.select(*frame, "gt_id", "trk_id", "sim"))
    over = F.col("sim") >= threshold
    blind = pairs.join(pairs.where(over).select(seq, "trk_id").distinct(), [seq, "trk_id"], "left_semi")
    objects = gt.select(*frame, "gt_id", F.col("category_id").alias("cls"))
    first = assign(_aligned(blind, gt, trk, seq, []), frame, "gt_id", "trk_id", "_score")
    taken = first.join(pairs, [*frame, "gt_id", "trk_id"]).where(F.col("sim") >= 0.5 - EPS).join(objects, [*frame, "gt_id"]).select(*frame, "trk_id", F.col("cls").alias("_taken"))
    everything = pairs.join(objects, [*frame, "gt_id"]).join(trk.select(*frame, "trk_id", F.col("category_id").alias("trk_cls")), [*frame, "trk_id"])
    near = everything.where(over).select(*frame, "cls", "trk_id", "trk_cls").distinct().join(taken, [*frame, "trk_id"], "left")
    near = cut(near.where(F.col("_taken").isNull() | (F.col("_taken") == F.col("cls"))).drop("_taken"))
    classed = cut(everything.join(near.select(*unit, "trk_id").distinct(), [*unit, "trk_id"], "left_semi"))
    scored = _aligned(classed, objects, trk, seq, ["cls"])
    matched = assign(scored, [*frame, "cls"], "gt_id", "trk_id", "_score").join(classed, [*frame, "cls", "gt_id", "trk_id"]).drop("_score")
    gc = objects.groupBy(*unit, "gt_id").agg(F.count(F.lit(1)).alias("_gc"))
    tc = trk.groupBy(seq, "trk_id").agg(F.count(F.lit(1)).alias("_tc"))
    both = matched.join(near.withColumn("near", F.lit(True)), [*frame, "cls", "trk_id", "trk_cls"], "full").withColumn("near", F.coalesce("near", F.lit(False)))
    return cut(both.join(gc, [*unit, "gt_id"], "left").join(tc, [seq, "trk_id"], "left"))


def _aligned(pairs: DataFrame, gt: DataFrame, trk: DataFrame, seq: str, cls: list[str]) -> DataFrame:
    """(seq, t, cls, gt_id, trk_id, _score): overlap weighted by how well both tracks agree over the whole sequence."""
    frame = [seq, "t", *cls]
    gs = pairs.groupBy(*frame, "gt_id").agg(F.sum("sim").alias("_gs"))
    ts = pairs.groupBy(*frame, "trk_id").agg(F.sum("sim").alias("_ts"))
    den = F.col("_gs") + F.col("_ts") - F.col("sim")
    mass = pairs.join(gs, [*frame, "gt_id"]).join(ts, [*frame, "trk_id"]).groupBy(seq, *cls, "gt_id", "trk_id").agg(
        F.sum(F.when(den > EPS, F.col("sim") / den).otherwise(0.0)).alias("_mass")
    )
    gc = gt.groupBy(seq, *cls, "gt_id").agg(F.count(F.lit(1)).alias("_gc"))
    tc = trk.groupBy(seq, "trk_id").agg(F.count(F.lit(1)).alias("_tc"))
    align = mass.join(gc, [seq, *cls, "gt_id"]).join(tc, [seq, "trk_id"]).withColumn("_al", F.col("_mass") / (F.col("_gc") + F.col("_tc") - F.col("_mass")))
    return pairs.join(align, [seq, *cls, "gt_id", "trk_id"]).withColumn("_score", F.col("_al") * F.col("sim"))
