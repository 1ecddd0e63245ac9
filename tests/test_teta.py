"""TETA against a plain evaluation of one sequence and class at a time."""

from __future__ import annotations

import random
from itertools import permutations

import pytest

from tessella.operators.teta import teta

STEPS = [5, 50, 75]


def best(score):
    """Pairs of the largest total, by trying all."""
    rows, cols = sorted({a for a, _ in score}), sorted({b for _, b in score})
    flip = len(rows) > len(cols)
    short, wide = (cols, rows) if flip else (rows, cols)
    value = lambda s, w: score.get((w, s) if flip else (s, w), 0.0)
    found = max(permutations(wide, len(short)), key=lambda p: sum(map(value, short, p)))
    return {((w, s) if flip else (s, w)) for s, w in zip(short, found) if value(s, w) > 0}


def aligned(frames, sims):
    """frames: t -> (gt ids, trk ids); the matches of each frame."""
    mass, gc, tc = {}, {}, {}
    for t, (gs, ks) in frames.items():
        for g in gs:
            gc[g] = gc.get(g, 0) + 1
        for k in ks:
            tc[k] = tc.get(k, 0) + 1
        s = {(g, k): sims.get((t, g, k), 0.0) for g in gs for k in ks}
        for (g, k), x in s.items():
            den = sum(s[g, j] for j in ks) + sum(s[i, k] for i in gs) - x
            if x:
                mass[g, k] = mass.get((g, k), 0) + x / den
    al = {(g, k): m / (gc[g] + tc[k] - m) for (g, k), m in mass.items()}
    return {t: best({(g, k): al[g, k] * sims[t, g, k] for g in gs for k in ks if (t, g, k) in sims}) for t, (gs, ks) in frames.items()}, gc, tc


def plain(gt, trk, sims):
    """gt, trk: t -> id -> class."""
    ts = sorted(set(gt) | set(trk))
    near_any = {k for (t, g, k), s in sims.items() if s >= 0.5}
    first, _, _ = aligned({t: (set(gt.get(t, {})), set(trk.get(t, {})) & near_any) for t in ts}, sims)
    taken = {(t, k): gt[t][g] for t, m in first.items() for g, k in m if sims[t, g, k] >= 0.5}
    classes = sorted({c for f in gt.values() for c in f.values()})
    out = {(c, a): dict(tp=0, fn=0, fp=0, ctp=0, cfn=0, cfp=0, pairs={}) for c in classes for a in STEPS}
    counts = {}
    for c in classes:
        near = {t: {k for k in trk.get(t, {}) if any(sims.get((t, g, k), 0) >= 0.5 for g, x in gt.get(t, {}).items() if x == c) and taken.get((t, k), c) == c} for t in ts}
        tracks = set().union(*near.values())
        frames = {t: ({g for g, x in gt.get(t, {}).items() if x == c}, set(trk.get(t, {})) & tracks) for t in ts}
        matches, *counts[c] = aligned(frames, sims)
        for t in ts:
            for a in STEPS:
                m = {(g, k) for g, k in matches[t] if sims[t, g, k] >= a / 100}
                o = out[c, a]
                o["tp"] += len(m)
                o["fn"] += len(frames[t][0]) - len(m)
                o["fp"] += len(near[t] - {k for _, k in m})
                for g, k in m:
                    o["pairs"][g, k] = o["pairs"].get((g, k), 0) + 1
                    if a >= 50:
                        own = trk[t][k]
                        o["ctp" if own == c else "cfn"] += 1
                        if own != c and own in classes:
                            out[own, a]["cfp"] += 1
    rows = {}
    for (c, a), o in out.items():
        gc, tc = counts[c]
        assoc = sum(m * m / max(1, gc[g] + tc[k] - m) for (g, k), m in o["pairs"].items()) / max(1, o["tp"])
        rows[c, a] = (o["tp"], o["fn"], o["fp"], o["ctp"], o["cfn"], o["cfp"], assoc)
    return rows


def run(spark, gt, trk, sims):
    rows = lambda d: [(1, t, i, c) for t, f in d.items() for i, c in f.items()]
    g = spark.createDataFrame(rows(gt), "seq long, t long, gt_id long, category_id long")
    k = spark.createDataFrame(rows(trk), "seq long, t long, trk_id long, category_id long")
    p = spark.createDataFrame([(1, *i, s) for i, s in sims.items()], "seq long, t long, gt_id long, trk_id long, sim double")
    return {(r.cls, r.alpha): (r.loc_tp, r.loc_fn, r.loc_fp, r.cls_tp, r.cls_fn, r.cls_fp, r.assoc_a) for r in teta(g, k, p, "seq", steps=STEPS).collect()}


def test_a_row_taken_by_one_class_is_a_miss_for_the_other(spark):
    # One tracker row over an object of class 0 and, less, one of class 1.
    got = run(spark, {0: {1: 0, 2: 1}}, {0: {7: 0}}, {(0, 1, 7): 0.8, (0, 2, 7): 0.6})
    assert got[0, 50] == (1, 0, 0, 1, 0, 0, 1.0)
    assert got[1, 50] == (0, 1, 0, 0, 0, 0, 0.0)


def test_a_track_near_once_is_matched_everywhere(spark):
    # Over both frames track 8 agrees more with object 2, which takes it in frame 0 though object 1 overlaps more.
    got = run(spark, {0: {1: 0, 2: 1}, 1: {2: 1}}, {0: {8: 0}, 1: {8: 0}}, {(0, 1, 8): 0.9, (0, 2, 8): 0.6, (1, 2, 8): 0.7})
    assert got[1, 50][:6] == (2, 0, 0, 0, 2, 0)
    assert got[0, 50][:6] == (0, 1, 0, 0, 0, 2)


@pytest.mark.parametrize("seed", range(3))
def test_teta_as_evaluated_plainly(spark, seed):
    draw = random.Random(seed)
    gt = {t: {i: i % 3 for i in draw.sample(range(6), draw.randint(0, 5))} for t in range(6)}
    trk = {t: {i: draw.choice([i % 3, draw.randint(0, 4)]) for i in draw.sample(range(10, 17), draw.randint(0, 6))} for t in range(6)}
    sims = {(t, g, k): draw.uniform(0.05, 1) for t in gt for g in gt[t] for k in trk[t] if draw.random() < 0.5}
    want, got = plain(gt, trk, sims), run(spark, gt, trk, sims)
    for key, row in want.items():
        assert got[key][:6] == row[:6] and got[key][6] == pytest.approx(row[6]), key
    assert set(got) == set(want)
