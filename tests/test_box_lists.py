"""Pairs of boxes looked at where a group is listed, against pairs found by joins."""

import random

import pytest

from tessella.operators import assign as asg, boxlists, evalmetrics as ev

KEYS = ["image_id"]


def draw(spark, seed):
    """Ground truth of two sets and detections: a full image, one of few rows, one without detections and one without ground truth."""
    rnd = random.Random(seed)
    box = lambda: (x := rnd.uniform(0, 9), y := rnd.uniform(0, 4), x + rnd.uniform(8, 16), y + rnd.uniform(5, 9))
    gt = [(k, 100 * k + i, rnd.randint(0, 1), rnd.random() < 0.2, *box()) for k, n in ((1, 25), (2, 2), (3, 4)) for i in range(n)]
    dt = [(k, 100 * k + i, float(rnd.randint(1, 20)), *box()) for k, n in ((1, 30), (2, 2), (4, 3)) for i in range(n)]
    xy = "x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(gt, f"image_id long, gt_id long, gt_set int, is_crowd boolean, {xy}"), spark.createDataFrame(dt, f"image_id long, det_id long, score double, {xy}")


def refuse(*_):
    raise AssertionError("a small group went through joins")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("sets", [[], ["gt_set"]])
def test_assignment_of_listed_boxes(spark, monkeypatch, seed, sets):
    g, d = draw(spark, seed)
    want = rows(asg.assign(ev.iou_pairs(g, d, KEYS, carry=sets), [*KEYS, *sets], "gt_id", "det_id", "iou"))
    lists = lambda limit: boxlists.box_lists(g, d, KEYS, ["gt_id", *sets], ["det_id"], limit=limit)
    for limit in (0, 10):
        assert rows(asg.assign(lists(limit), [*KEYS, *sets], "gt_id", "det_id", "iou")) == want
    monkeypatch.setattr(asg, "large_pairs", refuse)
    assert rows(asg.assign(lists(1000), [*KEYS, *sets], "gt_id", "det_id", "iou")) == want and len(want) > 15
    monkeypatch.setattr(boxlists, "PAIRS", 40)
    assert rows(asg.assign(lists(1000), [*KEYS, *sets], "gt_id", "det_id", "iou")) == want


def test_crowded_sets_write_no_pairs(spark, monkeypatch):
    """A10_best_ground_truth_crowded: what is assigned are lists of boxes, a row for each image."""
    from tessella.plans import load, q_eval, registry

    load()
    seen, assign = [], q_eval.asg.assign
    monkeypatch.setattr(q_eval.asg, "assign", lambda pairs, *a: seen.append(pairs) or assign(pairs, *a))
    registry.QUERIES["A10_best_ground_truth_crowded"](spark, "/root/testdata/sf0.001")
    assert seen[0].count() == seen[0].select("image_id").distinct().count()


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("max_dets", [7, 100])
def test_greedy_match_of_listed_boxes(spark, monkeypatch, seed, max_dets):
    g, d = draw(spark, seed)
    plain = lambda df: sorted((r.image_id, r.det_id, r.score, str(r.hits)) for r in df.collect())
    want = plain(ev.greedy_hits(ev.iou_pairs(g, d, KEYS, carry=["is_crowd"]), d, KEYS, max_dets=max_dets))
    of_boxes = lambda limit: plain(ev.greedy_hits_of_boxes(g, d, KEYS, max_dets=max_dets, limit=limit))
    assert of_boxes(0) == of_boxes(10) == want
    monkeypatch.setattr(ev, "large_pairs", refuse)
    assert of_boxes(1000) == want and len({r[3] for r in want}) > 2
    monkeypatch.setattr(boxlists, "PAIRS", 40)
    assert of_boxes(1000) == want


def test_precision_of_written_hits(spark):
    g, d = draw(spark, 3)
    hits, truth = ev.greedy_hits_of_boxes(g, d, KEYS), g.where("NOT is_crowd")
    assert rows(ev.packed_precision(hits, truth, written=True)) == rows(ev.packed_precision(hits, truth))


def test_crowded_match_pairs_no_boxes_by_joins(spark, monkeypatch):
    """A11_greedy_matches_crowded, A11_average_precision_crowded: before, all pairs went through joins."""
    from tessella.plans import load, registry

    load()
    monkeypatch.setattr(ev, "cross_pairs", refuse)
    monkeypatch.setattr(boxlists, "cross_pairs", refuse)
    assert registry.QUERIES["A11_greedy_matches_crowded"](spark, "/root/testdata/sf0.001").where("hit = 1").count() > 1000
