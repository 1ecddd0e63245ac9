"""Work and memory of a task that must not follow the size of a table or of a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions import polygons as pg
from tessella.operators import evalmetrics as ev, greedy, overlaps as ov, runs
from tessella.plans import load, q_eval, registry, relations

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detections_are_dealt_by_their_number(spark):
    """K03_quality_report, X07_merge_runs: the tasks grow in number, not the rows of a task."""
    n = relations.table(spark, SF, "lineitem").count()
    d = relations.det(spark, SF, rows=500)
    assert d.rdd.getNumPartitions() == -(-n // 500)
    assert d.exceptAll(relations.det(spark, SF)).isEmpty() and d.count() == n


def test_small_groups_are_not_cut_by_the_grid(spark):
    """K03_quality_report: two boxes of a million units a side, which would be billions of cells."""
    df = spark.createDataFrame([(1, 0.0, 0.0, 1e6, 1e6), (1, 5e5, 0.0, 2e6, 1e6), (2, 0.0, 0.0, 3.0, 4.0)], "g int, x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in ov.union_area(df, ["g"], cell=16.0).collect()} == {(1, 2e12), (2, 12.0)}


def test_runs_are_folded_from_slices(spark):
    """X07_merge_runs: lists of a batch become Python objects in parts."""
    rb = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([[1, 2], [3, 4, 5, 6], [], [7]])], ["k", "rows"])
    assert [s.column(0).to_pylist() for s in runs._slices(rb, 1, limit=3)] == [[1], [2], [3, 4]]
    assert [s.column(0).to_pylist() for s in runs._slices(rb, 1)] == [[1, 2, 3, 4]]


def test_polygons_without_functions_of_arrays(spark):
    """P10_polygon_bounds: four points need no lambda for bounds and mergers; nulls and other sizes give what they gave."""
    pt = "array<struct<x:double,y:double>>"
    rows = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)]), (3, None), (4, [(0.0, 0.0), None, (2.0, 2.0)]), (5, [])]
    df = spark.createDataFrame(rows, f"id int, p {pt}")
    q = pg.rectangle(pg.Box(F.lit(5.0), F.lit(2.0), F.lit(30.0), F.lit(4.0)))
    b, m = pg.hull(F.col("p")), pg.hull(pg.merge_to_rectangle(F.col("p"), q))
    bounds = df.select("id", *[c.alias(n) for c, n in zip((*b, *m), "abcdefgh")])
    assert "lambda" not in _plan(bounds)
    none = (None,) * 4
    assert {r[0]: tuple(r)[1:] for r in bounds.collect()} == {
        1: (0, 0, 4, 3, 0, 0, 30, 4), 2: (0, 0, 4, 3, 0, 0, 30, 4), 3: none * 2, 4: (0, 0, 2, 2, 0, 0, 30, 4), 5: (*none, 5, 2, 30, 4),
    }
    area = {r[0]: r[1] for r in df.where("id <= 3").select("id", pg.shoelace(F.col("p"))).collect()}
    assert area == {1: 12.0, 2: 6.0, 3: None}


def test_relationship_is_worked_out_once(spark):
    """X10_resolve_layers, X10_structure_suggestions: the filter on the label does not repeat the expression behind it."""
    d = spark.createDataFrame([(0, 1, 0.0, 0.0, 9.0, 9.0, 5), (0, 2, 1.0, 1.0, 8.0, 8.0, 3)], "g int, id int, x1 double, y1 double, x2 double, y2 double, layer_level int")
    pairs = ov.overlap_pairs(d, ["g"], "id", carry=["layer_level"])
    for out, want in ((ov.resolve_layers(d, pairs, ["g"], "id").select("id", "layer_level"), {(1, 2), (2, 3)}), (ov.structure_suggestions(pairs, ["g"], "id").select("lower_id", "suggestion"), {(1, "container_child")})):
        assert {tuple(r) for r in out.collect()} == want
        assert _plan(out).count("stacked") <= 4


def test_conflicts_of_many_groups_are_tested_together():
    """X02_cross_group_nms: one call of the rule for all pairs of small groups, in the order of the rows."""
    rng = np.random.default_rng(3)
    offsets = np.append(0, np.cumsum(rng.integers(0, 9, 200)))
    xy = rng.integers(0, 12, (offsets[-1], 2)).astype(float)
    cols = {"x1": xy[:, 0], "y1": xy[:, 1], "x2": xy[:, 0] + 6, "y2": xy[:, 1] + 6}
    rule, calls = greedy.iou_above(0.3), []
    got = {i: hit.tolist() for i, hit in greedy._hits(cols, offsets, greedy.Conflict(lambda *a: calls.append(1) or rule.rows(*a), None))}
    want = {}
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        for i in range(lo, hi):
            hit = i + 1 + np.flatnonzero(rule.rows(cols, i, slice(i + 1, hi)))
            if len(hit):
                want[i] = hit.tolist()
    assert got == want and list(got) == sorted(got) and len(calls) == 1


def _dealings(df) -> int:
    """How often the plan that ran deals detections by image."""
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("REPARTITION_BY_COL" in line and "Reused" not in line for line in final.splitlines())


def test_sets_of_ground_truth_share_one_dealing(spark, monkeypatch):
    """A10_best_ground_truth: pairs of both sets come from one dealing of the detections and are assigned once."""
    load()
    seen, assign = [], q_eval.asg.assign
    monkeypatch.setattr(q_eval.asg, "assign", lambda pairs, *a: seen.append(pairs) or assign(pairs, *a))
    registry.QUERIES["A10_best_ground_truth"](spark, SF)
    assert len(seen) == 1
    seen[0].collect()
    assert _dealings(seen[0]) == 1


def test_hits_meet_counts_before_thresholds(spark):
    """A10_best_ground_truth and others that score images: a join sees one row of an image, not one per threshold."""
    image = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    g = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "image_id long, gt_id long")
    d = spark.createDataFrame([(1, 7), (1, 8)], "image_id long, det_id long")
    m = spark.createDataFrame([(1, 1, 7, 0.55), (1, 2, 8, 0.95)], "image_id long, gt_id long, det_id long, iou double")
    s = ev.image_scores(image, g, d, m, ["image_id"])
    plan = _plan(s)
    assert plan.index("Generate") < plan.index("Join") and plan.count("Generate") == 1
    assert {(r.image_id, r.threshold): (r.tp, r.fp, r.fn) for r in s.collect()} == {
        (i, t): (0, 0, int(i == 2)) if i > 1 else (1 + (t <= 55), int(t > 55), int(t > 55)) for i in (1, 2, 3) for t in range(50, 100, 5)
    }
