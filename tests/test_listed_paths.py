"""Duplicate paths compared where a group is listed, against pairs found by joins."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.operators import overlaps as ov


def draw(spark, seed):
    """Paths of two to six points: a full image, a small one, a single path, and paths too short to count."""
    rnd = random.Random(seed)
    paths = [
        (k, 100 * k + i, [(rnd.uniform(0, w), rnd.uniform(0, w)) for _ in range(rnd.randint(1, 6))]) for k, n, w in ((1, 40, 90), (2, 6, 25), (3, 1, 10), (4, 12, 60)) for i in range(n)
    ]
    # The same path twice and turned round, and paths of equal length.
    paths += [(4, 450 + i, p) for i, p in enumerate(([(0.0, 0.0), (40.0, 0.0)], [(0.0, 0.0), (40.0, 0.0)], [(40.0, 0.0), (0.0, 0.0)], [(0.0, 14.0), (40.0, 14.0)]))]
    return spark.createDataFrame(paths, "image_id long, path_id long, pts array<struct<x double, y double>>")


def refuse(*_, **__):
    raise AssertionError("a small group went through joins")


@pytest.mark.parametrize("seed", range(3))
def test_duplicate_paths_of_large_groups(spark, monkeypatch, seed):
    df = draw(spark, seed)
    gone = lambda limit: sorted(tuple(r) for r in ov.duplicate_paths(df, ["image_id"], "path_id", limit=limit).collect())
    want = gone(0)
    assert gone(8) == want and len(want) > 8 and (4, 451) in want
    monkeypatch.setattr(ov, "self_pairs", refuse)
    assert gone(1000) == want
    monkeypatch.setattr(ov, "PATH_PAIRS", 5)
    assert gone(1000) == want


def test_pieces_of_many_points(monkeypatch):
    rnd = random.Random(4)
    paths = [{"_id": i, "len": rnd.uniform(0, 60), "pts": [{"x": rnd.uniform(0, 80), "y": rnd.uniform(0, 80)} for _ in range(rnd.randint(2, 6))]} for i in range(40)]
    lists = pa.array([paths[:25], [], paths[25:]], pa.list_(pa.struct({"_id": pa.int64(), "len": pa.float64(), "pts": pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()}))})))
    want = [c.tolist() for c in ov._repeated_paths(lists, 15.0, 30.0)]
    monkeypatch.setattr(ov, "PATH_PAIRS", 2)
    assert [c.tolist() for c in ov._repeated_paths(lists, 15.0, 30.0)] == want and len(want[0]) > 5


def test_many_points_are_not_listed(spark, monkeypatch):
    df = draw(spark, 0)
    monkeypatch.setattr(ov, "_repeated_paths", lambda lists, *_: (np.zeros(0, int), np.zeros(0, int)) if all(not len(x) for x in lists) else refuse())
    monkeypatch.setattr(ov, "POINTS", 1)
    assert ov.duplicate_paths(df, ["image_id"], "path_id").count() > 8
