"""Area of overlapping boxes: lists inside a task, joins beyond the limit, and a plain count of cells."""

import random

import numpy as np
import pytest

from tessella.operators import overlaps as ov


def test_area_of_lists_and_of_large_groups(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        for _ in range(rng.choice([1, 5, 40])):
            x, y = rng.randint(-20, 40), rng.randint(-9, 20)
            rows += [(g, float(x), float(y), float(x + rng.randint(0, 15)), float(y + rng.randint(0, 9)))] * rng.randint(1, 3)
    rows.append((9, 5.0, 5.0, 5.0, 8.0))
    want = {}
    for g, x1, y1, x2, y2 in rows:
        for x in range(int(x1), int(x2)):
            want.setdefault(g, set()).update((x, y) for y in range(int(y1), int(y2)))
    df = spark.createDataFrame(rows, "g long, x1 double, y1 double, x2 double, y2 double")
    for cell in (None, 16.0):
        for limit in (1, 12, 1024):
            got = {r.g: r.covered for r in ov.union_area(df, ["g"], cell, limit).collect()}
            assert got == {g: float(len(p)) for g, p in want.items() if p}


def test_fractions():
    got = ov.covered_areas(np.array([0, 0, 2]), np.array([0.0, 0.5, 1]), np.array([0.0, 0.25, 1]), np.array([1.0, 1.5, 1.5]), np.array([1.0, 1.25, 3]), 3)
    assert got.tolist() == pytest.approx([2 - 0.5 * 0.75, 0, 1])
