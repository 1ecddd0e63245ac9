"""Sparse assignment against the dense one, and a component that no dense matrix could hold."""

from __future__ import annotations

import numpy as np
import pytest

from tessella.operators import assign as asg


@pytest.mark.parametrize("seed", range(60))
def test_total_equals_the_dense_one(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 30, 2)
    full = np.where(rng.random((n, m)) < rng.choice([0.1, 0.4, 1.0]), rng.integers(1, 12, (n, m)) if seed % 2 else rng.random((n, m)), 0.0)
    full[0, 0] = 0.5
    rows, cols = np.nonzero(full)
    rows, cols = np.append(rows, n - 1), np.append(cols, m - 1)  # a worthless pair too
    score = full[rows, cols]
    score[-1] = max(score[-1], 1e-9)
    picked = asg.best_pairs(rows, cols, score)
    assert len(set(rows[picked])) == len(picked) == len(set(cols[picked]))
    best = asg.best_columns(full)
    want = sum(full[i, j] for i, j in enumerate(best) if j >= 0)
    assert score[picked].sum() == pytest.approx(want, abs=1e-6)


def test_one_component_of_fifty_thousand(spark, monkeypatch):
    n = 50_000
    rng = np.random.default_rng(1)
    i = np.arange(n)
    # A chain: each row meets its own column and the next two, so all are one component.
    rows, cols = np.concatenate([i, i[:-1], i[:-2]]), np.concatenate([i, i[1:], i[2:]])
    score = rng.random(len(rows)) + 0.01
    picked = asg.best_pairs(rows, cols, score)
    assert len(set(rows[picked])) == len(picked) == len(set(cols[picked]))
    # Every pair left out is worth no more than what it would push out.
    by_row, by_col = np.zeros(n), np.zeros(n)
    by_row[rows[picked]], by_col[cols[picked]] = score[picked], score[picked]
    assert (score <= by_row[rows] + by_col[cols] + 1e-9).all()


def test_a_component_over_the_limit_goes_the_sparse_way(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = [(1, int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 90, 400), rng.integers(0, 90, 400), rng.random(400))]
    best = {}
    for _, a, b, s in pairs:
        best[a, b] = max(best.get((a, b), 0), s)
    df = spark.createDataFrame([(1, a, b, s) for (a, b), s in best.items()], "g long, a long, b long, s double")
    got = asg.assign(df, ["g"], "a", "b", "s").toPandas()
    full = np.zeros((90, 90))
    for (a, b), s in best.items():
        full[a, b] = s
    want = sum(full[i, j] for i, j in enumerate(asg.best_columns(full)) if j >= 0)
    assert got.s.sum() == pytest.approx(want) and got.a.is_unique and got.b.is_unique


def test_many_groups_at_once():
    """Groups solved together give the very pairs each gives alone, ties and repeated pairs included."""
    rng = np.random.default_rng(7)
    parts = []
    for g in range(300):
        n, m = rng.integers(1, 14, 2)
        full = np.round(rng.random((n, m)), 1) * (rng.random((n, m)) < rng.choice([0.1, 0.4, 1.0]))
        a, b = np.nonzero(full)
        parts.append(np.stack([np.full(len(a), g), a * 3, b * 5 + 1, full[a, b]], 1))
    g, a, b, s = np.concatenate(parts).T
    got = asg.chosen_pairs(g.astype(int), a.astype(int), b.astype(int), s)
    for k in range(300):
        own = np.flatnonzero(g == k)
        mine = got[g[got] == k]
        assert len(set(a[mine])) == len(mine) == len(set(b[mine]))
        if len(own):
            ua, ia = np.unique(a[own], return_inverse=True)
            ub, ib = np.unique(b[own], return_inverse=True)
            full = np.zeros((len(ua), len(ub)))
            full[ia, ib] = s[own]
            want = sum(full[i, j] for i, j in enumerate(asg.best_columns(full)) if j >= 0)
            assert abs(s[mine].sum() - want) < 1e-9
    assert not len(asg.chosen_pairs(*[np.zeros(0, int)] * 3, np.zeros(0)))


def test_large_groups_pass_to_rounds(spark):
    """A group beyond the limit gives the same pairs as one below it."""
    rng = np.random.default_rng(2)
    rows = [(g, i, j, float(rng.random())) for g in (1, 2) for i in range(30) for j in range(30) if i // 3 == j // 3 and rng.random() < 0.8]
    df = spark.createDataFrame(rows, "g long, a long, b long, s double")
    pairs = lambda limit: sorted(map(tuple, asg.assign(df, ["g"], "a", "b", "s", limit=limit).collect()))
    assert pairs(10) == pairs(10_000)
