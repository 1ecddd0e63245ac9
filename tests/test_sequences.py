"""Sequences worked on where they are listed, against the joins that larger ones go through."""

import random

import pytest

from tessella.operators import evalmetrics as ev, teta as tt


def draw(spark, seed):
    """Objects, tracker rows and pairs of four sequences; the second has few rows, the third none that overlap."""
    rnd = random.Random(seed)
    gt, trk, pairs = [], [], []
    for seq, frames in ((1, 8), (2, 1), (3, 2), (4, 6)):
        for t in range(frames):
            g, k = rnd.sample(range(7), rnd.randint(0, 6)), rnd.sample(range(10, 18), rnd.randint(1, 7))
            gt += [(seq, t, i, i % 3) for i in g]
            trk += [(seq, t, i, rnd.choice([i % 3, rnd.randint(0, 4)])) for i in k]
            pairs += [(seq, t, i, j, rnd.uniform(0.05, 1)) for i in g for j in k if seq != 3 and rnd.random() < 0.6]
    return (
        spark.createDataFrame(gt, "seq long, t long, gt_id long, category_id long"), spark.createDataFrame(trk, "seq long, t long, trk_id long, category_id long"),
        spark.createDataFrame(pairs, "seq long, t long, gt_id long, trk_id long, sim double"),
    )


def rows(df, keys):
    cols = sorted(df.columns)
    return sorted(tuple(None if r[c] is None else round(r[c], 9) for c in [*keys, *cols]) for r in df.collect())


def refuse(*_):
    raise AssertionError("a small sequence went through joins")


@pytest.mark.parametrize("seed", range(2))
def test_teta_of_large_sequences(spark, seed, monkeypatch):
    inputs = draw(spark, seed)
    joined = rows(tt.teta(*inputs, "seq", limit=0), ["seq", "cls", "alpha"])
    mixed = rows(tt.teta(*inputs, "seq", limit=40), ["seq", "cls", "alpha"])
    monkeypatch.setattr(tt, "_aligned", refuse)
    listed = rows(tt.teta(*inputs, "seq"), ["seq", "cls", "alpha"])
    assert listed == joined == mixed and len(listed) > 100


@pytest.mark.parametrize("seed", range(2))
def test_hota_of_large_sequences(spark, seed, monkeypatch):
    inputs = draw(spark, seed)
    joined = rows(ev.hota(*inputs, "seq", limit=0), ["seq", "alpha"])
    mixed = rows(ev.hota(*inputs, "seq", limit=40), ["seq", "alpha"])
    monkeypatch.setattr(ev, "assign", refuse)
    listed = rows(ev.hota(*inputs, "seq"), ["seq", "alpha"])
    assert listed == joined == mixed and len(listed) == 4 * len(ev.ALPHA_STEPS)
