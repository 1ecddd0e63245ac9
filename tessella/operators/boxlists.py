"""Boxes of two sides listed by group, so that their pairs are looked at inside one task and never written."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.functions import boxes as bx
from tessella.functions.boxes import box
from tessella.operators.spatial import cross_pairs

BOXES = 1024  # of a group that is one list
PAIRS = 1 << 18  # looked at together
_XY = ("x1", "y1", "x2", "y2")


def box_lists(left: DataFrame, right: DataFrame, keys: Sequence[str], left_cols: Sequence[str], right_cols: Sequence[str], limit: int = BOXES) -> DataFrame:
    """(keys, _large, _part, _l, _r): the rows of both sides per group, with their box and the columns named.

    A group of over ``limit`` rows has lists of few rows, by a hash of its boxes in ``_part``; they only pass through.
    """
    keys, lc, rc = list(keys), [*_XY, *left_cols], [*_XY, *right_cols]
    types = {f"_a_{c}": left.schema[c].dataType for c in lc} | {f"_b_{c}": right.schema[c].dataType for c in rc}

    def side(d, prefix, cols):
        own = {f"{prefix}{c}": F.col(c).alias(f"{prefix}{c}") for c in cols}
        # As in a join, nothing meets by an empty key. Said of both sides, it also lets them share a dealing.
        return d.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(*keys, F.lit(prefix).alias("_side"), *[own.get(n, F.lit(None).cast(t).alias(n)) for n, t in types.items()])

    rows = side(left, "_a_", lc).unionByName(side(right, "_b_", rc)).withColumn("_large", F.count(F.lit(1)).over(W.partitionBy(*keys)) > limit)
    part = F.when(F.col("_large"), F.xxhash64("_side", *types)).alias("_part")
    listed = lambda prefix, cols: F.collect_list(F.when(F.col("_side") == prefix, F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in cols])))
    return rows.groupBy(*keys, "_large", part).agg(listed("_a_", lc).alias("_l"), listed("_b_", rc).alias("_r"))


def large_pairs(lists: DataFrame, keys: Sequence[str], left_cols: Sequence[str], right_cols: Sequence[str]) -> DataFrame:
    """Overlapping pairs of the groups that are too large for one list, by joins: keys, the columns of both sides and ``iou``."""
    one = lambda c: lists.where("_large").select(*keys, F.explode(c).alias("_e")).select(*keys, "_e.*")
    pairs = cross_pairs(one("_l"), one("_r"), list(keys), lambda p, q: bx.intersection(box(p), box(q)) > 0, left_cols=list(left_cols), right_cols=list(right_cols))
    return pairs.select(*keys, *[F.col(f"a_{c}").alias(c) for c in left_cols], *[F.col(f"b_{c}").alias(c) for c in right_cols], bx.iou(box("a_"), box("b_")).alias("iou"))


def list_slices(batches, nkeys: int):
    """Runs of groups of ``box_lists`` with about ``PAIRS`` pairs together, at least one group, and the rows of large groups."""
    for rb in batches:
        large = rb.column(nkeys)
        if large.true_count:
            yield rb.filter(large), True
            rb = rb.filter(pc.invert(large))
        size = [np.diff(rb.column(nkeys + i).offsets.to_numpy()).astype(np.int64) for i in (2, 3)]
        work, at = np.append(0, np.cumsum(size[0] * size[1] + size[0] + size[1])), 0
        while at < rb.num_rows:
            to = max(at + 1, int(np.searchsorted(work, work[at] + PAIRS, "right")) - 1)
            yield rb.slice(at, to - at), False
            at = to


def flat_rows(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Place of the group and the columns of every row of the lists."""
    off = lists.offsets.to_numpy()
    v = lists.values.slice(off[0], off[-1] - off[0])
    return np.repeat(np.arange(len(lists)), np.diff(off)), {f.name: v.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(v.type)}


def ordered(group: np.ndarray, cols: dict[str, np.ndarray], *by: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows by group, then by the columns in ``by``."""
    order = np.lexsort((*reversed(by), group))
    return group[order], {c: v[order] for c, v in cols.items()}


def overlapping(ga: np.ndarray, a: dict[str, np.ndarray], gb: np.ndarray, b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the boxes of one group that overlap, and their IoU; both come by group, pairs in the order of a, then b."""
    n = int(max(ga.max(initial=-1), gb.max(initial=-1))) + 1
    first, size = np.searchsorted(gb, np.arange(n)), np.bincount(gb, minlength=n)
    times = size[ga]
    i = np.repeat(np.arange(len(ga)), times)
    j = np.repeat(first[ga] - np.cumsum(times) + times, times) + np.arange(len(i))
    w = np.minimum(a["x2"][i], b["x2"][j]) - np.maximum(a["x1"][i], b["x1"][j])
    h = np.minimum(a["y2"][i], b["y2"][j]) - np.maximum(a["y1"][i], b["y1"][j])
    inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
    hit = np.flatnonzero(inter > 0)
    i, j, inter = i[hit], j[hit], inter[hit]
    area = lambda c, k: (c["x2"][k] - c["x1"][k]) * (c["y2"][k] - c["y1"][k])
    union = area(a, i) + area(b, j) - inter
    return i, j, np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
