"""Tracks of many sequences, each worked on where its rows are listed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessella.operators.assign import _flat, _numbered, _slices, chosen_pairs
from tessella.session import cut

ROWS = 1 << 18  # of a sequence that is worked on inside one task


def by_sequence(
    gt: DataFrame, trk: DataFrame, pairs: DataFrame, seq: str, solve: Callable, fields: Sequence[T.StructField], limit: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """Rows that ``solve`` finds in each sequence of up to ``limit`` rows, and the names of the larger ones.

    ``gt``: seq, t, gt_id, category_id; ``trk`` likewise with trk_id; ``pairs``: seq, t, gt_id, trk_id, sim. Rows are dealt by
    sequence once; ``solve`` takes (place of the sequence, t, gt_id, trk_id, sim) of the pairs in this order, (place, t, gt_id, category) and
    (place, t, trk_id, category) of both sides, and gives the places and the columns of ``fields``. What is written is what it gives.
    """

    def tagged(d, kind, a, b, s):
        return d.select(seq, F.lit(kind).alias("_k"), *[F.col(c).cast("long").alias(n) for c, n in (("t", "t"), (a, "a"), (b, "b"))], s.cast("double").alias("s"))

    rows = tagged(pairs, 0, "gt_id", "trk_id", F.col("sim")).unionByName(tagged(gt, 1, "gt_id", "category_id", F.lit(0.0))).unionByName(tagged(trk, 2, "trk_id", "category_id", F.lit(0.0)))
    own = lambda k: F.collect_list(F.when(~F.col("_large") & (F.col("_k") == k), F.struct("t", "a", "b", "s"))).alias(f"_{k}")
    lists = rows.withColumn("_large", F.count(F.lit(1)).over(W.partitionBy(seq)) > limit).groupBy(seq, "_large").agg(own(0), own(1), own(2))
    names = [seq, *[f.name for f in fields], "_large"]

    def run(batches):
        for rb in _slices(batches, 2):
            large = np.flatnonzero(rb.column(1).to_numpy(zero_copy_only=False))
            if len(large):
                at = pa.array(large)
                yield pa.RecordBatch.from_arrays([rb.column(0).take(at), *[pa.nulls(len(large), t) for t in kinds], rb.column(1).take(at)], names)
            g, t, a, b, s = _flat(rb.column(2), ("t", "a", "b", "s"))
            if not len(g):
                continue
            order = np.lexsort((s, b, a, t, g))
            at, found = solve(*[c[order] for c in (g, t, a, b, s)], _flat(rb.column(3), ("t", "a", "b")), _flat(rb.column(4), ("t", "a", "b")))
            found = [c if isinstance(c, pa.Array) else pa.array(c) for c in found]
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(at)), *[c.cast(t) for c, t in zip(found, kinds)], pa.array(np.zeros(len(at), bool))], names)

    arrow = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [arrow[f.dataType.simpleString()] for f in fields]
    done = cut(lists.mapInArrow(run, T.StructType([gt.schema[seq], *fields, T.StructField("_large", T.BooleanType())])))
    return done.where("NOT _large").drop("_large"), done.where("_large").select(seq)


def _shared_numbers(of, among) -> tuple[np.ndarray, np.ndarray, int]:
    """A number for each distinct row of both, as (those of ``of``, those of ``among``, how many)."""
    n = _numbered(*[np.concatenate(c) for c in zip(of, among)])
    return n[: len(of[0])], n[len(of[0]) :], int(n.max()) + 1 if len(n) else 0


def count_among(of, among) -> np.ndarray:
    """How many rows of ``among`` equal each row of ``of``."""
    a, b, n = _shared_numbers(of, among)
    return np.bincount(b, minlength=n)[a]


def find_among(of, among, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value at the row of ``among`` that equals each row of ``of``, and whether there is one."""
    a, b, n = _shared_numbers(of, among)
    known, values = np.zeros(n, bool), np.zeros(n, value.dtype)
    known[b], values[b] = True, value
    return values[a], known[a]


def share_mark(cols, mark: np.ndarray) -> np.ndarray:
    """Whether any row that equals a row in ``cols`` is marked."""
    n = _numbered(*cols)
    any_ = np.zeros(int(n.max()) + 1 if len(n) else 0, bool)
    any_[n[mark]] = True
    return any_[n]


def agreed_pairs(g, t, cls, a, b, s, n_a, n_b, floor: float) -> np.ndarray:
    """Places of the pairs assigned in each frame (g, t, cls), one per a and b at most; pairs come in the order (g, t, cls, a, b).

    A pair counts by its overlap, weighted by how well both tracks agree over the whole sequence. ``n_a`` and ``n_b`` are the
    rows of both tracks there.
    """
    na, nb, track = _numbered(g, t, cls, a), _numbered(g, t, cls, b), _numbered(g, cls, a, b)
    den = np.bincount(na, s)[na] + np.bincount(nb, s)[nb] - s if len(s) else s
    mass = np.bincount(track, np.divide(s, den, out=np.zeros_like(s), where=den > floor))[track] if len(s) else s
    live = np.flatnonzero((n_a > 0) & (n_b > 0))
    score = mass[live] / (n_a[live] + n_b[live] - mass[live]) * s[live]
    live, score = live[score > 0], score[score > 0]
    return live[chosen_pairs(_numbered(g, t, cls)[live], a[live], b[live], score)]
