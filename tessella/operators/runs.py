"""Sequential merging of boxes in sorted order, parallel over chunks of a group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.operators.numbering import ordinal
from tessella.session import cut

CHUNK = 4096
BATCH = 1 << 15  # rows that are Python objects at a time
_XY = ("x1", "y1", "x2", "y2")


def _touch(last, x1, y1, x2, y2):
    return last is not None and x1 <= last[2] and y1 <= last[3] and x2 >= last[0] and y2 >= last[1]


def _fold(rows, state):
    """Closed runs and the open run after ``rows``; a run is [x1, y1, x2, y2, members]."""
    closed = []
    for x1, y1, x2, y2 in rows:
        if _touch(state, x1, y1, x2, y2):
            state = [min(state[0], x1), min(state[1], y1), max(state[2], x2), max(state[3], y2), state[4] + 1]
        else:
            if state is not None:
                closed.append(state)
            state = [x1, y1, x2, y2, 1]
    return closed, state


def merge_runs(df: DataFrame, keys: Sequence[str], id_col: str, chunk: int = CHUNK) -> DataFrame:
    """Merge boxes sorted by (x1, y1) into the last merged box when they touch it.

    A group is cut into chunks of ``chunk`` rows. The open run at a chunk's end depends on the run
    handed in, but a box that starts anew forgets everything before it, so the handed-over runs
    settle after a few passes: each pass refolds every chunk from its neighbour's last result,
    until no hand-over changes. One pass is enough where groups fit one chunk.
    """
    keys = list(keys)
    rows = ordinal(df.select(*keys, id_col, *_XY), keys, [F.floor(F.col("x1") / 16)], [F.col("x1"), F.col("y1"), F.col(id_col)], "_i", start=0)
    rows = rows.withColumn("_chunk", F.floor(F.col("_i") / chunk))
    lists = cut(rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_i", *_XY))).alias("_rows")))
    last = lists.groupBy(*keys).agg(F.max("_chunk").alias("_last"))
    run = "array<double>"
    handed = lists.select(*keys, "_chunk", F.lit(None).cast(run).alias("_in"))
    many = not last.where("_last > 0").isEmpty()
    while many:
        ends = _apply(lists.join(handed, [*keys, "_chunk"]), keys, "end")
        nxt = cut(
            lists.select(*keys, "_chunk").join(
                ends.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("run").alias("_in")), [*keys, "_chunk"], "left"
            )
        )
        changed = nxt.alias("n").join(handed.alias("h"), [*keys, "_chunk"]).where(~F.col("n._in").eqNullSafe(F.col("h._in")))
        many = not changed.isEmpty()
        handed = nxt
    out = _apply(lists.join(handed, [*keys, "_chunk"]).join(last, keys), keys, "runs")
    return out.select(*keys, *[F.get("run", F.lit(i)).alias(c) for i, c in enumerate(_XY)], F.get("run", F.lit(4)).cast("bigint").alias("members"))


def _slices(rb: pa.RecordBatch, column: int, limit: int = BATCH):
    """Slices of ``rb`` whose lists hold up to ``limit`` rows together, or one list."""
    off = rb.column(column).offsets.to_numpy()
    at = 0
    while at < rb.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield rb.slice(at, to - at)
        at = to


def _apply(df: DataFrame, keys, what: str) -> DataFrame:
    """Refold the chunks: their open end, or the runs closed in them (with the open one in the last)."""
    nkeys = len(keys)
    cols = [*keys, "_chunk", "_rows", "_in", *(["_last"] if what == "runs" else [])]

    def fold(batches):
        for rb in batches:
            yield from map(refold, _slices(rb, nkeys + 1))

    def refold(rb):
        lists, start = rb.column(nkeys + 1), rb.column(nkeys + 2).to_pylist()
        off = lists.offsets.to_pylist()
        vals = lists.values.slice(off[0], off[-1] - off[0])
        xs = [vals.field(c).to_pylist() for c in _XY]
        chunk = rb.column(nkeys).to_pylist()
        last = rb.column(nkeys + 3).to_pylist() if what == "runs" else None
        at, out = [], []
        for g, (lo, hi) in enumerate(zip(off[:-1], off[1:])):
            closed, state = _fold(zip(*[x[lo - off[0] : hi - off[0]] for x in xs]), start[g])
            if what == "end":
                closed = [state]
            elif chunk[g] == last[g]:
                closed.append(state)
            at.extend([g] * len(closed))
            out.extend([float(v) for v in r] for r in closed)
        idx = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*[rb.column(k).take(idx) for k in range(nkeys + 1)], pa.array(out, pa.list_(pa.float64()))], [*keys, "_chunk", "run"]
        )

    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in [*keys, "_chunk"]] + [T.StructField("run", T.ArrayType(T.DoubleType()))])
    return df.select(*cols).mapInArrow(fold, schema)
