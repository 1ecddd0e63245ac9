"""Order-dependent greedy operators (suppression, anchored clusters, sequential removal).

The first-fit rule "keep a row unless a better kept row conflicts with it" has one answer,
whatever the schedule, so it can be computed in pieces:

* groups of at most ``limit`` rows are folded inside one task on Arrow lists;
* larger groups are first stripped of copies of one box, cut into tiles, and solved in
  rounds. Each round folds at most ``limit`` best rows per tile with three verdicts
  (kept, dropped, not yet known); what is settled suppresses the rest by a spatial join,
  what is unsettled goes on to the next round. The best open row of a group is settled in
  every round, so the rounds end, and no task ever holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessella.functions import boxes as bx
from tessella.operators.spatial import cross_pairs, span_for_ratio
from tessella.session import cut

LIMIT = 1024
PAIRS = 1 << 18
_XY = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Conflict:
    """A symmetric pair rule, once for Arrow columns inside a task and once as a Column."""

    rows: Callable[[dict, np.ndarray, np.ndarray], np.ndarray]  # row by row of the pairs
    columns: Callable[[str, str], Column]
    span: int | None = None
    pad: float = 0.0
    extra: tuple[str, ...] = ()
    copies_conflict: bool = True


def np_inter(c, i, s):
    w = np.minimum(c["x2"][i], c["x2"][s]) - np.maximum(c["x1"][i], c["x1"][s])
    h = np.minimum(c["y2"][i], c["y2"][s]) - np.maximum(c["y1"][i], c["y1"][s])
    return np.maximum(w, 0.0) * np.maximum(h, 0.0)


def np_area(c, i):
    return (c["x2"][i] - c["x1"][i]) * (c["y2"][i] - c["y1"][i])


def np_ratio(num, den):
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def iou_above(threshold: float, inclusive: bool = False) -> Conflict:
    """IoU over (or, when ``inclusive``, at least) a positive threshold."""

    def rows(c, i, s):
        inter = np_inter(c, i, s)
        v = np_ratio(inter, np_area(c, i) + np_area(c, s) - inter)
        return v >= threshold if inclusive else v > threshold

    def columns(a, b):
        v = bx.iou(bx.box(a), bx.box(b))
        return v >= threshold if inclusive else v > threshold

    return Conflict(rows, columns, span=span_for_ratio(threshold))


def over_min_above(threshold: float) -> Conflict:
    def rows(c, i, s):
        return np_ratio(np_inter(c, i, s), np.minimum(np_area(c, i), np_area(c, s))) > threshold

    return Conflict(rows, lambda a, b: bx.over_min(bx.box(a), bx.box(b)) > threshold)


def closer_than(distance: float) -> Conflict:
    """Euclidean distance of points given as zero-size boxes; small and large groups round it alike."""

    def rows(c, i, s):
        dx, dy = c["x1"][s] - c["x1"][i], c["y1"][s] - c["y1"][i]
        return np.sqrt(dx * dx + dy * dy) < distance

    def columns(a, b):
        p, q = bx.box(a), bx.box(b)
        dx, dy = p.x1 - q.x1, p.y1 - q.y1
        return F.sqrt(dx * dx + dy * dy) < distance

    return Conflict(rows, columns, pad=distance)


def _hits(cols: dict, offsets: np.ndarray, conflict: Conflict):
    """(row, the later rows of its group that it conflicts with), in order; rows without any are left out.

    The pairs of many groups are tested together, up to ``PAIRS`` or those of one group.
    """
    size = np.diff(offsets).astype(np.int64)
    work = np.append(0, np.cumsum(size * (size - 1) // 2))
    g = 0
    while g < len(size):
        to = max(g + 1, int(np.searchsorted(work, work[g] + PAIRS, "right")) - 1)
        row = np.arange(offsets[g], offsets[to])
        later = np.repeat(offsets[g + 1 : to + 1], size[g:to]) - row - 1
        first = np.repeat(row, later)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
        hit = np.flatnonzero(conflict.rows(cols, first, second))
        first, second = first[hit], second[hit]
        if len(hit):
            starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            ends = np.append(starts[1:], len(first))
            for i, a, b in zip(first[starts].tolist(), starts.tolist(), ends.tolist()):
                yield i, second[a:b]
        g = to


def _fold_groups(keys: Sequence[str], id_col: str, conflict: Conflict, tiled: bool, owners: bool):
    """Arrow function over (keys, list of rows in rank order)."""
    nkeys = len(keys)

    def fold(batches):
        for rb in batches:
            lists = rb.column(nkeys)
            offsets = lists.offsets.to_numpy()
            rows = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = offsets - offsets[0]
            n = len(rows)
            names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
            cols = {f: rows.field(f).to_numpy(zero_copy_only=False) for f in (*_XY, *conflict.extra)}
            shared = rows.field("_nt").to_numpy() > 1 if tiled else np.zeros(n, bool)
            dropped = np.zeros(n, bool)
            blocked = np.zeros(n, bool)
            owner = np.arange(n)
            for i, hit in _hits(cols, offsets, conflict):
                if dropped[i]:
                    continue
                if shared[i] or blocked[i]:
                    blocked[hit] = True
                else:
                    if owners:
                        owner[hit[~dropped[hit]]] = i
                    dropped[hit] = True
            at = np.repeat(np.arange(rb.num_rows), np.diff(offsets))
            if tiled:
                verdict = np.where(dropped, 2, np.where(blocked, 1, 0)).astype(np.int32)
                mask = None
                extra = [pa.array(verdict)]
                extra_names = ["_verdict"]
            elif owners:
                mask = None
                extra = [rows.field(id_col).take(pa.array(owner))]
                extra_names = ["anchor_id"]
            else:
                mask = pa.array(~dropped)
                extra, extra_names = [], []
            keep = (lambda a: a) if mask is None else (lambda a: a.filter(mask))
            key_cols = [keep(rb.column(k).take(pa.array(at))) for k in range(nkeys)]
            body = keep(rows)
            fields = {f: body.field(f) for f in names}
            out = [f for f in names if not f.startswith("_o")]
            yield pa.RecordBatch.from_arrays(
                [*key_cols, *[fields[f] for f in out], *extra], [*keys, *out, *extra_names]
            )

    return fold


def _run_fold(ranked: DataFrame, keys, group_keys, id_col, order_names, carry, conflict, tiled=False, owners=False):
    """Group into rank-ordered lists (bounded by the caller) and fold them."""
    payload = [id_col, *_XY, *carry, *(["_nt"] if tiled else [])]
    lists = ranked.groupBy(*group_keys).agg(
        F.sort_array(F.collect_list(F.struct(*order_names, *payload))).alias("_rows")
    )
    by_name = {f.name: f for f in ranked.schema.fields}
    fields = [by_name[k] for k in group_keys] + [by_name[c] for c in payload]
    if tiled:
        fields.append(T.StructField("_verdict", T.IntegerType()))
    elif owners:
        fields.append(T.StructField("anchor_id", by_name[id_col].dataType))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    return lists.mapInArrow(_fold_groups(list(group_keys), id_col, conflict, tiled, owners), schema)


def _ordered(df: DataFrame, order: Sequence[Column], id_col: str):
    names = []
    for i, c in enumerate(order):
        df = df.withColumn(f"_o{i}", c)
        names.append(f"_o{i}")
    return df.withColumn("_oid", F.col(id_col)), [*names, "_oid"]


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys of the groups with more than ``limit`` rows (at most rows/limit of them)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)


def greedy_keep(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    order: Sequence[Column],
    conflict: Conflict,
    carry: Sequence[str] = (),
    limit: int = LIMIT,
) -> DataFrame:
    """Rows kept by first-fit in ``order`` (ascending, then id) within ``keys``.

    Returns keys, id, box and ``carry`` columns of the kept rows.
    """
    return _greedy(df, keys, id_col, order, conflict, carry, limit, owners=False)


def greedy_cover(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    order: Sequence[Column],
    conflict: Conflict,
    carry: Sequence[str] = (),
    limit: int = LIMIT,
) -> DataFrame:
    """Every row with ``anchor_id``: itself when kept, else the first kept row it conflicts with."""
    return _greedy(df, keys, id_col, order, conflict, carry, limit, owners=True)


def _greedy(df, keys, id_col, order, conflict, carry, limit, owners):
    keys = list(keys)
    carry = [c for c in dict.fromkeys([*carry, *conflict.extra]) if c not in (id_col, *_XY)]
    ranked, order_names = _ordered(df, order, id_col)
    ranked = ranked.select(*keys, *order_names, id_col, *_XY, *carry)
    hot = hot_groups(df, keys, limit)
    if hot.isEmpty():
        return _run_fold(ranked, keys, keys, id_col, order_names, carry, conflict, owners=owners)
    small = _run_fold(ranked.join(hot, keys, "left_anti"), keys, keys, id_col, order_names, carry, conflict, owners=owners)
    large = ranked.join(hot, keys, "left_semi")
    kept = _rounds(large, keys, id_col, order_names, carry, conflict, limit)
    if not owners:
        return small.unionByName(kept.select(*small.columns))
    return small.unionByName(_first_anchor(large, kept, keys, id_col, order_names, carry, conflict).select(*small.columns))


def _first_anchor(large, kept, keys, id_col, order_names, carry, conflict):
    """Assign the rows of the large groups to the first kept row they conflict with."""
    extra = [c for c in conflict.extra if c not in _XY]
    probe = list(dict.fromkeys([*_XY, *extra]))
    distinct = large.select(*keys, *probe).distinct()
    pairs = cross_pairs(
        distinct,
        kept,
        keys,
        conflict.columns,
        left_cols=extra,
        right_cols=[id_col, *order_names, *extra],
        pad=conflict.pad,
        span=conflict.span,
    )
    first = pairs.groupBy(*keys, *[f"a_{c}" for c in probe]).agg(
        F.min(F.struct(*[F.col(f"b_{o}") for o in order_names], F.col(f"b_{id_col}").alias("anchor_id"))).alias("_m")
    )
    first = first.select(*keys, *[F.col(f"a_{c}").alias(c) for c in probe], F.col("_m.anchor_id").alias("_hit"))
    selfs = kept.select(*keys, F.col(id_col), F.col(id_col).alias("_self"))
    return (
        large.join(selfs, [*keys, id_col], "left")
        .join(first, [*keys, *probe], "left")
        .withColumn("anchor_id", F.coalesce("_self", "_hit", id_col))
    )


def _tiles(df: DataFrame, keys, pad: float) -> DataFrame:
    """Add ``_tile`` (exploded) and ``_nt``, the number of tiles a box touches."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + F.lit(pad)
    edge = df.groupBy(*keys).agg(F.greatest(F.avg(side) * 8, F.max(side) / 2, F.lit(1.0)).alias("_edge"))
    half = F.lit(pad / 2.0)

    def cell(c):
        return F.floor(c / F.col("_edge"))

    tiles = F.flatten(
        F.transform(
            F.sequence(cell(F.col("x1") - half), cell(F.col("x2") + half)),
            lambda cx: F.transform(
                F.sequence(cell(F.col("y1") - half), cell(F.col("y2") + half)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))
            ),
        )
    )
    return (
        df.join(edge, list(keys))
        .withColumn("_ts", tiles)
        .withColumn("_nt", F.size("_ts"))
        .withColumn("_tile", F.explode("_ts"))
        .drop("_ts", "_edge")
    )


def _rounds(large: DataFrame, keys, id_col, order_names, carry, conflict: Conflict, limit: int) -> DataFrame:
    cols = [*keys, *order_names, id_col, *_XY, *carry]
    probe = list(dict.fromkeys([*_XY, *conflict.extra]))
    open_rows = large.select(*cols)
    if conflict.copies_conflict:
        # Copies of one box share every conflict, so only the best copy can be kept. Boxes
        # without area overlap nothing under an area rule and stay as they are.
        area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
        flat = F.lit(False) if conflict.pad > 0 else area <= 0
        best = (
            open_rows.where(~flat)
            .groupBy(*keys, *probe)
            .agg(F.min(F.struct(*order_names, id_col, *[c for c in carry if c not in probe])).alias("_m"))
        )
        open_rows = best.select(*keys, *probe, "_m.*").select(*cols).unionByName(open_rows.where(flat))
    open_rows = cut(open_rows)
    kept = None
    while not open_rows.isEmpty():
        tiled = _tiles(open_rows, keys, conflict.pad)
        rank = F.row_number().over(W.partitionBy(*keys, "_tile").orderBy(*order_names))
        head = tiled.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")
        verdicts = _run_fold(head, keys, [*keys, "_tile"], id_col, order_names, carry, conflict, tiled=True)
        per_row = verdicts.groupBy(*keys, id_col).agg(
            F.max("_verdict").alias("_v"), F.count(F.lit(1)).alias("_seen"), F.first("_nt").alias("_nt")
        )
        settled = cut(
            per_row.select(
                *keys,
                id_col,
                F.when(F.col("_v") == 2, F.lit(False))
                .when((F.col("_v") == 0) & (F.col("_seen") == F.col("_nt")), F.lit(True))
                .alias("_keep"),
            ).where(F.col("_keep").isNotNull())
        )
        new = cut(open_rows.join(settled.where("_keep").drop("_keep"), [*keys, id_col], "left_semi"))
        rest = open_rows.join(settled.drop("_keep"), [*keys, id_col], "left_anti")
        extra = [c for c in conflict.extra if c not in _XY]
        hits = cross_pairs(
            rest, new, keys, conflict.columns, left_cols=[id_col, *extra], right_cols=extra, pad=conflict.pad, span=conflict.span
        )
        gone = hits.select(*keys, F.col(f"a_{id_col}").alias(id_col)).distinct()
        open_rows = cut(rest.join(gone, [*keys, id_col], "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
    return kept


# --- sequential removal -----------------------------------------------------
def sequential_removal(events: DataFrame, keys: Sequence[str], at: Sequence[str], winner: str, loser: str, limit: int = 65536) -> DataFrame:
    """Ids removed by a list of events, each firing only while both of its rows are alive.

    Events are taken in the order of the ``at`` columns. Returns keys and ``loser``.
    """
    keys = list(keys)
    ev = events.select(*keys, F.struct(*at).alias("_at"), F.col(winner).alias("_w"), F.col(loser).alias("_l"))
    ev = cut(ev)  # read twice below, and the pair join behind it is the costly part
    hot = hot_groups(ev, keys, limit)
    if hot.isEmpty():
        return _removal_fold(ev, keys).withColumnRenamed("_l", loser)
    small = _removal_fold(ev.join(hot, keys, "left_anti"), keys)
    large = _removal_rounds(ev.join(hot, keys, "left_semi"), keys)
    return small.unionByName(large).withColumnRenamed("_l", loser)


def _removal_fold(ev: DataFrame, keys) -> DataFrame:
    lists = ev.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_w", "_l"))).alias("_e"))
    nkeys = len(keys)

    def fold(batches):
        for rb in batches:
            lists_ = rb.column(nkeys)
            offsets = lists_.offsets.to_pylist()
            rows = lists_.values
            win, lose = rows.field("_w").to_pylist(), rows.field("_l").to_pylist()
            at, out = [], []
            for g, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
                dead = set()
                for e in range(lo, hi):
                    if win[e] not in dead and lose[e] not in dead:
                        dead.add(lose[e])
                at.extend([g] * len(dead))
                out.extend(dead)
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(k).take(idx) for k in range(nkeys)], pa.array(out, rows.field("_l").type)], [*keys, "_l"]
            )

    by_name = {f.name: f.dataType for f in ev.schema.fields}
    schema = T.StructType([T.StructField(k, by_name[k]) for k in keys] + [T.StructField("_l", by_name["_l"])])
    return lists.mapInArrow(fold, schema)


def _removal_rounds(ev: DataFrame, keys) -> DataFrame:
    """Fire, in each round, the events that come first for both of their rows."""
    ev = cut(ev)
    removed = None
    while not ev.isEmpty():
        ends = ev.select(*keys, F.explode(F.array("_w", "_l")).alias("_v"), "_at")
        first = ends.groupBy(*keys, "_v").agg(F.min("_at").alias("_first"))
        fired = cut(
            ev.join(first.select(*keys, F.col("_v").alias("_w"), F.col("_first").alias("_fw")), [*keys, "_w"])
            .join(first.select(*keys, F.col("_v").alias("_l"), F.col("_first").alias("_fl")), [*keys, "_l"])
            .where((F.col("_at") == F.col("_fw")) & (F.col("_at") == F.col("_fl")))
            .select(*keys, "_l")
            .distinct()
        )
        ev = cut(
            ev.join(fired, [*keys, "_l"], "left_anti").join(fired.withColumnRenamed("_l", "_w"), [*keys, "_w"], "left_anti")
        )
        removed = fired if removed is None else removed.unionByName(fired)
    return removed
