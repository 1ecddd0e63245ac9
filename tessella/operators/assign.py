"""Optimal one-to-one assignment of scored pairs."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.operators.boxlists import flat_rows, large_pairs, list_slices, ordered, overlapping
from tessella.operators.cluster import EDGE_LIMIT, components
from tessella.session import cut


DENSE = 4096  # cells of a matrix that is solved as such


def best_columns(score: np.ndarray) -> np.ndarray:
    """Column per row (-1 for none) with the largest total score, by shortest augmenting paths."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    row_pot, col_pot = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # row that holds a column; slot m is the row being placed
    for r in range(n):
        owner[m] = r
        at = m
        dist, seen, back = np.full(m, np.inf), np.zeros(m + 1, bool), np.full(m, m)
        while owner[at] != -1:
            seen[at] = True
            i = owner[at]
            free = ~seen[:m]
            step = cost[i] - row_pot[i] - col_pot[:m]
            closer = free & (step < dist)
            dist[closer] = step[closer]
            back[closer] = at
            nxt = int(np.argmin(np.where(free, dist, np.inf)))
            delta = dist[nxt]
            row_pot[owner[seen]] += delta
            col_pot[seen] -= delta
            dist[free] -= delta
            at = nxt
        while at != m:
            owner[at] = owner[back[at]]
            at = back[at]
    out = np.full(score.shape[0], -1)
    held = np.flatnonzero(owner[:m] >= 0)
    if flip:
        out[held] = owner[held]
    else:
        out[owner[held]] = held
    return out


def best_pairs(rows: np.ndarray, cols: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the pairs with the largest total of positive scores, one per row and column at most.

    Shortest augmenting paths over the pairs there are: memory grows with their number, and a search only goes as
    far as the best free column or as giving up a row pays. Rows and columns are numbered from 0.
    """
    n, m = int(rows.max()) + 1, int(cols.max()) + 1
    order = np.argsort(rows, kind="stable")
    bounds = np.searchsorted(rows[order], np.arange(n + 1)).tolist()
    to, cost, edge = cols[order].tolist(), (-score[order]).tolist(), order.tolist()
    row_pot = [min(cost[bounds[i] : bounds[i + 1]], default=0.0) for i in range(n)]
    col_pot = [0.0] * m
    owner, chosen = [-1] * m, [-1] * n  # row of a column; place in ``to`` of a row's pair
    for start in range(n):
        dist, via, closed = {}, {}, {}  # of columns; the pair over which a column was reached; columns searched, in order
        heap, row, at = [], start, 0.0
        stop, stop_row, stop_col = float("inf"), start, -1
        while True:
            if at - row_pot[row] < stop:  # leave this row without a column
                stop, stop_row, stop_col = at - row_pot[row], row, -1
            for e in range(bounds[row], bounds[row + 1]):
                j = to[e]
                if j in closed:
                    continue
                d = at + cost[e] - row_pot[row] - col_pot[j]
                if d < stop and d < dist.get(j, stop):
                    dist[j], via[j] = d, (e, row)
                    heapq.heappush(heap, (d, j))
            col = -1
            while heap:
                d, j = heapq.heappop(heap)
                if d >= stop:
                    break
                if j not in closed and d == dist[j]:
                    col = j
                    break
            if col < 0:
                break
            if owner[col] < 0:
                stop, stop_row, stop_col = dist[col], -1, col
                break
            closed[col] = True
            row, at = owner[col], dist[col]
        row_pot[start] += stop
        for j in closed:
            col_pot[j] += dist[j] - stop
            row_pot[owner[j]] += stop - dist[j]
        # Turn the pairs of the path over, from its end to the row it began with.
        if stop_col < 0:
            if stop_row == start:
                continue
            stop_col, chosen[stop_row] = to[chosen[stop_row]], -1
        while True:
            e, row = via[stop_col]
            owner[stop_col] = row
            before, chosen[row] = chosen[row], e
            if row == start:
                break
            stop_col = to[before]
    return np.array(sorted(edge[e] for e in chosen if e >= 0), np.int64)


def best_columns_of_many(cost: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``best_columns`` of many small matrices at once: each step is taken by all matrices that are still under way.

    ``cost`` (matrix, row, column) holds falling scores, infinity in columns beyond a matrix's own; ``rows`` is the number of rows
    of each, no more than its columns. Column per row, -1 beyond the rows.
    """
    k, n, m = cost.shape
    row_pot, col_pot = np.zeros((k, n)), np.zeros((k, m + 1))
    owner = np.full((k, m + 1), -1)
    for r in range(n):
        at_row = np.flatnonzero(rows > r)
        owner[at_row, m] = r
        at = np.full(k, m)
        dist, seen, back = np.full((k, m), np.inf), np.zeros((k, m + 1), bool), np.full((k, m), m)
        live = at_row
        while len(live):
            here = at[live]
            seen[live, here] = True
            i = owner[live, here]
            free = ~seen[live, :m]
            step = cost[live, i] - row_pot[live, i][:, None] - col_pot[live, :m]
            d = dist[live]
            closer = free & (step < d)
            d = np.where(closer, step, d)
            back[live] = np.where(closer, here[:, None], back[live])
            open_ = np.where(free, d, np.inf)
            nxt = open_.argmin(1)
            delta = open_[np.arange(len(live)), nxt]
            x, c = np.nonzero(seen[live])
            row_pot[live[x], owner[live[x], c]] += delta[x]
            col_pot[live[x], c] -= delta[x]
            dist[live] = np.where(free, d - delta[:, None], d)
            at[live] = nxt
            live = live[owner[live, nxt] != -1]
        live = at_row
        while len(live):
            here = at[live]
            before = back[live, here]
            owner[live, here] = owner[live, before]
            at[live] = before
            live = live[before != m]
    out = np.full((k, n), -1)
    x, c = np.nonzero(owner[:, :m] >= 0)
    out[x, owner[x, c]] = c
    return out


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _numbered(*cols: np.ndarray) -> np.ndarray:
    """A number for each distinct row of ``cols``, in their order."""
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    for c in cols:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _within(comp: np.ndarray, node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each pair's node inside its component, and the nodes of each of ``n`` components."""
    names, first, inv = np.unique(node, return_index=True, return_inverse=True)
    owner = comp[first]
    order = np.argsort(owner, kind="stable")
    size = np.bincount(owner, minlength=n)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names)) - np.repeat(np.cumsum(size) - size, size)
    return place[inv], size


CELLS = 1 << 18  # of the matrices that are solved together


def chosen_pairs(group: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the pairs with the largest total per group; pairs come in the order (group, a, b, score).

    Groups fall apart into connected components. Those of one row or column take their best pair, small ones are solved together by
    size, those over ``DENSE`` cells by themselves.
    """
    if not len(a):
        return np.zeros(0, np.int64)
    na, nb = _numbered(group, a), _numbered(group, b)
    n = int(na[-1]) + 1 if len(na) else 0
    comp = np.unique(_labels(na, nb + n, n + int(nb.max()) + 1)[na], return_inverse=True)[1]
    many = int(comp.max()) + 1
    ia, rows = _within(comp, na, many)
    ib, cols = _within(comp, nb, many)
    best = np.lexsort((np.arange(len(a)), -score, comp))
    best = best[np.append(True, comp[best[1:]] != comp[best[:-1]])]
    keep = [best[(rows == 1) | (cols == 1)]]
    order = np.argsort(comp, kind="stable")
    bounds = np.searchsorted(comp[order], np.arange(many + 1))
    matrix = (rows > 1) & (cols > 1)
    for c in np.flatnonzero(matrix & (rows * cols > DENSE)):
        own = order[bounds[c] : bounds[c + 1]]
        keep.append(own[best_pairs(ia[own], ib[own], score[own])])
    flip = rows > cols
    short, long = np.minimum(rows, cols), np.maximum(rows, cols)
    todo = np.flatnonzero(matrix & (rows * cols <= DENSE))
    todo = todo[np.lexsort((long[todo], short[todo]))]
    while len(todo):
        # Sizes rise, so those before a place fit into the largest of them.
        cells = np.arange(1, len(todo) + 1) * np.maximum.accumulate(short[todo]) * np.maximum.accumulate(long[todo])
        take = max(1, int(np.searchsorted(cells, CELLS, "right")))
        now, todo = todo[:take], todo[take:]
        own = np.concatenate([order[bounds[c] : bounds[c + 1]] for c in now])
        k = np.repeat(np.arange(len(now)), bounds[now + 1] - bounds[now])
        turned = flip[now][k]
        i, j = np.where(turned, ib[own], ia[own]), np.where(turned, ia[own], ib[own])
        cost = np.where(np.arange(long[now].max()) < long[now][:, None], 0.0, np.inf)[:, None, :].repeat(short[now].max(), 1)
        cost[k, i, j] = -score[own]
        keep.append(own[best_columns_of_many(cost, short[now])[k, i] == j])
    return np.sort(np.concatenate(keep))


def assign(pairs: DataFrame, keys: Sequence[str], a: str, b: str, score: str, limit: int = EDGE_LIMIT) -> DataFrame:
    """One-to-one pairs (keys, a, b, score) with the largest total of positive scores per group.

    Rows that share no positive pair cannot influence each other, so every connected component of the pair graph is solved by
    itself. Groups of up to ``limit`` pairs are split and solved inside one task; the components of larger ones are found in rounds
    over all tasks, and a component is solved in memory that grows with its pairs.

    ``pairs`` may also be ``box_lists`` with the ids in their columns: overlapping boxes are then the pairs and ``score`` their IoU. Keys
    that are no keys of the lists are columns of the left rows.
    """
    keys = list(keys)
    if "_l" in pairs.columns:
        return _assign_lists(pairs, keys, a, b, score, limit)
    live = pairs.where(F.col(score) > 0).select(*keys, a, b, score)
    large = F.count(F.lit(1)).over(W.partitionBy(*keys)) > limit
    # A pair of a large group is a list of its own and only passes through. What is written is the pairs found, and large groups.
    lists = live.withColumn("_large", large).groupBy(*keys, F.when(F.col("_large"), F.col(a)).alias("_ka"), F.when(F.col("_large"), F.col(b)).alias("_kb")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("s")))).alias("_p")
    )
    nkeys = len(keys)

    def solve(batches):
        for rb in _slices(batches, nkeys + 2):
            g, va, vb, vs = _flat(rb.column(nkeys + 2))
            passed = rb.column(nkeys).is_valid().to_numpy(zero_copy_only=False)[g]
            own = np.flatnonzero(~passed)
            k = np.sort(np.concatenate([np.flatnonzero(passed), own[chosen_pairs(g[own], va[own], vb[own], vs[own])]]))
            yield _found(rb, nkeys, g, va, vb, vs, k, [*keys, a, b, score, "_large"], [pa.array(passed[k])])

    types = {f.name: f.dataType for f in live.schema.fields}
    schema = T.StructType([*[T.StructField(c, types[c]) for c in [*keys, a, b, score]], T.StructField("_large", T.BooleanType())])
    done = cut(lists.mapInArrow(solve, schema))
    found, rest = done.where("NOT _large").drop("_large"), done.where("_large").drop("_large")
    return found if rest.isEmpty() else found.unionByName(_assign_large(rest, keys, a, b, score))


def _assign_lists(lists: DataFrame, keys: list[str], a: str, b: str, score: str, limit: int) -> DataFrame:
    own = [k for k in keys if k in lists.columns]
    sets, n = [k for k in keys if k not in own], len(own)
    names = [*own, *sets, a, b, score, "_large"]

    def solve(batches):
        for rb, large in list_slices(batches, n):
            if large:  # a row tells that there are such groups
                yield pa.RecordBatch.from_arrays([*[rb.column(i).slice(0, 1) for i in range(n)], *[pa.nulls(1, t) for t in kinds], pa.array([True])], names)
                continue
            (g, left), (h, right) = flat_rows(rb.column(n + 2)), flat_rows(rb.column(n + 3))
            g, left = ordered(g, left, *[left[c] for c in (*sets, a)])
            h, right = ordered(h, right, right[b])
            i, j, iou = overlapping(g, left, h, right)
            k = chosen_pairs(_numbered(g, *[left[c] for c in sets])[i], left[a][i], right[b][j], iou)
            at, i, j = pa.array(g[i[k]]), i[k], j[k]
            cols = [*[left[c][i] for c in (*sets, a)], right[b][j], iou[k]]
            yield pa.RecordBatch.from_arrays([*[rb.column(x).take(at) for x in range(n)], *[pa.array(c).cast(t) for c, t in zip(cols, kinds)], pa.array(np.zeros(len(k), bool))], names)

    left, right = (lists.schema[c].dataType.elementType for c in ("_l", "_r"))
    fields = [*[left[c] for c in (*sets, a)], right[b], T.StructField(score, T.DoubleType())]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([*[lists.schema[c] for c in own], *[T.StructField(f.name, f.dataType) for f in fields], T.StructField("_large", T.BooleanType())])
    done = cut(lists.mapInArrow(solve, schema))
    found = done.where("NOT _large").select(*keys, a, b, score)
    if done.where("_large").isEmpty():
        return found
    pairs = large_pairs(lists, own, [*sets, a], [b]).withColumnRenamed("iou", score)
    return found.unionByName(assign(pairs, keys, a, b, score, limit))


PAIRS = 1 << 18  # looked at together


def _slices(batches, col: int):
    """Runs of rows whose lists hold about ``PAIRS`` pairs together, at least one row."""
    for rb in batches:
        off, at = rb.column(col).offsets.to_numpy(), 0
        while at < rb.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + PAIRS, "right")) - 1)
            yield rb.slice(at, to - at)
            at = to


def _flat(lists: pa.Array, fields: Sequence[str] = ("a", "b", "s")):
    """List number and the fields, a, b and score of a pair, of every row."""
    off = lists.offsets.to_numpy()
    v = lists.values.slice(off[0], off[-1] - off[0])
    return np.repeat(np.arange(len(lists)), np.diff(off)), *(v.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _found(rb: pa.RecordBatch, nkeys: int, g, va, vb, vs, k, names, more=()) -> pa.RecordBatch:
    at = pa.array(g[k])
    return pa.RecordBatch.from_arrays([*[rb.column(i).take(at) for i in range(nkeys)], pa.array(va[k]), pa.array(vb[k]), pa.array(vs[k]), *more], names)


def _assign_large(live: DataFrame, keys: list[str], a: str, b: str, score: str) -> DataFrame:
    # Both sides in one id space: even numbers for a, odd for b.
    tagged = live.withColumn("_na", F.col(a) * 2).withColumn("_nb", F.col(b) * 2 + 1)
    nodes = tagged.select(*keys, F.col("_na").alias("_node")).distinct()
    comp = components(nodes, tagged.select(*keys, F.col("_na").alias("a"), F.col("_nb").alias("b")), keys, "_node")
    grouped = tagged.join(comp.withColumnRenamed("_node", "_na"), [*keys, "_na"])
    return solve_groups(grouped, [*keys, "component"], a, b, score).drop("component")


def solve_groups(pairs: DataFrame, keys: Sequence[str], a: str, b: str, score: str) -> DataFrame:
    """Assignment inside each group as a whole, in one task."""
    keys = list(keys)
    lists = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("s")))).alias("_p"))
    nkeys = len(keys)

    def solve(batches):
        for rb in _slices(batches, nkeys):
            g, va, vb, vs = _flat(rb.column(nkeys))
            yield _found(rb, nkeys, g, va, vb, vs, chosen_pairs(g, va, vb, vs), [*keys, a, b, score])

    types = {f.name: f.dataType for f in pairs.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in [*keys, a, b, score]])
    return lists.mapInArrow(solve, schema)
