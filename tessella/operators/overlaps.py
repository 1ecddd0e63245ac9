"""Overlap detection and the rules that act on overlapping rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions import boxes as bx
from tessella.functions.boxes import box
from tessella.functions.rules import IMAGE_TYPES
from tessella.operators.greedy import sequential_removal
from tessella.operators.spatial import cross_pairs, self_pairs, span_for_ratio
from tessella.session import cut

XY = ("x1", "y1", "x2", "y2")


def overlap_pairs(df: DataFrame, keys: Sequence[str], id_col: str, min_iou: float = 0.1, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b with IoU of at least ``min_iou``, their IoU and relationship label."""
    pairs = self_pairs(
        df, keys, id_col, lambda a, b: bx.iou(box(a), box(b)) >= min_iou, carry=carry, span=span_for_ratio(min_iou),
        extra={"iou": lambda a, b: bx.iou(box(a), box(b)), "_rel": lambda a, b: bx.relationship(box(a), box(b))},
    )
    same_box = (F.col("a_x1") == F.col("b_x1")) & (F.col("a_y1") == F.col("b_y1")) & (F.col("a_x2") == F.col("b_x2")) & (F.col("a_y2") == F.col("b_y2"))
    label = (
        F.when(~F.col("flipped") | same_box, F.col("_rel"))
        .when(F.col("_rel") == "contains", "contained")
        .when(F.col("_rel") == "contained", "contains")
        .otherwise(F.col("_rel"))
    )
    return pairs.withColumn("relationship", label).drop("_rel", "flipped")


def drop_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """New boxes that overlap no existing box by more than ``threshold``; copies are tested once."""
    from tessella.operators.spatial import without_overlaps

    return without_overlaps(
        new, existing, keys, lambda a, b: bx.iou(box(a), box(b)) > threshold, span=span_for_ratio(threshold)
    )


def contained_rows(
    df: DataFrame, keys: Sequence[str], id_col: str, share: float, image_types_only: bool, equal_area_counts: bool = False
) -> DataFrame:
    """(keys, id) removed as contained by more than ``share`` in a larger row, in table order.

    A row stops acting once it is removed; pairs act in the order (lower id, higher id). With
    ``equal_area_counts`` the later of two rows of equal area is the contained one.
    """

    def inside(small, big):
        """``small`` lies in ``big`` and ``big`` may act on it."""
        p, q = box(small), box(big)
        smaller = p.area < q.area
        if equal_area_counts:
            smaller = smaller | ((p.area == q.area) & (F.col(f"{small}{id_col}") > F.col(f"{big}{id_col}")))
        if image_types_only:
            smaller = smaller & F.lower(f"{big}element_type").isin(IMAGE_TYPES)
        return smaller

    pairs = self_pairs(
        df, keys, id_col,
        lambda p, q: (bx.over_min(box(p), box(q)) > share) & (inside(p, q) | inside(q, p)),
        carry=["element_type"] if image_types_only else [],
        extra={"_l": lambda p, q: F.when(inside(p, q), F.col(f"{p}{id_col}")).otherwise(F.col(f"{q}{id_col}"))},
    )
    ida, idb = F.col(f"a_{id_col}"), F.col(f"b_{id_col}")
    events = pairs.select(
        *keys, ida.alias("_t1"), idb.alias("_t2"), F.when(F.col("_l") == ida, idb).otherwise(ida).alias("_w"), F.col("_l").alias(id_col)
    )
    return sequential_removal(events, keys, ["_t1", "_t2"], "_w", id_col)


def drop_contained(df: DataFrame, keys: Sequence[str], id_col: str, share: float = 0.85, image_types_only: bool = True, equal_area_counts: bool = False) -> DataFrame:
    gone = contained_rows(df, keys, id_col, share, image_types_only, equal_area_counts)
    return df.join(gone, [*keys, id_col], "left_anti")


def drop_contained_one_shot(df: DataFrame, keys: Sequence[str], id_col: str, share: float = 0.8) -> DataFrame:
    """As above but every larger row acts, removed or not."""
    hits = self_pairs(df, keys, id_col, lambda p, q: bx.over_min(box(p), box(q)) > share)
    a, b = box("a_"), box("b_")
    gone = hits.where(a.area != b.area).select(*keys, F.when(a.area < b.area, F.col(f"a_{id_col}")).otherwise(F.col(f"b_{id_col}")).alias(id_col)).distinct()
    return df.join(gone, [*keys, id_col], "left_anti")


# --- X10 resolution ---------------------------------------------------------
def resolve_merge(df: DataFrame, overlaps: DataFrame, keys: Sequence[str], id_col: str, threshold: float = 0.8) -> DataFrame:
    """Drop the smaller row of every pair over ``threshold`` (the later one on equal area)."""
    a, b = box("a_"), box("b_")
    loser = F.when(a.area >= b.area, F.col(f"b_{id_col}")).otherwise(F.col(f"a_{id_col}"))
    gone = overlaps.where(F.col("iou") > threshold).select(*keys, loser.alias(id_col)).distinct()
    return df.join(gone, [*keys, id_col], "left_anti")


def resolve_priority(df: DataFrame, overlaps: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Drop the lower-scored row of every overlapping pair (needs ``score`` carried)."""
    loser = F.when(F.col("a_score") >= F.col("b_score"), F.col(f"b_{id_col}")).otherwise(F.col(f"a_{id_col}"))
    return df.join(overlaps.select(*keys, loser.alias(id_col)).distinct(), [*keys, id_col], "left_anti")


def _once(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``col`` worked out once per row: a filter is not moved before what explodes, so it does not repeat a long expression."""
    return df.withColumn(col, F.explode(F.array(col)))


def resolve_layers(df: DataFrame, overlaps: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Put a container one layer below the lowest row it contains.

    Only the first row of a pair acts as container and rows act in id order, so a child's layer
    is still its own when its container looks at it: the fold collapses to one minimum.
    """
    lowest = (
        _once(overlaps, "relationship").where("relationship = 'contains'")
        .groupBy(*keys, F.col(f"a_{id_col}").alias(id_col))
        .agg((F.min("b_layer_level") - 1).alias("_below"))
    )
    return (
        df.join(lowest, [*keys, id_col], "left")
        .withColumn("layer_level", F.least("layer_level", "_below"))
        .drop("_below")
    )


def structure_suggestions(overlaps: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    kind = (
        F.when(F.col("relationship") == "contains", "container_child")
        .when(F.col("relationship") == "stacked", "stacked_layers")
        .when(F.col("relationship") == "overlaps", "partial_overlap")
    )
    known = F.col("relationship").isin("contains", "stacked", "overlaps")
    return _once(overlaps, "relationship").where(known).withColumn("suggestion", kind).select(
        *keys, F.col(f"a_{id_col}").alias("lower_id"), F.col(f"b_{id_col}").alias("upper_id"), "suggestion"
    )


# --- J11 near-duplicate polylines --------------------------------------------
PATHS, POINTS = 1024, 1 << 16  # of a group that is one list


def duplicate_paths(df: DataFrame, keys: Sequence[str], id_col: str, near: float = 15.0, short: float = 30.0, limit: int = PATHS) -> DataFrame:
    """(keys, id) of paths that repeat another: same ends (either way), or a short path whose
    end lies near the other. The shorter goes (the later on equal length), in id order.

    The paths of a group of up to ``limit`` paths and ``POINTS`` points are listed and compared inside one task; the pairs of larger groups are found
    by joins."""
    from tessella.functions import paths

    keys = list(keys)
    n = len(keys)
    rows = df.where(F.size("pts") >= 2).where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(
        *keys, F.col(id_col).alias("_id"), "pts", ((F.count(F.lit(1)).over(W.partitionBy(*keys)) > limit) | (F.sum(F.size("pts")).over(W.partitionBy(*keys)) > POINTS)).alias("_large")
    )
    # A path of a large group is not listed: only its keys pass.
    path = F.when(~F.col("_large"), F.struct("_id", paths.length(F.col("pts")).alias("len"), F.transform("pts", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("pts")))
    lists = rows.groupBy(*keys, "_large").agg(F.collect_list(path).alias("_p"))
    id_type = to_arrow_type(df.schema[id_col].dataType)
    names = [*keys, id_col, "_large"]

    def fold(batches):
        for rb in batches:
            large = rb.filter(rb.column(n))
            if large.num_rows:
                yield pa.RecordBatch.from_arrays([*[large.column(k) for k in range(n)], pa.nulls(large.num_rows, id_type), large.column(n)], names)
            size = np.diff(rb.column(n + 1).offsets.to_numpy()).astype(np.int64)
            work, at = np.append(0, np.cumsum(size * size)), 0
            while at < rb.num_rows:
                to = max(at + 1, int(np.searchsorted(work, work[at] + PATH_PAIRS, "right")) - 1)
                part, at = rb.slice(at, to - at), to
                g, gone = _repeated_paths(part.column(n + 1), near, short)
                g = pa.array(g)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(g) for k in range(n)], pa.array(gone).cast(id_type), pa.array(np.zeros(len(g), bool))], names)

    done = cut(lists.mapInArrow(fold, T.StructType([*[df.schema[k] for k in keys], df.schema[id_col], T.StructField("_large", T.BooleanType())])))
    found, hot = done.where("NOT _large").drop("_large"), done.where("_large").select(*keys)
    if hot.isEmpty():
        return found
    return found.unionByName(_duplicate_paths_by_pairs(df.join(hot, keys, "left_semi"), keys, id_col, near, short))


PATH_PAIRS = 1 << 18  # looked at together


def _repeated_paths(lists: pa.Array, near: float, short: float) -> tuple[np.ndarray, np.ndarray]:
    """Place of the group and id of the paths that go, by the rule of ``duplicate_paths``."""
    off = lists.offsets.to_numpy()
    v = lists.values.slice(off[0], off[-1] - off[0])
    g, ids = np.repeat(np.arange(len(lists)), np.diff(off)), v.field("_id").to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, g))
    g, ids, size = g[order], ids[order], v.field("len").to_numpy(zero_copy_only=False)[order]
    points = v.field("pts")
    start, end = points.offsets.to_numpy()[:-1][order], points.offsets.to_numpy()[1:][order]
    x, y = (points.values.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    later = np.searchsorted(g, g, "right") - np.arange(len(g)) - 1
    i = np.repeat(np.arange(len(g)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]

    def close(p, q):
        dx, dy = x[p] - x[q], y[p] - y[q]
        return np.sqrt(dx * dx + dy * dy) < near

    hit = (close(start[i], start[j]) & close(end[i] - 1, end[j] - 1)) | (close(start[i], end[j] - 1) & close(end[i] - 1, start[j]))
    for a, b in ((i, j), (j, i)):
        # A short path with an end near any point of the other.
        todo = np.flatnonzero(~hit & (size[a] < short))
        points = np.cumsum(end[b[todo]] - start[b[todo]], dtype=np.int64)
        for own in np.split(todo, np.flatnonzero(np.diff(points // (4 * PATH_PAIRS))) + 1):
            count = end[b[own]] - start[b[own]]
            pair = np.repeat(own, count)
            q = np.repeat(start[b[own]] - np.cumsum(count) + count, count) + np.arange(len(pair))
            hit[pair[close(start[a[pair]], q) | close(end[a[pair]] - 1, q)]] = True
    i, j = i[hit], j[hit]
    keep = size[i] >= size[j]
    row = np.cumsum(np.append(False, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]))) if len(g) else g
    dead = [False] * len(g)
    for w, l in zip(row[np.where(keep, i, j)].tolist(), row[np.where(keep, j, i)].tolist()):
        if not dead[w] and not dead[l]:
            dead[l] = True
    gone = np.unique(row, return_index=True)[1][np.array(dead[: int(row[-1]) + 1 if len(row) else 0], bool)]
    return g[gone], ids[gone]


def _duplicate_paths_by_pairs(df: DataFrame, keys: Sequence[str], id_col: str, near: float, short: float) -> DataFrame:
    """``duplicate_paths`` of groups of any size."""
    from tessella.functions import paths, polygons as pg

    hull = pg.hull(F.col("pts"))
    first, last = F.get("pts", F.lit(0)), F.element_at("pts", -1)
    ready = df.where(F.size("pts") >= 2).select(
        *keys, id_col, *[c.alias(n) for c, n in zip(hull, ("x1", "y1", "x2", "y2"))],
        F.struct(first["x"].alias("sx"), first["y"].alias("sy"), last["x"].alias("ex"), last["y"].alias("ey"), paths.length(F.col("pts")).alias("len"), F.col("pts").alias("pts")).alias("p"),
    )

    def close(ax, ay, bx_, by):
        return F.sqrt((ax - bx_) * (ax - bx_) + (ay - by) * (ay - by)) < near

    def near_any(x, y, pts):
        return F.exists(pts, lambda q: close(x, y, q["x"], q["y"]))

    def where(a, b):
        p, q = F.col(f"{a}p"), F.col(f"{b}p")
        same = close(p["sx"], p["sy"], q["sx"], q["sy"]) & close(p["ex"], p["ey"], q["ex"], q["ey"])
        swapped = close(p["sx"], p["sy"], q["ex"], q["ey"]) & close(p["ex"], p["ey"], q["sx"], q["sy"])
        p_head = (p["len"] < short) & (near_any(p["sx"], p["sy"], q["pts"]) | near_any(p["ex"], p["ey"], q["pts"]))
        q_head = (q["len"] < short) & (near_any(q["sx"], q["sy"], p["pts"]) | near_any(q["ex"], q["ey"], p["pts"]))
        return same | swapped | p_head | q_head

    pairs = self_pairs(ready, keys, id_col, where, carry=["p"], pad=near)
    ida, idb = F.col(f"a_{id_col}"), F.col(f"b_{id_col}")
    keep_a = F.col("a_p.len") >= F.col("b_p.len")
    events = pairs.select(
        *keys, ida.alias("_t1"), idb.alias("_t2"), F.when(keep_a, ida).otherwise(idb).alias("_w"), F.when(keep_a, idb).otherwise(ida).alias(id_col)
    )
    return sequential_removal(events, keys, ["_t1", "_t2"], "_w", id_col)


# --- coverage ---------------------------------------------------------------
BOXES = 1024  # of a group whose area is taken inside one task


def union_area(df: DataFrame, keys: Sequence[str], cell: float | None = None, limit: int = BOXES) -> DataFrame:
    """Area covered by at least one box per group.

    A group of up to ``limit`` boxes is one list, whose area one task takes. Boxes of larger groups are cut at the lines of a coarse grid,
    whose cells are worked on likewise; the boxes of fuller cells are cut into slabs by joins. What is written is a number for
    each list and the boxes of larger groups.
    """
    keys = list(keys)
    boxes = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in XY]).where("x2 > x1 AND y2 > y1")
    found, rest = _listed_areas(boxes, keys, limit)
    part, found = keys, found.select(*keys, "_a")
    large = not rest.isEmpty()
    if large and cell is not None:
        part = [*keys, "_cx", "_cy"]
        ix = F.sequence(F.floor(F.col("x1") / cell), F.ceil(F.col("x2") / cell) - 1)
        iy = F.sequence(F.floor(F.col("y1") / cell), F.ceil(F.col("y2") / cell) - 1)
        boxes = rest.withColumn("_cx", F.explode(ix)).withColumn("_cy", F.explode(iy)).select(
            *part, F.greatest("x1", F.col("_cx") * cell).alias("x1"), F.greatest("y1", F.col("_cy") * cell).alias("y1"),
            F.least("x2", (F.col("_cx") + 1) * cell).alias("x2"), F.least("y2", (F.col("_cy") + 1) * cell).alias("y2"),
        )
        cells, rest = _listed_areas(boxes, part, limit)
        found = found.unionByName(cells.select(*keys, "_a"))
        large = not rest.isEmpty()
    if large:
        found = found.unionByName(_slab_areas(rest, part).select(*keys, "_a"))
    return found.groupBy(*keys).agg(F.sum("_a").alias("covered"))


def _listed_areas(boxes: DataFrame, part: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(part, _a) of groups of up to ``limit`` boxes, and the distinct boxes of the others."""
    large = F.count(F.lit(1)).over(W.partitionBy(*part)) > limit
    own = F.when(F.col("_large"), F.struct(*XY)).alias("_box")
    lists = boxes.withColumn("_large", large).groupBy(*part, own).agg(F.collect_set(F.struct(*XY)).alias("_b"))
    n = len(part)

    def areas(batches):
        for rb in batches:
            off, v = rb.column(n + 1).offsets.to_numpy(), rb.column(n + 1).values
            xy = [v.field(c).to_numpy(zero_copy_only=False) for c in XY]
            size = np.diff(off)
            # Lists are taken together as long as their slabs stay few.
            work = np.append(0, np.cumsum(size.astype(np.int64) ** 2))
            out, at = np.zeros(rb.num_rows), 0
            while at < rb.num_rows:
                to = max(at + 1, int(np.searchsorted(work, work[at] + SLABS, "right")) - 1)
                here = slice(off[at], off[to])
                out[at:to] = covered_areas(np.repeat(np.arange(to - at), size[at:to]), *[c[here] for c in xy], to - at)
                at = to
            yield pa.RecordBatch.from_arrays([*[rb.column(i) for i in range(n + 1)], pa.array(out)], [*part, "_box", "_a"])

    types = {f.name: f for f in lists.schema.fields}
    done = cut(lists.mapInArrow(areas, T.StructType([*[types[c] for c in (*part, "_box")], T.StructField("_a", T.DoubleType())])))
    return done.where("_box IS NULL").select(*part, "_a"), done.where("_box IS NOT NULL").select(*part, "_box.*")


SLABS = 1 << 21


def covered_areas(group: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, n: int) -> np.ndarray:
    """Area of the boxes of each of ``n`` groups: the x cuts make slabs, a slab's height is the length of its merged y intervals."""
    k = len(group)
    if not k:
        return np.zeros(n)
    g, x = np.concatenate([group, group]), np.concatenate([x1, x2])
    order = np.lexsort((x, g))
    new = np.append(True, (g[order[1:]] != g[order[:-1]]) | (x[order[1:]] != x[order[:-1]]))
    place = np.empty(2 * k, np.int64)
    place[order] = np.cumsum(new) - 1
    edge, home = x[order][new], g[order][new]
    count = place[k:] - place[:k]
    box = np.repeat(np.arange(k), count)
    slab = place[:k][box] + np.arange(len(box)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((y1[box], slab))
    box, slab = box[order], slab[order]
    # The highest y so far inside the slab: with the slab in front, a running maximum starts anew at each.
    heights, rank = np.unique(y2, return_inverse=True)
    reach = np.maximum.accumulate(slab * len(heights) + rank[box])
    before = np.append(-np.inf, heights[reach[:-1] % len(heights)])
    before[1:][slab[1:] != slab[:-1]] = -np.inf
    gain = np.maximum(0.0, y2[box] - np.maximum(y1[box], before))
    return np.bincount(home[slab], gain * (edge[slab + 1] - edge[slab]), n)


def _slab_areas(boxes: DataFrame, part: Sequence[str]) -> DataFrame:
    """Covered pieces (part, _a) of the distinct boxes, by joins of slabs and boxes."""
    cuts = boxes.select(*part, F.col("x1").alias("x")).union(boxes.select(*part, F.col("x2"))).distinct()
    slabs = cuts.withColumn("xe", F.lead("x").over(W.partitionBy(*part).orderBy("x"))).where("xe IS NOT NULL")
    strips = (
        slabs.alias("s")
        .join(boxes.alias("b"), part)
        .where("b.x1 <= s.x AND b.x2 >= s.xe")
        .groupBy(*part, "x", "xe", "y1").agg(F.max("y2").alias("y2"))
    )
    order = W.partitionBy(*part, "x").orderBy("y1")
    reach = F.max("y2").over(order.rowsBetween(W.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0.0), F.col("y2") - F.greatest("y1", F.coalesce("_reach", F.col("y1"))))
    return strips.withColumn("_reach", reach).select(*part, ((F.col("xe") - F.col("x")) * gain).alias("_a"))


def covered_share(candidates: DataFrame, cover: DataFrame, keys: Sequence[str], id_col: str, cell: float | None = None) -> DataFrame:
    """Share of every candidate box that the cover boxes take up."""
    a, b = box("a_"), box("b_")
    hits = cross_pairs(
        candidates, cover.select(*keys, "x1", "y1", "x2", "y2").distinct(), keys,
        lambda p, q: bx.intersection(box(p), box(q)) > 0, left_cols=[id_col],
    )
    clipped = hits.select(
        *keys, F.col(f"a_{id_col}").alias(id_col), F.greatest(a.x1, b.x1).alias("x1"), F.greatest(a.y1, b.y1).alias("y1"),
        F.least(a.x2, b.x2).alias("x2"), F.least(a.y2, b.y2).alias("y2"),
    )
    areas = union_area(clipped, [*keys, id_col], cell)
    share = F.when(box().area > 0, F.coalesce(F.col("covered"), F.lit(0.0)) / box().area).otherwise(0.0)
    return candidates.join(areas, [*keys, id_col], "left").withColumn("covered_share", share).drop("covered")


def content_coverage(content: DataFrame, elements: DataFrame, keys: Sequence[str], cell: float | None = None) -> DataFrame:
    """Content area, the part covered by elements, coverage and missing rate per group.

    The shared part follows from three unions: |A and B| = |A| + |B| - |A or B|.
    """
    keys = list(keys)
    xy = ("x1", "y1", "x2", "y2")
    a, b = content.select(*keys, *xy), elements.select(*keys, *xy)
    area = lambda d, n: union_area(d, keys, cell).withColumnRenamed("covered", n)
    out = area(a, "content_area").join(area(b, "_b"), keys, "left").join(area(a.unionByName(b), "_u"), keys, "left").fillna(0.0, ["_b", "_u"])
    out = out.withColumn("covered_area", F.col("content_area") + F.col("_b") - F.col("_u")).drop("_b", "_u")
    share = F.when(F.col("content_area") > 0, F.col("covered_area") / F.col("content_area") * 100).otherwise(100.0)
    return out.withColumn("pixel_coverage", share).withColumn("missing_rate", F.lit(100.0) - share)


def keep_candidates(
    candidates: DataFrame, existing: DataFrame, cover: DataFrame, content: DataFrame, keys: Sequence[str], id_col: str, max_iou: float = 0.5,
    max_covered: float = 0.7, min_missing: float = 0.05, cell: float | None = None,
) -> DataFrame:
    """Candidate regions that are new, mostly uncovered, and still hold missing content.

    Rows of channel 'complex' only face the IoU rule, at 0.8. ``content`` are boxes of uncovered content.
    """
    keys = list(keys)
    plain, special = candidates.where("channel <> 'complex'"), candidates.where("channel = 'complex'")
    # Every step reads its input several times, so each result is written before the next step.
    kept = cut(drop_existing(cut(plain), existing, keys, max_iou))
    kept = cut(covered_share(kept, cover, keys, id_col, cell).where(F.col("covered_share") <= max_covered).drop("covered_share"))
    kept = covered_share(kept, content, keys, id_col, cell).where(F.col("covered_share") >= min_missing).drop("covered_share")
    return kept.unionByName(drop_existing(special, existing, keys, 0.8))
