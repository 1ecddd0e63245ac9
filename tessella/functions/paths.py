"""Polylines: one array<struct<x,y>> value per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _xy(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _dist(a, b) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def step_lengths(p: Column) -> Column:
    """Length of every segment of a path."""
    head = F.slice(p, 1, F.size(p) - 1)
    tail = F.slice(p, 2, F.size(p) - 1)
    return F.when(
        F.size(p) >= 2,
        F.zip_with(
            head, tail, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
        ),
    ).otherwise(F.array().cast("array<double>"))


def length(p: Column) -> Column:
    return F.aggregate(step_lengths(p), F.lit(0.0), lambda s, v: s + v)


def segments(p: Column) -> Column:
    """Consecutive point pairs as array<struct<x1,y1,x2,y2>>."""
    return F.when(
        F.size(p) >= 2,
        F.zip_with(
            F.slice(p, 1, F.size(p) - 1),
            F.slice(p, 2, F.size(p) - 1),
            lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
        ),
    )


def far_points(p: Column, min_dist: float = 1.0) -> Column:
    """The start, interior points at least ``min_dist`` from the point kept before, and the end where it is not the last of these.

    A path that stays near its start and ends on it has one such point.
    """
    far = F.aggregate(
        F.slice(p, 2, F.size(p) - 2),
        F.slice(p, 1, 1),
        lambda acc, q: F.when(_dist(F.element_at(acc, -1), q) >= min_dist, F.concat(acc, F.array(q))).otherwise(acc),
    )

    def close(kept):
        end, last = F.element_at(p, -1), F.element_at(kept, -1)
        return F.when((last["x"] != end["x"]) | (last["y"] != end["y"]), F.concat(kept, F.array(end))).otherwise(kept)

    return F.when(F.size(p) < 3, p).otherwise(let(far, close))


def drop_near_points(p: Column, min_dist: float = 1.0) -> Column:
    """Remove interior points closer than ``min_dist`` to the point kept before; ends stay, and a path that would be one point stays whole."""
    return let(far_points(p, min_dist), lambda c: F.when(F.size(c) >= 2, c).otherwise(p))


def snap_angles(p: Column, tolerance: float = 8.0, last_tolerance: float = 15.0) -> Column:
    """Turn segments to the nearest multiple of 45 degrees when they are within tolerance.

    Each segment starts at the point emitted before it; snapped points are cut to integers.
    """
    numbered = F.transform(p, lambda q, i: F.struct(q["x"].alias("x"), q["y"].alias("y"), i.alias("i")))

    def step(acc, q):
        def measured(prev):
            dx, dy = q["x"] - prev["x"], q["y"] - prev["y"]
            return F.struct(
                prev["x"].alias("x"), prev["y"].alias("y"), dx.alias("dx"), dy.alias("dy"),
                F.sqrt(dx * dx + dy * dy).alias("size"), F.degrees(F.atan2(dy, dx)).alias("angle"),
            )

        def moved(m):
            near = F.round(m["angle"] / 45) * 45
            limit = F.when(q["i"] == F.size(p) - 1, last_tolerance).otherwise(tolerance)
            snapped = _xy(
                (m["x"] + m["size"] * F.cos(F.radians(near))).cast("bigint").cast("double"),
                (m["y"] + m["size"] * F.sin(F.radians(near))).cast("bigint").cast("double"),
            )
            return F.when((F.abs(m["dx"]) < 0.001) & (F.abs(m["dy"]) < 0.001), acc).otherwise(
                F.concat(acc, F.array(F.when(F.abs(m["angle"] - near) <= limit, snapped).otherwise(_xy(q["x"], q["y"]))))
            )

        return let(let(F.element_at(acc, -1), measured), moved)

    return F.when(F.size(p) < 2, p).otherwise(F.aggregate(F.slice(numbered, 2, F.size(p)), F.slice(p, 1, 1), step))


def point_at(p: Column, share: Column) -> Column:
    """struct(x, y, dx, dy): position at ``share`` (0..1) of the length and the segment it lies on."""
    steps = step_lengths(p)
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0).alias("i"), F.lit(-1).alias("hit"), F.lit(0.0).alias("t"))

    def locate(ctx):
        target = ctx["total"] * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))

        def step(s, v):
            here = (s["hit"] < 0) & (s["done"] + v >= target)
            return F.struct(
                (s["done"] + v).alias("done"),
                (s["i"] + 1).alias("i"),
                F.when(here, s["i"]).otherwise(s["hit"]).alias("hit"),
                F.when(here, (target - s["done"]) / F.greatest(v, F.lit(1e-6))).otherwise(s["t"]).alias("t"),
            )

        return F.struct(ctx["total"].alias("total"), F.aggregate(ctx["steps"], start, step).alias("s"))

    def place(r):
        i = F.greatest(r["s"]["hit"], F.lit(0))

        def along(seg):
            dx, dy = seg["b"]["x"] - seg["a"]["x"], seg["b"]["y"] - seg["a"]["y"]
            first, end = F.get(p, F.lit(0)), F.element_at(p, -1)
            flat = r["total"] <= 1e-6
            return F.struct(
                F.when(flat, (first["x"] + end["x"]) / 2).otherwise(seg["a"]["x"] + dx * r["s"]["t"]).alias("x"),
                F.when(flat, (first["y"] + end["y"]) / 2).otherwise(seg["a"]["y"] + dy * r["s"]["t"]).alias("y"),
                F.when(flat, end["x"] - first["x"]).otherwise(dx).alias("dx"),
                F.when(flat, end["y"] - first["y"]).otherwise(dy).alias("dy"),
            )

        return let(F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b")), along)

    total = let(steps, lambda s: F.struct(s.alias("steps"), F.aggregate(s, F.lit(0.0), lambda t, v: t + v).alias("total")))
    return let(let(total, locate), place)


def label_position(p: Column, share: Column, offset: Column, orthogonal: Column) -> Column:
    """Label anchor: the point at ``share``, moved by ``offset`` along the segment's normal."""

    def moved(at):
        size = F.sqrt(at["dx"] * at["dx"] + at["dy"] * at["dy"])
        flat = F.abs(at["dx"]) >= F.abs(at["dy"])
        axis = orthogonal & (F.abs(at["dx"]) + F.abs(at["dy"]) > 1e-6)
        nx = F.when(axis, F.when(flat, 0.0).otherwise(1.0)).when(size <= 1e-6, 0.0).otherwise(-at["dy"] / size)
        ny = F.when(axis, F.when(flat, -1.0).otherwise(0.0)).when(size <= 1e-6, 1.0).otherwise(at["dx"] / size)
        return _xy(at["x"] + nx * offset, at["y"] + ny * offset)

    return let(point_at(p, share), moved)


def trim_start(p: Column, distance: float) -> Column:
    """Cut ``distance`` off the start; the last segment left is shortened by at most 90 %."""

    def trimmed(q):
        n = F.size(q) - 1
        start = F.struct(F.lit(float(distance)).alias("rest"), F.lit(0).alias("cut"), F.lit(False).alias("done"))

        def step(s, v):
            free = ~s["done"] & (s["rest"] > 1e-6) & (s["cut"] < n - 1)
            skip = free & ((v < 1e-6) | (v <= s["rest"]))
            return F.struct(
                F.when(skip & (v >= 1e-6), s["rest"] - v).otherwise(s["rest"]).alias("rest"),
                F.when(skip, s["cut"] + 1).otherwise(s["cut"]).alias("cut"),
                (~skip).alias("done"),
            )

        def shortened(s):
            a, b = F.get(q, s["cut"]), F.get(q, s["cut"] + 1)
            t = F.when((s["rest"] > 1e-6) & (_dist(a, b) >= 1e-6), F.least(s["rest"] / _dist(a, b), F.lit(0.9))).otherwise(0.0)
            head = _xy(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)
            return F.concat(F.array(head), F.slice(q, s["cut"] + 2, F.size(q)))

        return F.when(F.size(q) < 2, q).otherwise(let(F.aggregate(step_lengths(q), start, step), shortened))

    return let(p, trimmed)


def trim_ends(p: Column, start: float, end: float) -> Column:
    return F.reverse(trim_start(F.reverse(trim_start(p, start)), end))
