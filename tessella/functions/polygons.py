"""Quads, polygons and rotated rectangles (arrays of struct<x,y>) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessella.functions.boxes import Box


def point(p: Column, i: int) -> tuple[Column, Column]:
    q = F.get(p, F.lit(i))
    return q["x"], q["y"]


def hull(p: Column) -> Box:
    """Bounding box of a point array."""
    return _bounds(p["x"], p["y"])


def _bounds(xs: Column, ys: Column) -> Box:
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def rectangle(b: Box) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((b.x1, b.y1), (b.x2, b.y1), (b.x2, b.y2), (b.x1, b.y2))])


def merge_to_rectangle(p: Column, q: Column) -> Column:
    return rectangle(_bounds(F.concat(p["x"], q["x"]), F.concat(p["y"], q["y"])))


def shoelace(p: Column) -> Column:
    """Area of a simple polygon; four points, the usual case, are added up without functions of arrays, which Spark does not compile."""
    xs, ys = ([F.get(p[c], F.lit(i)) for i in (0, 1, 2, 3, 0)] for c in "xy")
    four = F.lit(0.0)
    for i in range(4):
        four = four + (xs[i] * ys[i + 1] - ys[i] * xs[i + 1])
    rolled = F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1))
    cross = F.zip_with(p, rolled, lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])
    total = F.when(F.size(p) == 4, four).otherwise(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v))
    return F.abs(total) / 2


def quad_from_flat(flat: Column) -> Column:
    """Eight numbers as four points; missing numbers give missing points filled with 0."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.struct(
            F.coalesce(F.get(flat, i * 2), F.lit(0.0)).alias("x"), F.coalesce(F.get(flat, i * 2 + 1), F.lit(0.0)).alias("y")
        ),
    )


def edge_length(p: Column, i: int, j: int) -> Column:
    (ax, ay), (bx, by) = point(p, i), point(p, j)
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def quad_geometry(p: Column, scale: Column) -> dict[str, Column]:
    """Position, size, baseline and rotation of an oriented quad after uniform scaling."""
    pts = [tuple(c * scale for c in point(p, i)) for i in range(4)]
    dx, dy = pts[1][0] - pts[0][0], pts[1][1] - pts[0][1]
    angle = F.degrees(F.atan2(dy, dx))
    rotation = (
        F.when(dx == 0, F.when(dy > 0, 90.0).otherwise(-90.0)).when(F.abs(angle) < 2, 0.0).otherwise(F.bround(angle, 1))
    )
    width = edge_length(p, 0, 1) * scale
    height = edge_length(p, 0, 3) * scale
    cx = (pts[0][0] + pts[1][0] + pts[2][0] + pts[3][0]) / 4
    cy = (pts[0][1] + pts[1][1] + pts[2][1] + pts[3][1]) / 4
    return {
        "x": F.bround(cx - width / 2, 2),
        "y": F.bround(cy - height / 2, 2),
        "width": F.bround(width, 2),
        "height": F.bround(height, 2),
        "baseline_y": F.bround((pts[2][1] + pts[3][1]) / 2, 2),
        "rotation": rotation,
    }


def uniform_scale(src_w, src_h, dst_w, dst_h) -> Column:
    return F.least(dst_w / src_w, dst_h / src_h)


def estimated_font_size(p: Column) -> Column:
    """Shorter of the first two edges of a quad; 12 when there is no quad or it is degenerate."""
    a, b = edge_length(p, 0, 1), edge_length(p, 1, 2)
    return F.when((F.size(p) < 4) | (F.least(a, b) <= 0), F.lit(12.0)).otherwise(F.least(a, b))


# --- P15 affine transforms --------------------------------------------------
def affine(x, y, *, rotation=None, scale_x=None, scale_y=None, flip_h=None, flip_v=None, dx=None, dy=None, origin_x=None, origin_y=None):
    """Flip, scale, rotate (degrees) about an origin, then translate a point."""
    zero, one, no = F.lit(0.0), F.lit(1.0), F.lit(False)
    ox, oy = (zero if v is None else v for v in (origin_x, origin_y))
    px, py = x - ox, y - oy
    px = F.when(no if flip_h is None else flip_h, -px).otherwise(px) * (one if scale_x is None else scale_x)
    py = F.when(no if flip_v is None else flip_v, -py).otherwise(py) * (one if scale_y is None else scale_y)
    if rotation is not None:
        c, s = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
        px, py = px * c - py * s, px * s + py * c
    return px + ox + (zero if dx is None else dx), py + oy + (zero if dy is None else dy)


def rotated_rect_bounds(x, y, w, h, rotation) -> tuple[Column, Column, Column, Column]:
    """Bounds (x, y, width, height) of a rectangle turned about its centre."""
    cx, cy = x + w / 2, y + h / 2
    corners = [
        affine(px, py, rotation=rotation, origin_x=cx, origin_y=cy) for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    ]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)
