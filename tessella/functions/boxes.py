"""Box algebra as Column expressions over flat DOUBLE columns (xyxy unless said otherwise)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height


def box(prefix: str = "", alias: str | None = None) -> Box:
    """Box over the columns ``<prefix>x1 .. <prefix>y2`` of an optional alias."""
    dot = f"{alias}." if alias else ""
    return Box(*(F.col(f"{dot}{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def box_from_array(a: Column) -> Box:
    return Box(*(F.get(a, F.lit(i)) for i in range(4)))


# --- P01 format conversions -------------------------------------------------
def xywh_to_xyxy(x, y, w, h) -> Box:
    return Box(x, y, x + w, y + h)


def cxcywh_to_xyxy(cx, cy, w, h) -> Box:
    return Box(cx - F.lit(0.5) * w, cy - F.lit(0.5) * h, cx + F.lit(0.5) * w, cy + F.lit(0.5) * h)


def xyxy_to_xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.width, b.height


def xyxy_to_cxcywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.width, b.height


def by_mode(mode: Column, a, b, c, d) -> Box:
    """Read four numbers as a box according to a mode tag column."""
    options = {
        "xyxy": Box(a, b, c, d),
        "xywh": xywh_to_xyxy(a, b, c, d),
        "cxcywh": cxcywh_to_xyxy(a, b, c, d),
    }

    def pick(i: int) -> Column:
        out = F.lit(None).cast("double")
        for tag, bx in options.items():
            out = F.when(mode == tag, bx[i]).otherwise(out)
        return out

    return Box(*(pick(i) for i in range(4)))


# --- P02 / P03 --------------------------------------------------------------
def center_int(b: Box) -> tuple[Column, Column]:
    """Centre with floor division, as integers."""
    return F.floor((b.x1 + b.x2) / 2), F.floor((b.y1 + b.y2) / 2)


def clip(b: Box, width, height) -> Box:
    def inside(c, hi):
        return F.least(F.greatest(c, F.lit(0.0)), hi)

    return Box(inside(b.x1, width), inside(b.y1, height), inside(b.x2, width), inside(b.y2, height))


def scale(b: Box, sx, sy) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def nonempty(b: Box, threshold: float = 0.0) -> Column:
    return (b.width > threshold) & (b.height > threshold)


def inside_image(b: Box, width, height, margin: float = 0.0) -> Column:
    return (
        (b.x1 >= -margin) & (b.y1 >= -margin) & (b.x2 < width + margin) & (b.y2 < height + margin)
    )


# --- P04 .. P09 -------------------------------------------------------------
def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union_area(a: Box, b: Box) -> Column:
    return a.area + b.area - intersection(a, b)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    return _ratio(intersection(a, b), union_area(a, b))


def generalized_iou(a: Box, b: Box) -> Column:
    hull = (F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1)) * (F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1))
    return iou(a, b) - _ratio(hull - union_area(a, b), hull)


def containment(outer: Box, inner: Box) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return _ratio(intersection(outer, inner), inner.area)


def over_min(a: Box, b: Box) -> Column:
    return _ratio(intersection(a, b), F.least(a.area, b.area))


def distance_similarity(ax, ay, bx, by, zero_distance: float = 2.0) -> Column:
    d = F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2)))
    return F.greatest(F.lit(0.0), F.lit(1.0) - d / F.lit(float(zero_distance)))


def point_edges(px, py, b: Box) -> tuple[Column, Column, Column, Column]:
    """Signed distances of a point to the left, top, right and bottom edge."""
    return px - b.x1, py - b.y1, b.x2 - px, b.y2 - py


def relationship(a: Box, b: Box) -> Column:
    def covers(o: Box, i: Box):
        return (o.x1 <= i.x1) & (o.y1 <= i.y1) & (o.x2 >= i.x2) & (o.y2 >= i.y2)

    def centre_strictly_in(i: Box, o: Box):
        cx, cy = center_int(i)
        return (o.x1 < cx) & (cx < o.x2) & (o.y1 < cy) & (cy < o.y2)

    return (
        F.when(covers(a, b), "contains")
        .when(covers(b, a), "contained")
        .when(centre_strictly_in(a, b) | centre_strictly_in(b, a), "stacked")
        .otherwise("overlaps")
    )


def gap(a: Box, b: Box) -> Column:
    """Chebyshev gap between two boxes, 0 when they meet."""
    dx = F.greatest(b.x1 - a.x2, a.x1 - b.x2, F.lit(0.0))
    dy = F.greatest(b.y1 - a.y2, a.y1 - b.y2, F.lit(0.0))
    return F.greatest(dx, dy)


# --- P19 .. P23 -------------------------------------------------------------
def normalize(b: Box, width, height) -> Box:
    return Box(b.x1 / width, b.y1 / height, b.x2 / width, b.y2 / height)


def denormalize_clamped(b: Box, width, height) -> Box:
    return clip(Box(b.x1 * width, b.y1 * height, b.x2 * width, b.y2 * height), width, height)


def crop(b: Box, left, top, width, height) -> Box:
    """Box after cropping the picture to (left, top, width, height)."""
    return clip(Box(b.x1 - left, b.y1 - top, b.x2 - left, b.y2 - top), width, height)


def hflip(b: Box, width) -> Box:
    return Box(width - b.x2, b.y1, width - b.x1, b.y2)


def pad(b: Box, left, top) -> Box:
    return Box(b.x1 + left, b.y1 + top, b.x2 + left, b.y2 + top)


def rescale_about_center(b: Box, factor, width, height) -> Box:
    cx, cy = (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2
    hw, hh = b.width * factor / 2, b.height * factor / 2
    return clip(Box(cx - hw, cy - hh, cx + hw, cy + hh), width, height)


def expand(b: Box, margin, width, height) -> Box:
    return Box(
        F.greatest(F.lit(0.0), b.x1 - margin),
        F.greatest(F.lit(0.0), b.y1 - margin),
        F.least(width, b.x2 + margin),
        F.least(height, b.y2 + margin),
    )


def jitter(b: Box, noise: tuple[Column, Column, Column, Column], width, height, min_area=0.0) -> Box:
    """Shift the four sides by ``noise``, clamp, and fall back to ``b`` when the area gets too small."""
    moved = clip(Box(*(c + n for c, n in zip(b, noise))), width, height)
    ok = (moved.width > 0) & (moved.height > 0) & (moved.area > min_area)
    return Box(*(F.when(ok, m).otherwise(c) for m, c in zip(moved, b)))


def hash_normal(seed: int, *cols: Column) -> Column:
    """Standard normal draw from a hash of the row (repeatable on retries, unlike ``randn``)."""
    return F.sqrt(F.lit(-2.0) * F.log(hash_uniform(seed, *cols))) * F.cos(
        F.lit(2.0) * F.pi() * hash_uniform(seed + 1, *cols)
    )


def hash_uniform(seed: int, *cols: Column) -> Column:
    """Uniform draw in (0, 1) from a hash of the row."""
    h = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52))
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
