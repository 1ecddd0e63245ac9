"""Masks as uncompressed column-major run lengths, starting with a run of zeros.

Set operations and bounds work on the ends of runs, not on pixels. A value that a lambda needs for every
element is bound once by ``_let``: a Column used inside a lambda is evaluated anew for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _runs(changes: Column, n: Column) -> Column:
    """Run lengths from the places where the value changes and the number of pixels."""
    return F.zip_with(F.concat(changes, F.array(n)), F.concat(F.array(F.lit(0)), changes), lambda e, s: e - s)


def _ends(counts: Column) -> Column:
    """Where each run ends."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    step = lambda a, c: _let((a["at"] + c).cast("int"), lambda e: F.struct(e.alias("at"), F.concat(a["ends"], F.array(e)).alias("ends")))
    return F.aggregate(counts, start, step, lambda a: a["ends"])


def encode(bits: Column) -> Column:
    """Array of 0/1 in column-major order to run lengths."""

    def runs(b):
        before = F.concat(F.array(F.lit(0)), b)
        changed = F.zip_with(b, F.slice(before, F.lit(1), F.size(b)), lambda v, p: v != p)
        places = F.filter(F.transform(changed, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
        return _runs(places, F.size(b))

    return _let(bits, runs)


def decode(counts: Column) -> Column:
    return F.flatten(F.transform(counts, lambda c, i: F.array_repeat((i % 2).cast("int"), c)))


def area(counts: Column) -> Column:
    """Sum of the runs of ones."""
    ones = F.filter(counts, lambda _, i: i % 2 == 1)
    return F.aggregate(ones, F.lit(0), lambda s, c: s + c)


def combine(a: Column, b: Column, how: str) -> Column:
    """Intersection or union of two masks of one size."""
    both = F.least if how == "intersection" else F.greatest
    # The run of a pixel is odd if it holds ones; its number is how many runs end before.
    inside = lambda ends, mark: F.size(F.filter(ends, lambda e: e < mark)) % 2

    def joined(e):
        return _let(F.filter(F.array_sort(F.array_distinct(F.concat(e["a"], e["b"]))), lambda m: m > 0), lambda marks: changes(e, marks))

    def changes(e, marks):
        pieces = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0)))), marks, lambda s, m: F.struct(s.alias("s"), both(inside(e["a"], m), inside(e["b"], m)).alias("v")))
        return _let(pieces, lambda p: _runs(turning(p), F.coalesce(F.array_max(marks), F.lit(0))))

    def turning(pieces):
        before = F.concat(F.array(F.lit(0)), F.transform(pieces, lambda p: p["v"]))
        turned = F.zip_with(pieces, F.slice(before, F.lit(1), F.size(pieces)), lambda p, v: F.when(p["v"] != v, p["s"]))
        return F.filter(turned, lambda s: s.isNotNull())

    return _let(F.struct(_ends(a).alias("a"), _ends(b).alias("b")), joined)


def bounds(counts: Column, height: int, width: int) -> Column:
    """struct(x1, y1, x2, y2) of the set pixels, both ends included; (width, height, 0, 0) when empty."""

    def box(ends):
        first = F.concat(F.array(F.lit(0)), ends)
        runs = F.filter(F.zip_with(F.slice(first, F.lit(1), F.size(ends)), F.transform(ends, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda s, r: F.struct(s.alias("s"), (r["e"] - 1).alias("e"), r["i"].alias("i"))), lambda r: (r["i"] % 2 == 1) & (r["e"] >= r["s"]))
        return _let(runs, corners)

    def corners(runs):
        column = lambda p: F.floor(p / height).cast("int")
        one = lambda r: column(r["s"]) == column(r["e"])
        low = F.transform(runs, lambda r: F.when(one(r), r["s"] % height).otherwise(0))
        high = F.transform(runs, lambda r: F.when(one(r), r["e"] % height).otherwise(height - 1))
        return F.struct(
            F.coalesce(F.array_min(F.transform(runs, lambda r: column(r["s"]))), F.lit(width)).alias("x1"), F.coalesce(F.array_min(low), F.lit(height)).alias("y1"),
            F.coalesce(F.array_max(F.transform(runs, lambda r: column(r["e"]))), F.lit(0)).alias("x2"), F.coalesce(F.array_max(high), F.lit(0)).alias("y2"),
        )

    return _let(_ends(counts), box)
