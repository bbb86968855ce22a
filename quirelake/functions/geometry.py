"""Column functions over boxes [x0, y0, x1, y1]; a null box or one of another length gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def at(box: Column, i: int) -> Column:
    return F.when(F.size(box) == 4, F.get(box, F.lit(i)))


def width(box: Column) -> Column:
    return F.greatest(at(box, 2) - at(box, 0), F.lit(0.0))


def height(box: Column) -> Column:
    return F.greatest(at(box, 3) - at(box, 1), F.lit(0.0))


def area(box: Column) -> Column:
    """Negative extents count as 0."""
    return width(box) * height(box)


def union(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 4) & (F.size(b) == 4), F.array(F.least(at(a, 0), at(b, 0)), F.least(at(a, 1), at(b, 1)), F.greatest(at(a, 2), at(b, 2)), F.greatest(at(a, 3), at(b, 3))))


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)), F.lit(0.0))
    h = F.greatest(F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)), F.lit(0.0))
    return w * h


def covered(a: Column, b: Column) -> Column:
    """Share of a's area that b covers; 0 for an empty a."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def x_overlap(a: Column, b: Column) -> Column:
    """Common width over the smaller width; 0 where there is none."""
    common = F.greatest(F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)), F.lit(0.0))
    least = F.least(width(a), width(b))
    return F.when(least > 0, common / least).otherwise(0.0)


def to_thousand(box: Column, page_width: Column, page_height: Column) -> Column:
    """A box on a scale of 0 to 1000, clipped."""
    def scaled(i: int, full: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(at(box, i) * 1000 / full))).cast("int")

    return F.when((F.size(box) == 4) & (page_width > 0) & (page_height > 0), F.array(scaled(0, page_width), scaled(1, page_height), scaled(2, page_width), scaled(3, page_height)))


def clip(box: Column, page_width: Column, page_height: Column) -> Column:
    def kept(i: int, full: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(at(box, i), full))

    return F.when(F.size(box) == 4, F.array(kept(0, page_width), kept(1, page_height), kept(2, page_width), kept(3, page_height)))


def shift(box: Column, dx: Column, dy: Column) -> Column:
    return F.when(F.size(box) == 4, F.array(at(box, 0) + dx, at(box, 1) + dy, at(box, 2) + dx, at(box, 3) + dy))


def pad(box: Column, by: float, page_width: Column, page_height: Column) -> Column:
    wide = F.array(at(box, 0) - by, at(box, 1) - by, at(box, 2) + by, at(box, 3) + by)
    return F.when(F.size(box) == 4, clip(wide, page_width, page_height))


def scale(box: Column, factor: Column) -> Column:
    """Page units to pixels."""
    return F.when(F.size(box) == 4, F.transform(box, lambda x: x * factor))


def flip(box: Column, page_height: Column) -> Column:
    """From an origin at the bottom left to one at the top left."""
    return F.when(F.size(box) == 4, F.array(at(box, 0), page_height - at(box, 3), at(box, 2), page_height - at(box, 1)))


def polygon_box(points: Column) -> Column:
    """The box around points [[x, y], ...]; null for none."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
