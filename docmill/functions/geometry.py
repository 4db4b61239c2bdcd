"""Boxes: structs of x1, y1, x2, y2 in parts of the page, the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(x, F.lit(hi)))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def polygon_box(polygon: Column, width: Column, height: Column) -> Column:
    """The clamped box around the points of a polygon in pixels; null without points or page size."""
    xs, ys = F.transform(polygon, lambda p: p[0].cast("double")), F.transform(polygon, lambda p: p[1].cast("double"))
    some = (F.size(polygon) > 0) & (width > 0) & (height > 0)
    w, h = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    return F.when(some, box(clamp(F.array_min(xs) / w), clamp(F.array_min(ys) / h), clamp(F.array_max(xs) / w), clamp(F.array_max(ys) / h)))


def from_bottom_left(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box given by its bottom left corner and size, the origin at the bottom left."""
    return box(clamp(x), clamp(F.lit(1.0) - (y + h)), clamp(x + w), clamp(F.lit(1.0) - y))


def track(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Coordinates over 1 are pixels, unless one is negative; then corners in order, clamped; a box without area is all zeros."""
    pixels = (F.greatest(x1, y1, x2, y2) > 1) & (F.least(x1, y1, x2, y2) >= 0)
    def scale(v: Column, size: Column) -> Column:
        return F.when(pixels & (v > 1), v / size).otherwise(v)

    a, b, c, d = scale(x1, width), scale(y1, height), scale(x2, width), scale(y2, height)
    lx, ly, hx, hy = clamp(F.least(a, c)), clamp(F.least(b, d)), clamp(F.greatest(a, c)), clamp(F.greatest(b, d))
    good = (hx > lx) & (hy > ly)
    zero = F.lit(0.0)
    return box(F.when(good, lx).otherwise(zero), F.when(good, ly).otherwise(zero), F.when(good, hx).otherwise(zero), F.when(good, hy).otherwise(zero))


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Corners in whole pixels, halves to even."""
    return F.struct(*[F.bround(b[k] * s).cast("int").alias(k) for k, s in (("x1", width), ("y1", height), ("x2", width), ("y2", height))])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def is_valid(b: Column) -> Column:
    """In order and within the page."""
    return F.coalesce((b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= 1) & (b["y2"] <= 1) & (b["x1"] < b["x2"]) & (b["y1"] < b["y2"]), F.lit(False))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without a union."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def same_row(a: Column, b: Column, tolerance: float = 0.020) -> Column:
    """Centres at most the tolerance apart, or the centre of ``a`` within the height of ``b``."""
    ca, cb = centre_y(a), centre_y(b)
    return (F.abs(ca - cb) <= tolerance) | ca.between(b["y1"], b["y2"])


def css_box(b: Column) -> Column:
    """left, top, width, height in percent; what would leave the page is cut."""
    left, top = clamp(b["x1"] * 100, 0, 100), clamp(b["y1"] * 100, 0, 100)

    def size(d: Column, start: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(d * 100, F.lit(100.0) - start))

    return F.struct(left.alias("left"), top.alias("top"), size(width(b), left).alias("width"), size(height(b), top).alias("height"))
