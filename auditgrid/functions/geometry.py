"""Boxes as expressions: structs of y0, x0, y1, x1 in [0, 1], or of pixels in x, y order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<y0:double,x0:double,y1:double,x1:double>"
PIXELS = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
AXES = ("y0", "x0", "y1", "x1")


def box(y0: Column, x0: Column, y1: Column, x1: Column) -> Column:
    """A box, or null if any of its sides is null."""
    parts = [c.cast("double").alias(n) for n, c in zip(AXES, (y0, x0, y1, x1), strict=True)]
    missing = y0.isNull() | x0.isNull() | y1.isNull() | x1.isNull()
    return F.when(~missing, F.struct(*parts))


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _checked(size: Column) -> Column:
    return F.when(size > 0, size.cast("double")).otherwise(F.raise_error(F.lit("image dimensions must be positive")).cast("double"))


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """(x_min, y_min, x_max, y_max) in pixels of a normalised box; null stays null."""
    w, h = _checked(width), _checked(height)
    return F.when(b.isNotNull(), F.struct((b["x0"] * w).alias("x_min"), (b["y0"] * h).alias("y_min"), (b["x1"] * w).alias("x_max"), (b["y1"] * h).alias("y_max")))


def from_pixels(x_min: Column, y_min: Column, x_max: Column, y_max: Column, width: Column, height: Column) -> Column:
    """A normalised box of pixel corners, clamped to the image; null without dimensions."""
    known = width.isNotNull() & height.isNotNull()
    w, h = _checked(width), _checked(height)
    return F.when(known, box(clamped(y_min / h), clamped(x_min / w), clamped(y_max / h), clamped(x_max / w)))


def from_corner_and_size(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return from_pixels(x, y, x + w, y + h, width, height)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap or where an area is 0."""
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    inter = high * wide
    area = lambda c: (c["y1"] - c["y0"]) * (c["x1"] - c["x0"])
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def rectangles_overlap(a: Column, b: Column) -> Column:
    """Whether two pixel rectangles share more than an edge."""
    return (a["x_min"] < b["x_max"]) & (b["x_min"] < a["x_max"]) & (a["y_min"] < b["y_max"]) & (b["y_min"] < a["y_max"])


def valid_box(values: Column) -> Column:
    """A box from an array of four numbers in [0, 1] in order, else null."""
    at = lambda i: F.try_element_at(values, F.lit(i + 1))
    inside = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0))
    ok = (F.size(values) == 4) & inside & (at(0) <= at(2)) & (at(1) <= at(3))
    return F.when(ok, box(at(0), at(1), at(2), at(3)))


def as_list(b: Column) -> Column:
    """[y0, x0, y1, x1], for JSON."""
    return F.when(b.isNotNull(), F.array(*[b[n] for n in AXES]))
