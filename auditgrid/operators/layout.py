"""Where an overlay's parts go on its canvas: sizes, fonts, colours and label bands, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import PIXELS, rectangles_overlap

# The canvas, the font and the colours of an overlay.
LONG_SIDE = 1280
FONT_SIZES = (14, 28)
FONT_SHARE = 48
NUDGES = 8
COLORS = {"supported": (46, 204, 113), "missing": (243, 156, 18), "unsupported": (231, 76, 60), "urgent": (231, 76, 60)}


def canvas_side(side: Column, width: Column, height: Column) -> Column:
    """A side of an image's canvas: its own, or scaled so that the longer one is LONG_SIDE; 1 at least."""
    longest = F.greatest(width, height)
    scaled = F.greatest(F.lit(1), F.bround(side * (F.lit(float(LONG_SIDE)) / longest)).cast("int"))
    return F.when(longest > LONG_SIDE, scaled).otherwise(side.cast("int"))


def font_size(width: Column, height: Column) -> Column:
    """A share of the longer side, halves rounded to even, within FONT_SIZES."""
    size = F.bround(F.greatest(width, height).cast("double") / FONT_SHARE).cast("int")
    return F.greatest(F.lit(FONT_SIZES[0]), F.least(F.lit(FONT_SIZES[1]), size))


def category_color(category: Column) -> Column:
    """(red, green, blue) of a category; others have the alert's."""
    rgb = lambda c: F.struct(*[F.lit(v).alias(n) for n, v in zip(("red", "green", "blue"), c, strict=True)])
    out = rgb(COLORS["urgent"])
    for name in ("missing", "supported"):
        out = F.when(category == name, rgb(COLORS[name])).otherwise(out)
    return out


def wanted_band(box: Column, text_width: Column, text_height: Column, width: Column, height: Column) -> Column:
    """The rectangle of a label above its box, or under its top where there is no room; on the canvas."""
    number = lambda c: c.cast("double")
    pad = F.greatest(F.lit(2), F.floor(text_height / 4))
    high, wide = number(text_height + 2 * pad), number(text_width + 2 * pad)
    top = F.when(box["y_min"] < high, box["y_min"]).otherwise(box["y_min"] - high)
    top = F.greatest(F.lit(0.0), F.least(top, number(height) - high))
    left = F.when(box["x_min"] + wide > number(width), F.greatest(F.lit(0.0), number(width) - wide)).otherwise(box["x_min"])
    return F.struct(left.alias("x_min"), top.alias("y_min"), (left + wide).alias("x_max"), (top + high).alias("y_max"))


def _candidates(x: Column, height: Column) -> Column:
    """The places of a band in the order of trying: wanted, under its box, further down, further up."""
    band, tall = x["band"], x["band"]["y_max"] - x["band"]["y_min"]
    lowest = F.greatest(F.lit(0.0), height - tall)
    under = F.least(x["box"]["y_max"], lowest)
    down = [F.least(under + n * tall, lowest) for n in range(1, NUDGES + 1)]
    up = [F.greatest(F.lit(0.0), band["y_min"] - n * tall) for n in range(1, NUDGES + 1)]
    place = lambda top: F.struct(band["x_min"].alias("x_min"), top.alias("y_min"), band["x_max"].alias("x_max"), (top + tall).alias("y_max"))
    return F.transform(F.array(band["y_min"], under, *down, *up), place)


def placed_bands(bands: DataFrame, height: str = "height", id_col: str = "image_id") -> DataFrame:
    """id, region, band: each label's band, clear of those placed before it where that can be.

    ``bands``: id, region (the order of drawing), band and box in pixels, height of the
    canvas.  A band keeps its left and right; of its candidates the first that overlaps no
    placed band is taken, else the last.  A fold over an image's regions.
    """
    lists = bands.groupBy(id_col).agg(F.max(F.col(height).cast("double")).alias("_height"), F.array_sort(F.collect_list(F.struct("region", "band", "box"))).alias("_items"))

    def step(placed: Column, x: Column) -> Column:
        tries = _candidates(x, F.col("_height"))
        clear = F.filter(tries, lambda c: ~F.exists(placed, lambda p: rectangles_overlap(c, p)))
        return F.array_append(placed, F.coalesce(F.get(clear, F.lit(0)), F.element_at(tries, -1)))

    fold = F.aggregate("_items", F.array().cast(f"array<{PIXELS}>"), step)
    pairs = F.explode(F.arrays_zip(F.transform("_items", lambda x: x["region"]).alias("region"), fold.alias("band")))
    return lists.select(id_col, pairs.alias("p")).select(id_col, F.col("p.region").alias("region"), F.col("p.band").alias("band"))
