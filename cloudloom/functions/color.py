"""Colour expressions; channels are columns r, g, b in 0 to 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAY = (0.2989, 0.5870, 0.1140)


def in_ranges(boxes: list[tuple[tuple[float, ...], tuple[float, ...]]]) -> Column:
    """Whether the colour lies in any (lower, upper) box of 0 to 255, bounds included."""
    box = lambda low, high: reduce(Column.__and__, [(F.col(c) * 255).between(a, b) for c, a, b in zip("rgb", low, high, strict=True)])
    return reduce(Column.__or__, [box(*b) for b in boxes])


def filter_ranges(cloud: DataFrame, boxes: list, keep: bool = True) -> DataFrame:
    if not boxes:
        raise ValueError("at least one colour range is needed")
    return cloud.where(in_ranges(boxes) if keep else ~in_ranges(boxes))


def contrast(cloud: DataFrame, factor: float) -> DataFrame:
    """Channels moved away from (or to) 128 and clipped."""
    return cloud.withColumns({c: F.least(F.greatest((F.col(c) * 255 - 128) * factor + 128, F.lit(0.0)), F.lit(255.0)) / 255 for c in "rgb"})


def gray() -> Column:
    return F.col("r") * GRAY[0] + F.col("g") * GRAY[1] + F.col("b") * GRAY[2]


def grayscale(cloud: DataFrame) -> DataFrame:
    return cloud.withColumns({c: gray() for c in "rgb"})


def threshold(cloud: DataFrame, level: float) -> DataFrame:
    """Black where the first channel times 255 is under the level, else white."""
    value = F.when(F.col("r") * 255 < level, 0.0).otherwise(1.0)
    return cloud.withColumns({c: value for c in "rgb"})


def paint(cloud: DataFrame, color: tuple[float, float, float]) -> DataFrame:
    return cloud.withColumns({c: F.lit(float(v)) for c, v in zip("rgb", color, strict=True)})


def gamma(level: Column, exponent: float = 1 / 0.9) -> Column:
    """Gamma lookup of a level of 0 to 255, cut to a whole number."""
    return F.floor(F.pow(level / 255, F.lit(exponent)) * 255).cast("int")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 180), saturation and value (0 to 255) of whole-number channels of 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 30
    return F.when(turn < 0, turn + 180).otherwise(turn), F.when(top == 0, 0.0).otherwise(span * 255 / top), top


def is_red(r: Column, g: Column, b: Column) -> Column:
    h, s, v = hsv(r, g, b)
    return (h.between(0, 10) | h.between(168, 180)) & (s >= 70) & (v >= 50)


def paint_color(r: Column, g: Column, b: Column) -> Column:
    """The colour of a paint from its brightest cluster's mean: green where red and blue stay under 0.65 of green."""
    return F.when((r / g < 0.65) & (b / g < 0.65), "green").otherwise("white")


def detected_paint(cloud: DataFrame, by: str) -> DataFrame:
    """(by, paint): the paint that the mean colour of each group is taken for."""
    return cloud.groupBy(by).agg(*[F.avg(c).alias(c) for c in "rgb"]).select(by, paint_color(F.col("r"), F.col("g"), F.col("b")).alias("paint"))


def not_black(cloud: DataFrame) -> DataFrame:
    return cloud.where("r <> 0 OR g <> 0 OR b <> 0")
