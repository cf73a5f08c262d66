"""Local contrast of coloured pixel tables: histogram equalisation by tiles with a clipped histogram (CLAHE) on lightness, then gamma.

Tiles' histograms are aggregates, their maps cumulated counts, and each pixel is blended from the maps of the four tiles around it, which it meets in an equi-join: no image
is ever held by one task. Many images (segment_id) go through at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.color import gamma

#: Grid of tiles, clip limit, and the white point of CIE Lab under D65.
TILES, CLIP, WHITE_X, WHITE_Z = 8, 1.2, 0.950456, 1.088754
LEVELS = 256


def exact_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(L, a, b) of 8-bit sRGB levels: L over 100 times 255, a and b plus 128."""
    linear = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    x = (linear(r) * 0.412453 + linear(g) * 0.357580 + linear(b) * 0.180423) / WHITE_X
    y = linear(r) * 0.212671 + linear(g) * 0.715160 + linear(b) * 0.072169
    z = (linear(r) * 0.019334 + linear(g) * 0.119193 + linear(b) * 0.950227) / WHITE_Z
    root = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return light * 255 / 100, 500 * (root(x) - root(y)) + 128, 200 * (root(y) - root(z)) + 128


def to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(L, a, b) as levels."""
    return tuple(F.greatest(F.lit(0), F.least(F.lit(255), F.round(c).cast("int"))) for c in exact_lab(r, g, b))


def from_lab(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(r, g, b) levels of what to_lab gives."""
    lum = light * 100 / 255
    fy = F.when(lum > 8, (lum + 16) / 116).otherwise(lum * 7.787 / 903.3 + 16 / 116)
    y = F.when(lum > 8, fy * fy * fy).otherwise(lum / 903.3)
    cube = lambda t: F.when(t > 0.206893, t * t * t).otherwise((t - 16 / 116) / 7.787)
    x, z = cube((a - 128) / 500 + fy) * WHITE_X, cube(fy - (b - 128) / 200) * WHITE_Z
    mixed = (x * 3.240479 - y * 1.537150 - z * 0.498535, -x * 0.969256 + y * 1.875991 + z * 0.041556, x * 0.055648 - y * 0.204043 + z * 1.057311)
    curve = lambda t: F.when(t <= 0.0031308, 12.92 * t).otherwise(1.055 * F.pow(F.greatest(t, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(255), F.round(curve(t) * 255).cast("int"))) for t in mixed)


def _sizes(image: DataFrame, tiles: int) -> DataFrame:
    """A row for each image: height, width, and those of a tile, for which an image that tiles don't divide is widened on both sides: th, tw."""
    size = image.groupBy("segment_id").agg((F.max("row") + 1).cast("long").alias("h"), (F.max("col") + 1).cast("long").alias("w"))
    even = (F.col("h") % tiles == 0) & (F.col("w") % tiles == 0)
    return size.select("segment_id", "h", "w", *[F.when(even, F.col(c) / tiles).otherwise((F.col(c) + tiles - F.col(c) % tiles) / tiles).cast("long").alias(f"t{c}") for c in "hw"])


def _mirrored(sizes: DataFrame, side: str, tiles: int) -> DataFrame:
    """(segment_id, place in the image, tile) for each place of the widened image along a side; beyond the border places are mirrored, without the border's own."""
    every = sizes.select("segment_id", side, f"t{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"t{side}") * tiles - 1)).alias("p"))
    period = F.greatest(2 * (F.col(side) - 1), F.lit(1).cast("long"))
    folded = F.when(F.col(side) == 1, 0).otherwise(F.least(F.col("p") % period, period - F.col("p") % period))
    name, tile = ("row", "ty") if side == "h" else ("col", "tx")
    return every.select("segment_id", folded.cast("long").alias(name), F.floor(F.col("p") / F.col(f"t{side}")).alias(tile))


def tile_maps(image: DataFrame, clip: float = CLIP, tiles: int = TILES) -> DataFrame:
    """(segment_id, ty, tx, v, level): what each level v becomes in each tile of a dense image. A bin's count over the clip limit (a multiple of the mean count) is dealt evenly to all."""
    sizes = _sizes(image, tiles)
    placed = image.join(_mirrored(sizes, "h", tiles), ["segment_id", "row"]).join(_mirrored(sizes, "w", tiles), ["segment_id", "col"])
    counts = placed.groupBy("segment_id", "ty", "tx", "v").agg(F.count(F.lit(1)).alias("n"))
    axis = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias(c)
    bins = sizes.select("segment_id", (F.col("th") * F.col("tw")).alias("area"), axis("ty")).select("*", axis("tx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("v"))
    tile = Window.partitionBy("segment_id", "ty", "tx")  # as many rows as levels
    most = F.greatest(F.floor(clip * F.col("area") / LEVELS), F.lit(1))
    full = bins.join(counts, ["segment_id", "ty", "tx", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("kept", F.least("n", most))
    over = full.withColumn("over", F.sum(F.col("n") - F.col("kept")).over(tile))
    rest = F.col("over") % LEVELS
    step = F.greatest(F.floor(LEVELS / F.greatest(rest, F.lit(1))), F.lit(1))
    more = F.when((F.col("v") % step == 0) & (F.floor(F.col("v") / step) < rest), 1).otherwise(0)
    total = F.sum(F.col("kept") + F.floor(F.col("over") / LEVELS) + more).over(tile.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return over.select("segment_id", "ty", "tx", "v", F.least(F.bround(total * (255.0 / F.col("area")), 0), F.lit(255.0)).cast("int").alias("level"))


def equalised(image: DataFrame, clip: float = CLIP, tiles: int = TILES) -> DataFrame:
    """The dense image (segment_id, row, col, v) with v from the maps of the four tiles whose middles lie around a pixel, by its distance to them."""
    sizes = _sizes(image, tiles)
    placed = image.join(F.broadcast(sizes), "segment_id")  # one row a segment

    def near(at: str, size: str) -> Column:
        """The two tiles along one side, and the pixel's share in each."""
        where = F.col(at) / F.col(size) - 0.5
        low = F.floor(where)
        inside = lambda k: F.greatest(F.least(low + k, F.lit(tiles - 1)), F.lit(0)).cast("long")
        return F.array(F.struct(inside(0).alias("tile"), (1 - (where - low)).alias("share")), F.struct(inside(1).alias("tile"), (where - low).alias("share")))

    spread = placed.select("segment_id", "row", "col", "v", F.explode(near("row", "th")).alias("y"), near("col", "tw").alias("x")).select("segment_id", "row", "col", "v", "y", F.explode("x").alias("x"))
    asked = spread.select("segment_id", "row", "col", "v", F.col("y.tile").alias("ty"), F.col("x.tile").alias("tx"), (F.col("y.share") * F.col("x.share")).alias("share"))
    met = asked.join(tile_maps(image, clip, tiles), ["segment_id", "ty", "tx", "v"])
    return met.groupBy("segment_id", "row", "col").agg(F.bround(F.round(F.sum(F.col("level") * F.col("share")), 6), 0).cast("int").alias("v"))


def clahe_gamma(pixels: DataFrame, clip: float = CLIP, tiles: int = TILES) -> DataFrame:
    """Dense pixels (segment_id, row, col, r, g, b) with their lightness equalised by tiles, and gamma applied; colours are converted with rounding to levels, so a level may differ by one from other tables."""
    light, a, b = to_lab(F.col("r"), F.col("g"), F.col("b"))
    lab = pixels.select("segment_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), light.alias("v"), a.alias("_a"), b.alias("_b"))
    new = equalised(lab.select("segment_id", "row", "col", "v"), clip, tiles).withColumnRenamed("v", "_l")
    colors = from_lab(F.col("_l"), F.col("_a"), F.col("_b"))
    return lab.join(new, ["segment_id", "row", "col"]).select("segment_id", "row", "col", *[gamma(c).alias(name) for c, name in zip(colors, "rgb", strict=True)])
