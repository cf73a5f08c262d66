"""Borders of pixel regions: contours with their areas, what they enclose, and images without their borders.

A contour is the border between an 8-connected region of lit pixels and a 4-connected one of unlit pixels; it runs through the centres of the lit ones. Each square of four
neighbouring pixels holds its own stretches of contours, so areas (by the shoelace formula) are one aggregate over squares and no border is ever followed.
Around the image lies a ring of unlit pixels. Images are tables (segment_id, row, col, v) that are dense; many go through at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.raster import erode, label_pixels
from cloudloom.sources.shared import Workspace, saved

PIXEL = ["segment_id", "row", "col"]
#: Corners of a square by (row, col) offset, and the stretches in it: the corners that must be unlit, then where the contour goes from and to, with the unlit side on its right.
_CORNERS = [(0, 0), (0, 1), (1, 0), (1, 1)]
_STRETCHES = [
    (((0, 0),), (1, 0), (0, 1)), (((0, 1),), (0, 0), (1, 1)), (((1, 1),), (0, 1), (1, 0)), (((1, 0),), (1, 1), (0, 0)),
    (((0, 0), (0, 1)), (1, 0), (1, 1)), (((1, 0), (1, 1)), (0, 1), (0, 0)), (((0, 0), (1, 0)), (1, 1), (0, 1)), (((0, 1), (1, 1)), (0, 0), (1, 0)),
]


def regions(image: DataFrame) -> DataFrame:
    """(segment_id, row, col, lit, region) of each pixel, and of the ring around each image: region is the smallest cell of the pixels connected with it, 8-connected if lit, else 4-connected. Written."""
    size = image.groupBy("segment_id").agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    line = lambda last: F.sequence(F.lit(-1).cast("long"), F.col(last).cast("long") + 1)
    sides = [size.select("segment_id", F.explode(F.array(F.lit(-1).cast("long"), F.col("_h") + 1)).alias("row"), "_w").select("segment_id", "row", F.explode(line("_w")).alias("col"))]
    sides += [size.select("segment_id", F.explode(line("_h")).alias("row"), "_w").select("segment_id", "row", F.explode(F.array(F.lit(-1).cast("long"), F.col("_w") + 1)).alias("col"))]
    ring = sides[0].unionByName(sides[1]).distinct().withColumn("lit", F.lit(False))
    every = image.select("segment_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), (F.col("v") > 0).alias("lit")).unionByName(ring)
    # Cells are numbered from 0 on, so the ring's are moved in.
    moved = saved(every.withColumns({c: F.col(c) + 1 for c in ("row", "col")}))
    named = label_pixels(moved.where("lit"), 8).unionByName(label_pixels(moved.where("NOT lit"), 4))
    return saved(named.select("segment_id", F.col("row") - 1, F.col("col") - 1, "lit", F.col("component").alias("region")).toDF(*PIXEL, "lit", "region"))


def _squares(pixels: DataFrame) -> DataFrame:
    """A row for each square with lit and unlit pixels: its upper left (row, col), and region and lit of its corners, named by their offsets."""
    spread = pixels.select("*", F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in _CORNERS])).alias("at"))
    keys = ["segment_id", (F.col("row") - F.col("at.dr")).alias("r"), (F.col("col") - F.col("at.dc")).alias("c")]
    here = lambda r, c: (F.col("at.dr") == r) & (F.col("at.dc") == c)
    columns = [F.max(F.when(here(r, c), F.col(x))).alias(f"{x}{r}{c}") for r, c in _CORNERS for x in ("lit", "region")]
    squares = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("lit").alias("bright"), *columns)
    return squares.where("n = 4 AND bright BETWEEN 1 AND 3")


def contours(pixels: DataFrame) -> DataFrame:
    """(segment_id, region, around, area) for each contour of pixels (regions): the lit and the unlit region that it parts, and the area it encloses, negative if the unlit region lies inside. A contour of one pixel or of a line has area 0."""
    lit = lambda at: F.col(f"lit{at[0]}{at[1]}")
    region = lambda at: F.col(f"region{at[0]}{at[1]}")
    x, y = (lambda at: F.col("c") + at[1]), (lambda at: F.col("r") + at[0])

    def stretch(off: tuple, start: tuple, end: tuple) -> Column:
        there = lit(start) & lit(end)
        for at in off:
            there &= ~lit(at)
        return F.when(there, F.struct(region(start).alias("region"), region(off[0]).alias("around"), (x(start) * y(end) - x(end) * y(start)).alias("twice")))

    def touch(a: tuple, b: tuple) -> Column:
        """Lit and unlit neighbours have a contour between them, perhaps one without length."""
        return F.when(lit(a) != lit(b), F.struct(F.when(lit(a), region(a)).otherwise(region(b)).alias("region"), F.when(lit(a), region(b)).otherwise(region(a)).alias("around"), F.lit(0).cast("long").alias("twice")))

    parts = [stretch(*s) for s in _STRETCHES] + [touch(a, b) for a in _CORNERS for b in _CORNERS if a < b and (a[0] == b[0] or a[1] == b[1])]
    rows = _squares(pixels).select("segment_id", F.explode(F.array(*parts)).alias("s")).where("s IS NOT NULL")
    return rows.groupBy("segment_id", "s.region", "s.around").agg((F.sum("s.twice") / 2).alias("area"))


def largest(found: DataFrame) -> DataFrame:
    """The contour of largest area of each segment; of equal ones that of the smallest region, then around."""
    top = found.groupBy("segment_id").agg(F.max(F.struct(F.abs("area").alias("size"), (-F.col("region")).alias("region"), (-F.col("around")).alias("around"), "area")).alias("top"))
    return top.select("segment_id", (-F.col("top.region")).alias("region"), (-F.col("top.around")).alias("around"), "top.area")


def enclosed(found: DataFrame, outer: DataFrame, work: Workspace) -> DataFrame:
    """(segment_id, region) of all that lies inside the contours outer (one each segment), their own lit region included: from each region on to those whose border it surrounds. A few rounds, as regions nest."""
    steps = work.keep(found.select("segment_id", F.when(F.col("area") < 0, F.col("region")).otherwise(F.col("around")).alias("region"), F.when(F.col("area") < 0, F.col("around")).otherwise(F.col("region")).alias("next")))
    inside = fresh = work.keep(outer.select("segment_id", "region"))
    while True:
        fresh = work.keep(fresh.join(steps, ["segment_id", "region"]).select("segment_id", F.col("next").alias("region")))
        if fresh.isEmpty():
            return inside
        inside = work.keep(inside.unionByName(fresh))


def border_pixels(pixels: DataFrame) -> DataFrame:
    """(segment_id, row, col, region, around): the lit pixels with an unlit one beside, once for each unlit region."""
    sides = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    unlit = pixels.where("NOT lit").select("segment_id", F.col("region").alias("around"), sides.alias("at")).select("segment_id", "around", "at.row", "at.col")
    return pixels.where("lit").select(*PIXEL, "region").join(unlit, PIXEL).distinct().select(*PIXEL, "region", "around")


def thickened(pixels: DataFrame, reach: float) -> DataFrame:
    """(segment_id, row, col): all places at most reach from one of the pixels."""
    far = int(reach)
    disc = [(r, c) for r in range(-far, far + 1) for c in range(-far, far + 1) if r * r + c * c <= reach * reach]
    spread = pixels.select("segment_id", "row", "col", F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in disc])).alias("d"))
    return spread.select("segment_id", (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col")).distinct()


def filled(image: DataFrame, pixels: DataFrame, found: DataFrame, work: Workspace) -> DataFrame:
    """image with v 255 inside the largest contour, else 0."""
    inside = pixels.join(enclosed(found, largest(found), work), ["segment_id", "region"], "left_semi").select(*PIXEL, F.lit(255).alias("_in"))
    return image.join(inside, PIXEL, "left").select(*PIXEL, F.coalesce("_in", F.lit(0)).alias("v"))


def without_borders(gray: DataFrame, binary: DataFrame, size: int = 9, rounds: int = 3, stroke: int = 8) -> DataFrame:
    """binary with v 0 near the borders of gray: in the band that rounds erosions by size x size take from the area in the largest contour, and within half a stroke of all contours whose area differs from the largest.

    Lines of a stroke are drawn as discs around the contour's pixels. An image without lit pixels has no borders."""
    with Workspace(gray.sparkSession) as work:
        pixels = work.keep(regions(gray))
        found = work.keep(contours(pixels))
        area = work.keep(filled(gray, pixels, found, work))
        left = erode(area, 2 * rounds * (size // 2) + 1).withColumnRenamed("v", "_left")
        band = area.join(left, PIXEL).where("v > 0 AND _left = 0").select(*PIXEL)
        top = largest(found).select("segment_id", F.abs("area").alias("_top"))
        others = found.join(top, "segment_id").where(F.abs("area") != F.col("_top")).select("segment_id", "region", "around")
        drawn = thickened(border_pixels(pixels).join(others, ["segment_id", "region", "around"], "left_semi"), stroke / 2)
        gone = work.keep(band.unionByName(drawn).distinct().withColumn("_gone", F.lit(True)))
        return saved(binary.join(gone, PIXEL, "left").select(*PIXEL, F.when(F.col("_gone"), 0).otherwise(F.col("v")).alias("v")))
