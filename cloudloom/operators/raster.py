"""Segments as pixels: rasters, image filters, connected components and the way back to 3-D."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.geometry import AXES
from cloudloom.operators.clusters import components
from cloudloom.operators.neighbors import nearest


def grids(cloud: DataFrame, step: float = 0.25) -> DataFrame:
    """A row for each segment: its bounds, and the grid's width and height."""
    out = cloud.groupBy("segment_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return out.withColumn("width", F.ceil((F.col("max_x") - F.col("min_x")) / step)).withColumn("height", F.ceil((F.col("max_y") - F.col("min_y")) / step)).withColumn("step", F.lit(step))


def _placed(cloud: DataFrame, step: float) -> DataFrame:
    cut = lambda a, low, size: F.least(F.floor((F.col(a) - F.col(low)) / step), F.col(size) - 1)
    # A grid is one row a segment.
    return cloud.join(F.broadcast(grids(cloud, step)), "segment_id").withColumn("col", cut("x", "min_x", "width")).withColumn("row", cut("y", "min_y", "height"))


def rasterize(cloud: DataFrame, step: float = 0.25) -> DataFrame:
    """(segment_id, row, col, r, g, b, n): the mean colour of each occupied cell, cut to whole numbers; row 0 is the smallest y."""
    level = lambda c: F.floor(F.round(F.avg(F.col(c) * 255), 6)).cast("int").alias(c)
    return _placed(cloud, step).groupBy("segment_id", "row", "col").agg(*map(level, "rgb"), F.count(F.lit(1)).alias("n"))


def rasterize_last(cloud: DataFrame, step: float = 0.25) -> DataFrame:
    """As rasterize, with the colour of the cell's last point."""
    last = _placed(cloud, step).groupBy("segment_id", "row", "col").agg(F.max_by(F.struct(*"rgb"), "point_id").alias("last"))
    return last.select("segment_id", "row", "col", *[F.floor(F.round(F.col(f"last.{c}") * 255, 6)).cast("int").alias(c) for c in "rgb"])


def dense(pixels: DataFrame, grid: DataFrame, value: Column) -> DataFrame:
    """(segment_id, row, col, v) of every cell of the grids, 0 where nothing is."""
    cells = grid.select("segment_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"), "width").select("segment_id", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    return cells.join(pixels.select("segment_id", "row", "col", value.cast("int").alias("v")), ["segment_id", "row", "col"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def _along(image: DataFrame, half: int, axis: str, what: str, edge: bool) -> DataFrame:
    """v replaced by the sum, least or greatest of 2 * half + 1 cells along an axis; edge repeats border cells."""
    other = "col" if axis == "row" else "row"
    line = Window.partitionBy("segment_id", other).orderBy(axis)
    near, whole = line.rowsBetween(-half, half), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if what != "sum":
        return image.withColumn("v", {"min": F.min, "max": F.max}[what]("v").over(near))
    out = F.sum("v").over(near)
    if edge:
        last = F.max(axis).over(whole)
        out = out + F.greatest(F.lit(half) - F.col(axis), F.lit(0)) * F.first("v").over(whole) + F.greatest(F.lit(half) - (last - F.col(axis)), F.lit(0)) * F.last("v").over(whole)
    return image.withColumn("v", out)


def box_mean_threshold(image: DataFrame, size: int = 11, c: float = -3) -> DataFrame:
    """v: 255 where a pixel is over the rounded mean of the size x size cells around it less c, else 0; border cells are repeated."""
    half = size // 2
    means = _along(_along(image.withColumn("own", F.col("v")), half, "col", "sum", True), half, "row", "sum", True)
    return means.select("segment_id", "row", "col", F.when(F.col("own") > F.floor(F.col("v") / (size * size) + 0.5) - c, 255).otherwise(0).alias("v"))


def erode(image: DataFrame, size: int) -> DataFrame:
    return _along(_along(image, size // 2, "col", "min", False), size // 2, "row", "min", False).select("segment_id", "row", "col", "v")


def dilate(image: DataFrame, size: int) -> DataFrame:
    return _along(_along(image, size // 2, "col", "max", False), size // 2, "row", "max", False).select("segment_id", "row", "col", "v")


def median(image: DataFrame, size: int = 5) -> DataFrame:
    """v: the middle of the size x size cells around it, border cells repeated: each pixel goes to the cells that it counts for."""
    half = size // 2
    bounds = image.groupBy("segment_id").agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    wide = image.join(F.broadcast(bounds), "segment_id")  # one row a segment

    def targets(axis: str, last: str) -> Column:
        """Where a cell counts along one axis, once for each time that repeating the border shows it."""
        own = F.col(axis)
        steps = F.sequence(F.greatest(own - half, F.lit(0)), F.least(own + half, F.col(last)))
        times = lambda t: 1 + F.when(own == 0, F.greatest(F.lit(half) - t, F.lit(0))).otherwise(0) + F.when(own == F.col(last), F.greatest(F.lit(half) - (F.col(last) - t), F.lit(0))).otherwise(0)
        return F.flatten(F.transform(steps, lambda t: F.array_repeat(t, times(t).cast("int"))))

    spread = wide.select("segment_id", "v", F.explode(targets("row", "_h")).alias("row"), F.col("col"), "_w").select("segment_id", "v", "row", F.explode(targets("col", "_w")).alias("col"))
    middle = F.get(F.sort_array(F.collect_list("v")), F.lit(size * size // 2))
    return spread.groupBy("segment_id", "row", "col").agg(middle.alias("v"))


def label_pixels(pixels: DataFrame, connectivity: int = 8) -> DataFrame:
    """pixels (segment_id, row, col) with component, the smallest cell number (row * 100000 + col in its segment) of the connected pixels."""
    width = 100_000
    named = pixels.withColumn("cell", (F.col("segment_id").cast("long") * width + F.col("row")) * width + F.col("col"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if connectivity == 8 else [])]
    next_to = named.select(F.col("cell").alias("a"), F.explode(F.array(*[F.col("cell") + dr * width + dc for dr, dc in steps])).alias("b"))
    edges = next_to.join(named.select(F.col("cell").alias("b")), "b", "left_semi").select("a", "b")
    found = components(edges).withColumnRenamed("node", "cell")
    return named.join(found, "cell", "left").withColumn("component", F.coalesce("root", "cell")).drop("root", "cell")


def drop_small(pixels: DataFrame, least: int, connectivity: int = 8) -> DataFrame:
    """Pixels of components of least pixels or more."""
    named = label_pixels(pixels, connectivity)
    large = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("component")
    return named.join(large, "component", "left_semi")


def lift(pixels: DataFrame, cloud: DataFrame, grid: DataFrame, k: int = 3, center: bool = False) -> DataFrame:
    """(segment_id, row, col, x, y, z, r, g, b): pixels that aren't black at their cell's corner, with the mean z of the k nearest points in the plane."""
    shift = 0.5 if center else 0.0
    lit = pixels.where("r <> 0 OR g <> 0 OR b <> 0").join(F.broadcast(grid.select("segment_id", "min_x", "min_y", "step")), "segment_id")
    placed = lit.select("segment_id", "row", "col", ((F.col("col") + shift) * F.col("step") + F.col("min_x")).alias("x"), ((F.col("row") + shift) * F.col("step") + F.col("min_y")).alias("y"), *"rgb", (F.col("row") * 100_000 + F.col("col")).alias("point_id"))
    found = nearest(placed, cloud, k, ("x", "y"), ["segment_id"]).join(cloud.select("segment_id", F.col("point_id").alias("pid"), "z"), ["segment_id", "pid"])
    z = found.groupBy("segment_id", F.col("qid").alias("point_id")).agg(F.avg("z").alias("z"))
    return placed.join(z, ["segment_id", "point_id"]).drop("point_id")


def principal_axes(cloud: DataFrame) -> DataFrame:
    """A row for each segment: mean (array) and eigenvectors (rows of x, y, z, largest variance first; all negated where the third's z is under 0)."""
    import numpy as np
    import pandas as pd

    from cloudloom.operators.clusters import covariance

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                m = np.array([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]])
                values, vectors = np.linalg.eigh(np.nan_to_num(m))
                v = vectors[:, np.argsort(-values, kind="stable")]
                # The sign of the larger component is fixed first, so that equal input gives equal axes.
                v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], axis=0)[0] < 0, -1.0, 1.0)
                v = -v if v[2, 2] < 0 else v
                out.append((r.segment_id, [r.mx, r.my, r.mz], v.T.tolist()))
            yield pd.DataFrame(out, columns=["segment_id", "mean", "axes"])

    return covariance(cloud).mapInPandas(solve, "segment_id int, mean array<double>, axes array<array<double>>")  # a row a segment


def to_axes(cloud: DataFrame, axes: DataFrame, back: bool = False) -> DataFrame:
    """Points in their segment's principal axes, or back from these."""
    joined = cloud.join(F.broadcast(axes), "segment_id")
    mean = lambda i: F.get("mean", F.lit(i))
    v = lambda i, j: F.get(F.get("axes", F.lit(i)), F.lit(j))
    if back:
        out = {a: F.col("x") * v(0, j) + F.col("y") * v(1, j) + F.col("z") * v(2, j) + mean(j) for j, a in enumerate(AXES)}
    else:
        out = {a: sum(((F.col(b) - mean(j)) * v(i, j) for j, b in enumerate(AXES)), F.lit(0.0)) for i, a in enumerate(AXES)}
    return joined.withColumns(out).drop("mean", "axes")
