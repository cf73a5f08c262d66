"""Alpha shapes of flat clouds, and the skeletons of what they cover.

A triangle of three points is in the shape if no other point lies in its circumcircle (Delaunay) and its circumradius is under 1 / alpha. The circle then lies in the tile of its
middle and a halo of that radius, so each tile triangulates its own points and those of its halo, and gives the triangles whose middle it holds: exactly those of one
triangulation of everything. Clouds are tables (shape, point_id, x, y); many shapes go through at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.geometry import AXES
from cloudloom.operators import shapes
from cloudloom.operators.neighbors import nearest
from cloudloom.operators.raster import principal_axes, to_axes
from cloudloom.sources.shared import saved

#: 1 / alpha is the largest radius, pixels for each unit, and points whose heights a skeleton's pixel takes the mean of.
ALPHA, SCALE, NEAR = 1.15, 100, 5


def triangulated(at: np.ndarray, most: float) -> np.ndarray:
    """The Delaunay triangles (rows of three numbers) of different points in general position; those with circles of radius most or less are all there: one point after the other, the triangles whose circle holds it are replaced by a fan around it."""
    n = len(at)
    if n < 3:
        return np.zeros((0, 3), int)
    middle, size = at.mean(axis=0), max(2 * most, float(np.ptp(at, axis=0).max()))
    every = np.concatenate([(at - middle) / size, [(-60.0, -40.0), (60.0, -40.0), (0.0, 80.0)]])
    found = np.array([[n, n + 1, n + 2]])
    for i in range(n):
        d = every[found] - every[i]  # triangles x corners x axes
        lift = np.square(d).sum(axis=2)
        inside = (
            lift[:, 0] * (d[:, 1, 0] * d[:, 2, 1] - d[:, 2, 0] * d[:, 1, 1])
            - lift[:, 1] * (d[:, 0, 0] * d[:, 2, 1] - d[:, 2, 0] * d[:, 0, 1])
            + lift[:, 2] * (d[:, 0, 0] * d[:, 1, 1] - d[:, 1, 0] * d[:, 0, 1])
        ) > 0
        gone = found[inside]
        edges = np.concatenate([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]])
        # The hole's border: edges of one triangle only, in its direction.
        back = {(int(b), int(a)) for a, b in edges}
        rim = np.array([e for e in edges.tolist() if tuple(e) not in back]).reshape(-1, 2)
        found = np.concatenate([found[~inside], np.column_stack([rim, np.full(len(rim), i)])])
    return found[(found < n).all(axis=1)]


def circles(at: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles and radii of the circles through triangles."""
    a, b, c = (at[triangles[:, k]] for k in range(3))
    b, c = b - a, c - a
    twice = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (c[:, 1] * np.square(b).sum(1) - b[:, 1] * np.square(c).sum(1)) / twice
        y = (b[:, 0] * np.square(c).sum(1) - c[:, 0] * np.square(b).sum(1)) / twice
    return a + np.column_stack([x, y]), np.hypot(x, y)


def triangles(cloud: DataFrame, alpha: float = ALPHA, points_of_tile: int = 400) -> DataFrame:
    """(shape, a, b, c) with a < b < c, the ids of the corners of the shape's triangles. Of points at one place that with the smallest id counts.

    Points are moved by a hair that hangs on their place, so that no four lie on a circle; of the ways to split a regular grid's squares one is taken, the same in all tiles. A tile
    is as wide as about points_of_tile points need at the cloud's mean density, twice the halo at least; what it holds is one task's."""
    most = 1 / alpha
    once = saved(cloud.groupBy("shape", "x", "y").agg(F.min("point_id").alias("point_id")))
    box = once.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in "xy"])
    width = F.greatest(F.sqrt(F.col("x") * F.col("y") / F.col("n") * points_of_tile), F.lit(2 * most))
    tile_of = lambda c, shift: F.floor((F.col(c) + shift) / F.col("width"))
    # A box is one row a shape.
    wide = once.join(F.broadcast(box.select("shape", width.alias("width"))), "shape")
    near = lambda c: F.explode(F.sequence(tile_of(c, -most), tile_of(c, most)))
    hair = lambda k: (F.pmod(F.xxhash64("x", "y", F.lit(k)), F.lit(1 << 20)) / (1 << 20) - 0.5) * most * 1e-6
    dealt = wide.withColumns({"jx": F.col("x") + hair(0), "jy": F.col("y") + hair(1)}).withColumn("tx", near("x")).withColumn("ty", near("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        ids, at, width = pdf["point_id"].to_numpy(), pdf[["jx", "jy"]].to_numpy(float), float(pdf["width"].iloc[0])
        found = np.sort(triangulated(at, most), axis=1)
        middle, radius = circles(at, found)
        with np.errstate(invalid="ignore"):
            own = (radius < most) & (np.floor(middle[:, 0] / width) == pdf["tx"].iloc[0]) & (np.floor(middle[:, 1] / width) == pdf["ty"].iloc[0])
        corners = ids[found[own]]
        return pd.DataFrame({"shape": pdf["shape"].iloc[0], "a": corners[:, 0], "b": corners[:, 1], "c": corners[:, 2]})

    kind = cloud.schema["shape"].dataType.simpleString()
    return dealt.groupBy("shape", "tx", "ty").applyInPandas(run, f"shape {kind}, a long, b long, c long")


def outline(found: DataFrame) -> DataFrame:
    """(shape, a, b) with a < b: the edges that one triangle alone has, the shape's border and that of its holes."""
    sides = F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ("ab", "bc", "ac")])).alias("e")
    return found.select("shape", sides).groupBy("shape", "e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("shape", "a", "b")


def covered(cloud: DataFrame, found: DataFrame) -> DataFrame:
    """(shape, row, col): the pixels (whole numbers; x is col, y is row) in the triangles or on their borders."""
    rows = saved(found.withColumn("triangle", F.monotonically_increasing_id()))
    corners = rows.select(F.struct("shape", "triangle").alias("key"), "shape", F.posexplode(F.array("a", "b", "c")).alias("seq", "point_id"))
    placed = corners.join(cloud.select("shape", "point_id", "x", "y"), ["shape", "point_id"]).select(F.col("key").alias("shape"), F.lit(0).alias("ring"), "seq", "x", "y")
    return shapes.filled(placed).select("shape.shape", "row", "col").distinct()


def skeletons(cloud: DataFrame, by: str = "label", alpha: float = ALPHA, scale: float = SCALE, near: int = NEAR) -> DataFrame:
    """(by, x, y, z): the skeleton of each cluster. In its principal axes its alpha shape is drawn with scale pixels for each unit, thinned, lifted to the mean height of the near nearest points, and turned back.

    Clusters without a triangle have none."""
    own = cloud.select(F.col(by).cast("int").alias("segment_id"), "point_id", *AXES)
    axes = saved(principal_axes(own))
    turned = saved(to_axes(own, axes).withColumn("shape", F.col("segment_id")))
    found = triangles(turned.select("shape", "point_id", "x", "y"), alpha)
    corner = turned.groupBy("segment_id").agg(F.min("x").alias("_x"), F.max("y").alias("_y"))
    # Pixels run to the right and down from the upper left corner.
    drawn = turned.join(corner, "segment_id").select("shape", "point_id", ((F.col("x") - F.col("_x")) * scale).alias("x"), ((F.col("_y") - F.col("y")) * scale).alias("y"))
    thin = saved(shapes.thinned(covered(drawn, found).withColumnRenamed("shape", "segment_id")).withColumn("point_id", F.monotonically_increasing_id()))
    flat = saved(thin.join(corner, "segment_id").select("segment_id", "point_id", (F.col("col") / scale + F.col("_x")).alias("x"), (F.col("_y") - F.col("row") / scale).alias("y")))
    lifted = nearest(flat, turned, near, ("x", "y"), ["segment_id"]).join(turned.select("segment_id", F.col("point_id").alias("pid"), "z"), ["segment_id", "pid"])
    heights = lifted.groupBy("segment_id", F.col("qid").alias("point_id")).agg(F.avg("z").alias("z"))
    back = to_axes(flat.join(heights, ["segment_id", "point_id"]), axes, back=True)
    return back.select(F.col("segment_id").cast(cloud.schema[by].dataType).alias(by), *AXES)
