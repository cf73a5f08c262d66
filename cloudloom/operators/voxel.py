"""Cloud metrics, density-targeted voxel downsampling, column extrema and cell recovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.color import gray
from cloudloom.functions.geometry import AXES, cell
from cloudloom.sources.shared import Workspace, saved


def metrics(cloud: DataFrame) -> DataFrame:
    """One row: n, bounds, extents and density (null where a side has no extent)."""
    bounds = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    out = cloud.agg(F.count(F.lit(1)).alias("n"), *bounds).withColumns({f"d{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES})
    return out.withColumn("density", F.try_divide(F.col("n"), F.col("dx") * F.col("dy") * F.col("dz")))


def voxel_size(target: float) -> Column:
    """Over metrics: the edge at which about target points a cubic unit stay; null, to leave the cloud as it is, for those under 0.01, flat ones and ones too small for a point."""
    volume = F.col("dx") * F.col("dy") * F.col("dz")
    return F.when(F.col("density") >= 1e-2, F.round(F.pow(F.try_divide(volume, F.floor(volume * target)), F.lit(1 / 3)), 9))


#: The cell of the adaptive threshold for clouds with a larger extent than these, and for all others.
CELLS, LEAST_CELL = ((2500, 12), (2000, 10), (1500, 8)), 6


def threshold_cell(scale: float = 1) -> Column:
    """Over metrics: the cell of the adaptive threshold; scale brings the cloud's unit to that of the table."""
    extent, out = F.greatest("dx", "dy", "dz") * scale, F.lit(LEAST_CELL)
    for more, size in reversed(CELLS):
        out = F.when(extent > more, size).otherwise(out)
    return out


def downsample(cloud: DataFrame, target: float = 2.0) -> DataFrame:
    """A mean point for each voxel: i, j, k, n, x, y, z, gray. One aggregation for the bounds, one for the voxels.

    A cloud without a voxel size stays as it is: each point by itself, with null i, j and k."""
    m = metrics(cloud).withColumn("v", voxel_size(target)).select("v", *[f"min_{a}" for a in AXES])
    keys = [cell(F.col(a), F.col("v"), F.col(f"min_{a}") - F.col("v") / 2).alias(k) for a, k in zip(AXES, "ijk", strict=True)]
    placed = cloud.join(F.broadcast(m)).select(*keys, F.when(F.col("v").isNull(), F.col("point_id")).alias("alone"), *AXES, "r", "g", "b")  # m is one row
    out = placed.groupBy("i", "j", "k", "alone").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*AXES, *"rgb")])
    return out.select("i", "j", "k", "n", *[F.round(a, 9).alias(a) for a in AXES], F.round(gray(), 9).alias("gray"))


def reduced(cloud: DataFrame, size: float | None, target: float = 2.0, more: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, x, y, z and more): the mean of each voxel's points, with their smallest id; without a size that for about target points a cubic unit. Voxels start half a voxel before the smallest corner."""
    m = metrics(cloud).select((voxel_size(target) if size is None else F.lit(float(size))).alias("v"), *[f"min_{a}" for a in AXES])
    keys = [cell(F.col(a), F.col("v"), F.col(f"min_{a}") - F.col("v") / 2).alias(k) for a, k in zip(AXES, "ijk", strict=True)]
    placed = cloud.join(F.broadcast(m)).select("point_id", *AXES, *more, *keys, F.when(F.col("v").isNull(), F.col("point_id")).alias("alone"))  # m is one row
    return placed.groupBy("i", "j", "k", "alone").agg(F.min("point_id").alias("point_id"), *[F.avg(a).alias(a) for a in (*AXES, *more)]).select("point_id", *AXES, *more)


def column_extrema(cloud: DataFrame, size: float = 0.5) -> DataFrame:
    """i, j, max_id, min_id: of each XY cell the points of largest and smallest z, of equal ones the smallest id."""
    return cloud.groupBy(cell(F.col("x"), size).alias("i"), cell(F.col("y"), size).alias("j")).agg(
        F.max_by("point_id", F.struct(F.col("z"), -F.col("point_id"))).alias("max_id"), F.min_by("point_id", F.struct("z", "point_id")).alias("min_id")
    )


def recover(region: DataFrame, full: DataFrame, sizes: tuple[float, ...] = (1.0, 0.8, 1.0, 0.6, 1.0, 0.5)) -> DataFrame:
    """The points of full in the occupied cells of each segment's region, round after round, each result being the next region; for all segments at once.

    Cells start half a cell before the region's smallest corner. Points of full may belong to several segments."""
    with Workspace(full.sparkSession) as work:
        return saved(_recovered(region.select("segment_id", *AXES), full, sizes, work))


def _recovered(current: DataFrame, full: DataFrame, sizes: tuple[float, ...], work: Workspace) -> DataFrame:
    for size in sizes:
        corner = current.groupBy("segment_id").agg(*[(F.min(a) - size / 2).alias(f"o{a}") for a in AXES])
        keys = [cell(F.col(a), size, F.col(f"o{a}")).alias(f"c{a}") for a in AXES]
        cells = current.join(corner, "segment_id").select("segment_id", *[f"o{a}" for a in AXES], *keys).distinct()
        # A segment's cells don't start where those of others do. Each overlaps up to eight cells of one grid for all, in which a point lies once.
        shared = [F.explode(F.sequence(F.floor(F.col(f"o{a}") / size + F.col(f"c{a}") - 1e-6), F.floor(F.col(f"o{a}") / size + F.col(f"c{a}") + 1 + 1e-6))).alias(f"g{a}") for a in AXES]
        spread = cells
        for a, column in zip(AXES, shared, strict=True):
            spread = spread.select("*", column)
        points = full.select("point_id", *AXES, *[F.floor(F.col(a) / size).alias(f"g{a}") for a in AXES])
        same = " AND ".join(f"floor(({a} - o{a}) / {size!r}D) = c{a}" for a in AXES)
        current = work.keep(points.join(spread, [f"g{a}" for a in AXES]).where(same).select("segment_id", "point_id", *AXES))
    return current


def recover_in_order(region: DataFrame, full: DataFrame, sizes: tuple[float, ...] = (1.0, 0.8, 1.0, 0.6, 1.0, 0.5)) -> DataFrame:
    """(segment_id, point_id, x, y, z) as recover, but a segment takes its points: segments go by their number, and those after it find the cloud without them.

    A round reaches no farther than its cells are wide, so a segment's points lie in its box widened by all of these. Segments whose boxes meet no earlier one that still waits go at once;
    there are as many turns as the longest chain of boxes that meet, not as segments."""
    reach = sum(sizes) * (1 + 1e-9)
    with Workspace(full.sparkSession) as work:
        region = work.keep(region.select("segment_id", *AXES))
        boxes = work.keep(region.groupBy("segment_id").agg(*[f.alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min(a) - reach), ("hi", F.max(a) + reach))]))
        wide = boxes.agg(F.max(F.col("hix") - F.col("lox"))).first()[0] or 1.0
        # Boxes that meet share a strip of x as wide as the widest.
        strips = boxes.withColumn("strip", F.explode(F.sequence(F.floor(F.col("lox") / wide), F.floor(F.col("hix") / wide))))
        later = strips.withColumnsRenamed({c: f"{c}_2" for c in boxes.columns})
        meet = reduce(Column.__and__, [(F.col(f"lo{a}") <= F.col(f"hi{a}_2")) & (F.col(f"lo{a}_2") <= F.col(f"hi{a}")) for a in AXES])
        before = work.keep(strips.join(later, "strip").where(meet & (F.col("segment_id") < F.col("segment_id_2"))).select("segment_id", F.col("segment_id_2").alias("later")).distinct())
        waiting, left, found = work.keep(boxes.select("segment_id")), full.select("point_id", *AXES), []
        while not waiting.isEmpty():
            held = before.join(waiting, "segment_id").select(F.col("later").alias("segment_id")).distinct()
            now = work.keep(waiting.join(held, "segment_id", "left_anti"))
            found.append(work.keep(_recovered(region.join(now, "segment_id", "left_semi"), left, sizes, work)))
            left = work.keep(left.join(found[-1].select("point_id"), "point_id", "left_anti"))
            waiting = work.keep(waiting.join(now, "segment_id", "left_anti"))
        return saved(reduce(DataFrame.unionByName, found)) if found else saved(left.limit(0).withColumn("segment_id", F.lit(0)).select("segment_id", "point_id", *AXES))


def recovery_ratio(recovered: DataFrame, full: DataFrame) -> DataFrame:
    """Points recovered as a percentage of all, at most 100."""
    return recovered.agg(F.count(F.lit(1)).alias("recovered")).join(full.agg(F.count(F.lit(1)).alias("total"))).withColumn("ratio", F.least(F.lit(100.0), F.col("recovered") / F.col("total") * 100))


def upsample(cloud: DataFrame, n: int = 50, radius: float = 0.01, seed: int = 0) -> DataFrame:
    """The points and n copies of each, moved by Gaussian steps; copy 0 is the point itself."""
    copies = cloud.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return copies.withColumns({a: F.when(F.col("copy") == 0, F.col(a)).otherwise(F.col(a) + F.randn(seed + k) * radius) for k, a in enumerate(AXES)})
