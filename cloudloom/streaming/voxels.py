"""Voxel means of a scan that arrives in parts: sums and counts merge, so each batch of points updates the voxels that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.geometry import AXES, cell


def running_voxels(points: DataFrame, size: float) -> DataFrame:
    """i, j, k, n and mean x, y, z of a stream of points (point_id, x, y, z); for output mode update or complete. State is one row a voxel."""
    keys = [cell(F.col(a), size).alias(k) for a, k in zip(AXES, "ijk", strict=True)]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in AXES])
