"""Projections of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: The axes of scans onto those of the models, (x, y, z) to (z, x, y).
PERMUTATION = [[0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
#: The radius of a curve's cylinders, and their height over the length of their edge.
RADIUS, OVERLAP = 0.2, 2


def scale(cloud: DataFrame, factor: float) -> DataFrame:
    """About the origin."""
    return cloud.withColumns({a: F.col(a) * factor for a in AXES})


def affine(cloud: DataFrame, matrix: list[list[float]], normals: bool = False) -> DataFrame:
    """Points through a 4 x 4 matrix; normals only turn."""
    row = lambda m, names: F.col(names[0]) * m[0] + F.col(names[1]) * m[1] + F.col(names[2]) * m[2]
    out = {a: row(m, AXES) + m[3] for a, m in zip(AXES, matrix, strict=False)}
    if normals:
        out |= {f"n{a}": row(m, ("nx", "ny", "nz")) for a, m in zip(AXES, matrix, strict=False)}
    return cloud.withColumns(out)


def inverted(cloud: DataFrame, where: Column) -> DataFrame:
    """cloud with the normals turned round of the rows that where holds for."""
    return cloud.withColumns({f"n{a}": F.when(where, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in AXES})


def cell(value: Column, size: float | Column, origin: float | Column = 0.0) -> Column:
    return F.floor((value - origin) / size)


def cylinders(edges: DataFrame) -> DataFrame:
    """Axis, angle and height of the cylinder along each edge (x, y, z to x2, y2, z2); an edge along z turns by nothing, one of length 0 has none."""
    d = {a: F.col(f"{a}2") - F.col(a) for a in AXES}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    flat = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
    out = edges.withColumns({"length": length, "flat": flat, "dx": d["x"], "dy": d["y"], "dz": d["z"]}).where("length > 0")
    return out.select(
        *[c for c in edges.columns], F.when(F.col("flat") == 0, 0.0).otherwise(-F.col("dy") / F.col("flat")).alias("axis_x"), F.when(F.col("flat") == 0, 0.0).otherwise(F.col("dx") / F.col("flat")).alias("axis_y"),
        F.when(F.col("flat") == 0, 0.0).otherwise(F.acos(F.col("dz") / F.col("length"))).alias("angle"), (F.col("length") * OVERLAP).alias("height"), F.lit(RADIUS).alias("radius"),
    )
