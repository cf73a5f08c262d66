"""Curves through clusters: ordered edges, polynomial fits, curves in space and line sets made of many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.geometry import AXES
from cloudloom.operators.clusters import ranked
from cloudloom.operators.raster import principal_axes, to_axes
from cloudloom.sources.shared import saved

#: Degrees of a curve's y and z over its x, and the least points of a cluster that has one.
DEGREES, LEAST = (3, 4), 5


def edges(points: DataFrame) -> DataFrame:
    """points (segment, seq, x, y, z) with x2, y2, z2 of the next point of their segment; the last point has none."""
    w = Window.partitionBy("segment").orderBy("seq")
    return points.withColumns({f"{a}2": F.lead(a).over(w) for a in "xyz"}).where(F.col("x2").isNotNull())


def polynomials(cloud: DataFrame, by: str, x: str, y: str, degree: int) -> DataFrame:
    """(by, n, coefficients from the constant up): least squares, with the sums made by Spark and a small system solved for each group.

    Sums are of powers of x less its group's mean over its deviation, so they stay small; where x has too few different values, the smallest coefficients of these count."""
    scales = cloud.groupBy(by).agg(F.avg(x).alias("_mean"), F.when(F.stddev_pop(x) > 0, F.stddev_pop(x)).otherwise(1.0).alias("_scale"))
    u = (F.col(x) - F.col("_mean")) / F.col("_scale")
    power = lambda k: F.pow(u, F.lit(k)) if k else F.lit(1.0)
    sums = cloud.join(scales, by).groupBy(by, "_mean", "_scale").agg(F.count(F.lit(1)).alias("n"), *[F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(power(k) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
                scaled = np.linalg.lstsq(a, np.array([r[f"t{i}"] for i in range(degree + 1)]), rcond=1e-10)[0]
                plain = np.polynomial.Polynomial(scaled)(np.polynomial.Polynomial([-r["_mean"] / r["_scale"], 1 / r["_scale"]]))
                out.append((r[by], r["n"], np.pad(plain.coef, (0, degree + 1 - len(plain.coef))).tolist()))
            yield pd.DataFrame(out, columns=[by, "n", "coefficients"])

    kind = cloud.schema[by].dataType.simpleString()
    return sums.mapInPandas(solve, f"{by} {kind}, n long, coefficients array<double>")


def cluster_curves(cloud: DataFrame, by: str = "label", degrees: tuple[int, int] = DEGREES, least: int = LEAST) -> DataFrame:
    """(by, vertex, point_id, x, y, z): a curve through each cluster of least points or more. Along the cluster's first principal axis its points are ordered (vertex, from 0) and moved onto the polynomials of the two other axes, then turned back."""
    few = cloud.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select(by)
    own = cloud.join(few, by, "left_anti").select(F.col(by).cast("int").alias("segment_id"), "point_id", *AXES)
    axes = saved(principal_axes(own))
    turned = saved(to_axes(own, axes))
    fits = [polynomials(turned, "segment_id", "x", a, degree).select("segment_id", F.col("coefficients").alias(f"c{a}")) for a, degree in zip("yz", degrees, strict=True)]
    value = lambda a, degree: F.aggregate(F.reverse(f"c{a}"), F.lit(0.0), lambda s, c: s * F.col("x") + c)
    bent = turned.join(fits[0], "segment_id").join(fits[1], "segment_id").withColumns({a: value(a, d) for a, d in zip("yz", degrees, strict=True)})
    placed = numbered(bent.select("segment_id", "point_id", *AXES), "segment_id", ["x", "point_id"])
    back = to_axes(placed, axes, back=True)
    return back.select(F.col("segment_id").cast(cloud.schema[by].dataType).alias(by), "vertex", "point_id", *AXES)


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with vertex, their place in their part (by) from 0; a part of any size spreads over tasks."""
    every = saved(ranked(rows, [by, *order]))
    return every.join(every.groupBy(by).agg(F.min("rank").alias("_first")), by).withColumn("vertex", F.col("rank") - F.col("_first")).drop("rank", "_first")


def path(vertices: DataFrame, by: str) -> DataFrame:
    """(by, a, b): the edges from each vertex to the next of its part."""
    ends = vertices.select(by, (F.col("vertex") - 1).alias("vertex"), F.col("vertex").alias("b"))
    return vertices.select(by, "vertex").join(ends, [by, "vertex"]).select(by, F.col("vertex").alias("a"), "b")


def merged(vertices: DataFrame, faces: DataFrame, by: str, corners: tuple[str, ...] = ("a", "b")) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of many meshes or line sets as one: vertices (by, vertex) numbered through all parts, one part after the other, and the corners of faces moved by their part's first number.

    Numbers of a part must run from 0 without gaps."""
    every = saved(ranked(vertices, [by, "vertex"]))
    first = every.groupBy(by).agg(F.min("rank").alias("_first"))
    moved = faces.join(first, by).withColumns({c: F.col(c) + F.col("_first") for c in corners}).drop("_first")
    return every.withColumn("vertex", F.col("rank")).drop("rank"), moved
