"""Compositions that users of point clouds run as one: preparing a cloud, its paint, inconsistent normals, segments at full resolution, lines and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.color import paint_color
from cloudloom.functions.geometry import AXES, cell
from cloudloom.operators import clusters, neighbors, orient, register, voxel
from cloudloom.sources.shared import saved

COLORS = ("r", "g", "b")
#: The constant of the adaptive threshold for each paint.
CUTS = {"white": -7, "green": -3}


def paint(cloud: DataFrame) -> str:
    """The paint that the brighter of two colour clusters is taken for."""
    split = saved(clusters.kmeans(cloud, 2, COLORS))
    bright = clusters.brightest(split).select("label")
    mean = split.join(F.broadcast(bright), "label").agg(*[F.avg(c).alias(c) for c in COLORS])  # bright is one row
    return mean.select(paint_color(F.col("r"), F.col("g"), F.col("b"))).first()[0]


def prepare(cloud: DataFrame, target: float = 2.0, by_voxel: bool = True, normals: bool = True, check: bool = False, radius: float = 2.0, most: int = 10, k: int = 10, **limits) -> DataFrame:
    """cloud (point_id, x, y, z, r, g, b) as the other steps take it: one point for each voxel, for about target points a cubic unit, with the smallest id and the mean colour; normals of up to most
    neighbours within radius, oriented along the tree of k nearest; with check those are turned round that contradict the heights (limits: as for consistent_normals).

    A cloud too thin for a voxel size keeps its points."""
    own = saved(voxel.reduced(cloud, None, target, COLORS) if by_voxel else cloud.select("point_id", *AXES, *COLORS))
    if not normals:
        return own
    found = saved(orient.oriented(saved(register.normals(own, radius, most)), k))
    if not check:
        return found.drop("flipped")
    return consistent_normals(found.drop("flipped"), **limits).drop("flipped")


def split_by_color(cloud: DataFrame, k: int = 2) -> DataFrame:
    """cloud with label: k clusters of colours, or all of the cloud in one of them where it has fewer colours."""
    return clusters.kmeans(cloud, k, COLORS)


def extreme_masks(cloud: DataFrame, k: int = 4) -> DataFrame:
    """(point_id, blue, black): blue the normals' cluster of the highest point, black that of the lowest."""
    parts = saved(clusters.kmeans(cloud, k, ("nx", "ny", "nz")))
    ends = clusters.extreme_clusters(parts)
    return parts.join(F.broadcast(ends)).select("point_id", (F.col("label") == F.col("max_label")).alias("blue"), (F.col("label") == F.col("min_label")).alias("black"))  # ends is one row


def inconsistent_clusters(cloud: DataFrame, ids: DataFrame, threshold: float = 0.01, start: int = 10, least: int = 500, most_aspect: float = 4.0) -> DataFrame:
    """(point_id): of the points named by ids, those in density clusters of least points or more that aren't long and thin; eps is the knee of these points. None without a knee."""
    own = saved(cloud.join(ids.select("point_id").distinct(), "point_id", "left_semi"))
    eps = clusters.epsilon(own, start, threshold).first()["eps"]
    if not eps:
        return own.select("point_id").limit(0)
    found = saved(clusters.filter_by_size(clusters.dbscan(own, eps), least))
    return clusters.filter_by_aspect(found, most=most_aspect).select("point_id")


def consistent_normals(cloud: DataFrame, size: float = 0.5, k: int = 128, k_black: int = 12, near: int = 10, **limits) -> DataFrame:
    """cloud with flipped: masks by normals and by heights, the points where they contradict each other, of these the large clusters, and their normals turned round."""
    height = neighbors.height_masks(cloud, size, k, k_black)
    masks = extreme_masks(cloud).join(height, "point_id").select("point_id", "blue", "black", (F.col("color") == "red").alias("red"), (F.col("color") == "green").alias("green"))
    wrong = inconsistent_clusters(cloud, neighbors.inconsistent(masks), **limits)
    return neighbors.corrected_normals(cloud, wrong, near)


def recovered_segments(segments: DataFrame, full: DataFrame, more: float = 0.15, least: int = 10_000, start: int = 5000, threshold: float = 5e-5) -> DataFrame:
    """(segment_id, point_id, x, y, z): the full cloud's points in the region of each segment, in density clusters of least points or more."""
    found = saved(voxel.recover(segments, full))
    named = clusters.knee_clusters(found, "segment_id", more, start, threshold)
    return clusters.filter_by_size(named, least).select("segment_id", "point_id", *AXES)


def line_points(cloud: DataFrame, color: str = "white", by_voxel: bool = True, k: int = 4, size: float | None = None) -> DataFrame:
    """The points of painted lines: those over the adaptive threshold of their voxel (or of the whole cluster) inside each of k clusters of normals."""
    parts = saved(clusters.kmeans(cloud, k, ("nx", "ny", "nz")))
    if by_voxel and size is None:
        size = float(voxel.metrics(cloud).select(voxel.threshold_cell()).first()[0])
    keys = [F.col("label"), *([cell(F.col(a), size) for a in AXES] if by_voxel else [])]
    return clusters.adaptive(parts, keys, CUTS[color])


def line_clusters(lines: DataFrame, start: int = 5000, threshold: float = 5e-5) -> DataFrame:
    """lines with label: their density clusters at the knee's eps, without noise. No rows without a knee."""
    eps = clusters.epsilon(lines, start, threshold).first()["eps"]
    if eps is None:
        return lines.withColumn("label", F.lit(-1)).limit(0)
    return clusters.dbscan(lines, eps).where("label >= 0")
