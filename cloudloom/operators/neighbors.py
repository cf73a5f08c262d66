"""Neighbour joins by cells: each point lies in one cell, each query looks into the cells around its own.

The range join is exact with cells as wide as the radius. The nearest-neighbour join goes by leaves (``leaves``); with groups it starts with cells that hold about k points each and doubles
the width for the queries that aren't settled: one is when it has k candidates no farther than a cell's width, as no nearer point can lie
outside the block. Once FEW queries or less are left, far-off ones mostly, these are sent to all points, which are then read once: each task
keeps the k nearest of what it has read. Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.functions.geometry import AXES, cell, inverted
from cloudloom.operators import leaves
from cloudloom.sources.shared import Workspace, saved


#: Queries that may be sent to all points: a bounded number, whatever the clouds' sizes.
FEW = 4096


def distance(axes: tuple[str, ...], left: str = "q", right: str = "p") -> Column:
    return F.sqrt(reduce(Column.__add__, [(F.col(f"{left}{a}") - F.col(f"{right}{a}")) * (F.col(f"{left}{a}") - F.col(f"{right}{a}")) for a in axes]))


def _sides(queries: DataFrame, points: DataFrame, axes: tuple[str, ...], by: list[str], width: float) -> DataFrame:
    """Pairs (by, qid, pid, d) of each query with the points of the cells around it."""
    left = queries.select(*by, F.col("point_id").alias("qid"), *[F.col(a).alias(f"q{a}") for a in axes], *[cell(F.col(a), width).alias(f"c{a}") for a in axes])
    for a in axes:
        left = left.withColumn(f"c{a}", F.explode(F.array(*[F.col(f"c{a}") + k for k in (-1, 0, 1)])))
    right = points.select(*by, F.col("point_id").alias("pid"), *[F.col(a).alias(f"p{a}") for a in axes], *[cell(F.col(a), width).alias(f"c{a}") for a in axes])
    return left.join(right, [*by, *[f"c{a}" for a in axes]]).select(*by, "qid", "pid", distance(axes).alias("d"))


def within(queries: DataFrame, points: DataFrame, radius: float, axes: tuple[str, ...] = AXES, by: list[str] | None = None) -> DataFrame:
    """All pairs (qid, pid, d) with d <= radius."""
    return _sides(queries, points, axes, by or [], radius).where(F.col("d") <= radius)


def capped(pairs: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The most nearest of each query, with their place from 1."""
    order = Window.partitionBy(*(by or []), "qid").orderBy("d", "pid")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def listed(queries: DataFrame, points: DataFrame, k: int, axes: tuple[str, ...] = AXES, radius: float | None = None, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, q*, pid, p*, d, place): as nearest, of points within radius if it is given, with columns of the query (keep) and of the point (carry)."""
    found = leaves.Leaves(points, k, axes, carry)
    return leaves.gathered(leaves.reaches(queries, found, radius, keep), found)


def nearest(queries: DataFrame, points: DataFrame, k: int, axes: tuple[str, ...] = AXES, by: list[str] | None = None) -> DataFrame:
    """(by, qid, pid, d, place): the k nearest points of each query, fewer where there are fewer; the point itself counts if it is among points."""
    by = by or []
    bounds = points.agg(F.count(F.lit(1)), *[f(a) for a in axes for f in (F.min, F.max)]).first()
    n = bounds[0]
    asked = queries.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    if not n or asked[0] is None:
        return _sides(queries, points, axes, by, 1.0).withColumn("place", F.lit(1)).limit(0)
    asking = queries.count() if len(axes) > 4 else queries.limit(FEW + 1).count()
    if asking <= FEW:
        return _sent(queries, points, k, axes, by)
    if len(axes) > 4:  # cells around a point are too many
        if not by:
            return _by_pivots(queries, points, k, axes, n)
        blocks = -(-asking // FEW)  # the queries are a stated set against all points, in blocks
        return reduce(DataFrame.unionByName, [_sent(queries.where(F.pmod(F.xxhash64("point_id"), F.lit(blocks)) == b), points, k, axes, by) for b in range(blocks)])
    if not by:
        return listed(queries, points, k, axes).select("qid", "pid", "d", "place")
    spans = [max(bounds[2 + 2 * i], asked[1 + 2 * i]) - min(bounds[1 + 2 * i], asked[2 * i]) for i in range(len(axes))]
    extents = [max(bounds[2 + 2 * i] - bounds[1 + 2 * i], 1e-9) for i in range(len(axes))]
    width = max((reduce(float.__mul__, map(float, extents), 1.0) * k / n) ** (1 / len(axes)), max(spans) / 2**20, 1e-9)
    left, parts = queries, []
    while True:
        last = width > max(spans)  # then a block holds everything
        found = capped(_sides(left, points, axes, by, width), k, by)
        if last:
            parts.append(found)
            break
        done = found.groupBy(*by, "qid").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).where((F.col("n") == k) & (F.col("far") <= width)).select(*by, "qid")
        good = saved(found.join(done, [*by, "qid"], "left_semi"))
        parts.append(good)
        ids = good.select(*by, F.col("qid").alias("point_id")).distinct()
        left = saved(left.join(ids, [*by, "point_id"], "left_anti"))
        many = left.limit(FEW + 1).count()
        if many <= FEW:
            parts += [_sent(left, points, k, axes, by)] * bool(many)
            break
        width *= 2
    return reduce(DataFrame.unionByName, parts)


def _sent(queries: DataFrame, points: DataFrame, k: int, axes: tuple[str, ...], by: list[str]) -> DataFrame:
    """The nearest points of up to FEW queries, which are sent to all points."""
    asked = queries.select(*by, F.col("point_id").alias("qid"), *axes).toPandas()
    groups = [(name if isinstance(name, tuple) else (name,), own["qid"].to_numpy(), own[list(axes)].to_numpy(float)) for name, own in (asked.groupby(by, dropna=True) if by else [((), asked)])]
    shared = queries.sparkSession.sparkContext.broadcast(groups)
    kept = points.select(*by, F.col("point_id").alias("pid"), *axes)
    schema = T.StructType([*[kept.schema[c] for c in by], T.StructField("qid", queries.schema["point_id"].dataType), T.StructField("pid", kept.schema["pid"].dataType), T.StructField("d", T.DoubleType())])

    def run(batches):
        best: dict[tuple, tuple] = {}
        for pdf in batches:
            for name, ids, at in shared.value:
                mine = np.ones(len(pdf), bool)
                for c, v in zip(by, name, strict=True):
                    mine &= (pdf[c] == v).to_numpy()
                own = pdf[mine]
                for start in range(0, len(own), 1024):
                    pids, where = own["pid"].to_numpy()[start : start + 1024], own[list(axes)].to_numpy(float)[start : start + 1024]
                    square = sum((at[:, None, i] - where[None, :, i]) * (at[:, None, i] - where[None, :, i]) for i in range(len(axes)))
                    d = np.sqrt(square)
                    q = np.repeat(np.arange(len(ids)), len(pids))
                    if len(pids) > k:
                        near = (d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]).ravel()
                    else:
                        near = np.ones(d.size, bool)
                    new = (q[near], np.tile(pids, len(ids))[near], d.ravel()[near])
                    old = best.get(name)
                    q, p, d = (np.concatenate(x) for x in zip(old, new, strict=True)) if old else new
                    order = np.lexsort((p, d, q))
                    q, p, d = q[order], p[order], d[order]
                    first = np.arange(len(q)) - np.searchsorted(q, q) < k
                    best[name] = (q[first], p[first], d[first])
        for name, ids, _ in shared.value:
            if name in best:
                q, p, d = best[name]
                yield pd.DataFrame({**dict(zip(by, name, strict=True)), "qid": ids[q], "pid": p, "d": d})

    return capped(kept.mapInPandas(run, schema), k, by)


#: Pivots of a join over many axes at most; they are sent to all tasks.
MOST_PIVOTS = 4096


def _by_pivots(queries: DataFrame, points: DataFrame, k: int, axes: tuple[str, ...], n: int) -> DataFrame:
    """The k nearest points of each query over many axes, exact by the triangle inequality.

    Each point lies in the part of its nearest pivot, a point of the cloud; there are about twice the root of n, MOST_PIVOTS at most. A query first looks into the part of its own nearest pivot
    for k points; their distance bounds how far it has to look, and so which parts, and which rings around their pivots, can hold a nearer one."""
    with Workspace(queries.sparkSession) as work:
        pairs = pivot_pairs(queries, points, k, axes, min(MOST_PIVOTS, max(1, int(2 * n**0.5))), work)
        return saved(capped(pairs.withColumn("d", distance(axes)).where(F.col("d") <= F.col("far")).select("qid", "pid", "d"), k))


def pivot_pairs(queries: DataFrame, points: DataFrame, k: int, axes: tuple[str, ...], pivots: int, work: Workspace) -> DataFrame:
    """(qid, q*, pid, p*, far): for each query the points that its bound (far) leaves, the k nearest among them."""
    spark, slack = queries.sparkSession, 1 + 1e-9
    chosen = points.orderBy(F.xxhash64("point_id"), "point_id").limit(pivots).select(*axes).toPandas().to_numpy(float)
    shared = spark.sparkContext.broadcast(chosen)
    names = {"q": [f"q{a}" for a in axes], "p": [f"p{a}" for a in axes]}

    def distances(at: np.ndarray) -> np.ndarray:
        """To all pivots."""
        return np.stack([np.sqrt(np.square(at - p).sum(axis=1)) for p in shared.value], axis=1) if len(at) else np.zeros((0, len(shared.value)))

    def placed(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 2048):
                own = pdf.iloc[start : start + 2048]
                d = distances(own[axes_of].to_numpy(float))
                yield own.assign(part=d.argmin(axis=1) if len(d) else np.zeros(0, int), gap=d.min(axis=1) if len(d) else np.zeros(0))

    def sided(cloud: DataFrame, side: str) -> DataFrame:
        return cloud.select(F.col("point_id").alias(f"{side}id"), *[F.col(a).cast("double").alias(f"{side}{a}") for a in axes])

    def numbered(side: DataFrame) -> DataFrame:
        return side.mapInPandas(placed, T.StructType([*side.schema.fields, T.StructField("part", T.LongType()), T.StructField("gap", T.DoubleType())]))

    axes_of = names["p"]
    held = work.keep(numbered(sided(points, "p")))
    axes_of = names["q"]
    asked = work.keep(numbered(sided(queries, "q")).withColumnRenamed("gap", "own"))
    sizes = {r["part"]: (r["n"], r["far"]) for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("far")).collect()}  # a row a pivot
    first = capped(asked.join(held, "part").select("qid", "pid", distance(axes).alias("d")), k)
    bounds = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("bound"))
    bounded = asked.drop("part", "own").join(bounds, "qid", "left")
    counts = np.array([sizes.get(i, (0, 0.0))[0] for i in range(len(chosen))])
    radii = np.array([sizes.get(i, (0, -np.inf))[1] for i in range(len(chosen))])
    limits = spark.sparkContext.broadcast((counts, radii))

    def looked(batches):
        counts, radii = limits.value
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                own = pdf.iloc[start : start + 512]
                d = distances(own[names["q"]].to_numpy(float))
                # Without k points in its own part: so many parts lie wholly within a distance that they hold k.
                whole = np.where(counts > 0, d + radii, np.inf)
                order = np.argsort(whole, axis=1)
                enough = np.cumsum(counts[order], axis=1) >= k
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
                reach = np.where(at >= 0, np.take_along_axis(whole, np.take_along_axis(order, np.maximum(at, 0)[:, None], axis=1), axis=1)[:, 0], np.inf)
                far = np.fmin(own["bound"].to_numpy(float), reach) * slack
                row, part = np.nonzero((d - radii <= far[:, None]) & (counts > 0))
                yield own.drop(columns="bound").iloc[row].assign(part=part, away=d[row, part], far=far[row])

    schema = T.StructType([*asked.drop("part", "own").schema.fields, T.StructField("part", T.LongType()), T.StructField("away", T.DoubleType()), T.StructField("far", T.DoubleType())])
    near = bounded.mapInPandas(looked, schema)
    tolerance = F.col("far") + F.abs(F.col("away")) * 1e-9
    return near.join(held, "part").where(F.abs(F.col("gap") - F.col("away")) <= tolerance).drop("part", "away", "gap")


def exact_matches(cloud: DataFrame, other: DataFrame) -> DataFrame:
    """(point_id, match_id): for each point of other at exactly equal coordinates the smallest id of cloud."""
    first = cloud.groupBy(*AXES).agg(F.min("point_id").alias("match_id"))
    return other.select("point_id", *AXES).join(first, list(AXES)).select("point_id", "match_id")


def remove_nearest(cloud: DataFrame, leftovers: DataFrame) -> DataFrame:
    """cloud without the point nearest to each leftover."""
    gone = nearest(leftovers, cloud, 1).select(F.col("pid").alias("point_id")).distinct()
    return cloud.join(gone, "point_id", "left_anti")


def majority(queries: DataFrame, colored: DataFrame, k: int) -> DataFrame:
    """(point_id, color): the colour most of a query's k nearest have; of equal ones the first of red, green, black, white."""
    votes = listed(queries, colored, k, carry=("color",))
    names = ["red", "green", "black", "white"]
    counted = votes.groupBy("qid").agg(*[F.count_if(F.col("pcolor") == c).alias(c) for c in names])
    top = F.greatest(*names)
    return counted.select(F.col("qid").alias("point_id"), F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in names]).alias("color"))


def height_masks(cloud: DataFrame, size: float = 0.5, k: int = 128, k_black: int = 12) -> DataFrame:
    """(point_id, color): the top of each XY cell red, its bottom green, both black, the rest white; then twice a majority: of k
    nearest for all points, and of the k_black nearest points that aren't black for those that then are."""
    from cloudloom.operators.voxel import column_extrema

    cells = column_extrema(cloud, size)
    top, bottom = cells.select(F.col("max_id").alias("point_id")).withColumn("top", F.lit(True)), cells.select(F.col("min_id").alias("point_id")).withColumn("bottom", F.lit(True))
    marked = cloud.select("point_id", *AXES).join(top, "point_id", "left").join(bottom, "point_id", "left")
    color = F.when(F.col("top") & F.col("bottom"), "black").when(F.col("top"), "red").when(F.col("bottom"), "green").otherwise("white")
    first = saved(marked.select("point_id", *AXES, color.alias("color")))
    second = saved(majority(first, first, k).join(first.drop("color"), "point_id"))
    black = second.where("color = 'black'")
    third = majority(black, second.where("color <> 'black'"), k_black).withColumnRenamed("color", "better")
    return second.join(third, "point_id", "left").select("point_id", F.coalesce("better", "color").alias("color"))


def inconsistent(masks: DataFrame) -> DataFrame:
    """Points of the top that face down, or of the bottom that face up: red without blue and black without green, or the reverse."""
    return masks.where("(red AND NOT blue AND black AND NOT green) OR (blue AND NOT red AND green AND NOT black)")


def corrected_normals(cloud: DataFrame, marked: DataFrame, k: int = 10) -> DataFrame:
    """cloud with flipped, and its normals turned round once where that holds: for the marked points, and for those of their k nearest others that disagree with a turned one in a sign."""
    names = ("nx", "ny", "nz")
    own = cloud.join(marked.select("point_id").distinct(), "point_id", "left_semi")
    near = nearest(own, cloud, k + 1).where("qid <> pid")
    left = own.select(F.col("point_id").alias("qid"), *[(-F.col(c)).alias(f"q{c}") for c in names])
    right = cloud.join(own.select("point_id"), "point_id", "left_anti").select(F.col("point_id").alias("pid"), *names)
    differs = near.join(left, "qid").join(right, "pid").where(" OR ".join(f"signum({c}) <> signum(q{c})" for c in names)).select(F.col("pid").alias("point_id"))
    turned = differs.union(own.select("point_id")).distinct().withColumn("flipped", F.lit(True))
    return inverted(cloud.join(turned, "point_id", "left").withColumn("flipped", F.coalesce("flipped", F.lit(False))), F.col("flipped"))
