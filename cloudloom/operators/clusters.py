"""Density clusters, their filters, the distance knee and k-means steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.geometry import AXES, cell
from cloudloom.operators.neighbors import nearest, within
from cloudloom.sources.shared import Workspace, forget, saved, shared_folder


def components(edges: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Links (a, b) to (node, root), root being the smallest node of the component: alternating large-star and small-star steps until nothing moves.

    The result reads a table in the shared folder; work, if given, deletes it.
    """
    spark = edges.sparkSession

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = both.join(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            lower = joined.where("b <= a")
            out = lower.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
        folder = shared_folder(spark)
        edges = saved(edges, folder)
        return edges, folder, tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # Each link from its larger to its smaller end, as a round leaves them: a star that points at its root is settled at once.
    edges, folder, state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while state[0]:
        after, at, now = written(star(star(edges, True), False))
        forget(spark, folder)
        same, edges, folder, state = now == state, after, at, now
        if same:
            break
    if work is not None:
        work.folders.append(folder)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def ranked(df: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """df with rank from start on in the given order: range partitions are numbered by themselves and moved by the sizes of those before."""
    parts = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("s").join(sizes.select(F.col("_part").alias("_p"), F.col("_n").alias("_m")), F.col("_p") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))  # as many rows as partitions
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn("rank", (inside + F.col("_before") - 1 + start).cast("long")).drop("_part", "_before")


#: Rows that two boxes of points may make when they are compared point by point, and levels that boxes are halved at most.
FEW_PAIRS, MOST_LEVELS = 1024, 24


def dbscan(cloud: DataFrame, eps: float, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """cloud with label: the clusters numbered by their smallest core point, -1 for noise; a border point gets its smallest cluster. Points of different groups (by) aren't neighbours.

    Points lie in cells so small that those of one cell are neighbours. A cell of least points or more has core points only; others are counted for the rest alone, and a
    point in a crowded cell is never paired with that cell's others. Clusters are components of cells (linked_cells). Pairs that the rest makes are counted as they come, not kept."""
    by = by or []
    with Workspace(cloud.sparkSession) as work:
        width = eps / 3**0.5 * (1 - 1e-9)
        cells = [f"_c{a}" for a in AXES]
        points = work.keep(cloud.select(*by, "point_id", *AXES, *[cell(F.col(a), width).alias(c) for a, c in zip(AXES, cells, strict=True)]))
        crowded = points.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
        thin = work.keep(points.join(crowded, [*by, *cells], "left_anti"))
        own_id = [*by, "point_id"]  # a point may lie in several groups
        some = within(thin, points, eps, by=by).groupBy(*by, F.col("qid").alias("point_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
        core = work.keep(points.join(crowded, [*by, *cells], "left_semi").unionByName(thin.join(some, own_id, "left_semi").select(points.columns)))
        named = work.keep(core.groupBy(*by, *cells).agg(F.min("point_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
        core = work.keep(core.join(named.drop("first"), [*by, *cells]))
        found = components(linked_cells(core, eps, width, by, work), work)
        roots = work.keep(named.select("node", "first").join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
        numbers = ranked(roots.groupBy("root").agg(F.min("first").alias("first")), ["first", "root"])
        clustered = work.keep(core.join(roots.select("node", "root").join(numbers, "root").select("node", F.col("rank").alias("own")), "node").select(*own_id, *AXES, "own"))
        rest = thin.join(clustered.select(own_id), own_id, "left_anti")
        border = within(rest, clustered, eps, by=by).join(clustered.select(*by, F.col("point_id").alias("pid"), "own"), [*by, "pid"]).groupBy(*by, F.col("qid").alias("point_id")).agg(F.min("own").alias("own"))
        labels = saved(clustered.select(*own_id, "own").unionByName(border))
    return cloud.drop("label").join(labels, own_id, "left").withColumn("label", F.coalesce("own", F.lit(-1)).cast("int")).drop("own")


def linked_cells(core: DataFrame, eps: float, width: float, by: list[str], work: Workspace) -> DataFrame:
    """Links (a, b) between the cells (node, _cx, _cy, _cz) of core points that hold two within eps of each other.

    Boxes around the points decide for most cells: all of two boxes is near, or nothing is. Where they can't, the boxes are halved along each axis, as often as needed, until they
    decide or hold few points, which are compared. So two crowded cells make a few boxes' pairs, whatever the number of their points."""
    cells = [f"_c{a}" for a in AXES]

    def boxes(level: int) -> DataFrame:
        keys = [F.floor((F.col(a) - F.col(c) * width) / width * 2**level).alias(f"k{a}") for a, c in zip(AXES, cells, strict=True)]
        return core.groupBy("node", *by, *cells, *keys).agg(F.count(F.lit(1)).alias("m"), *[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])

    def sides(level: int) -> tuple[DataFrame, DataFrame]:
        found = work.keep(boxes(level))
        return tuple(found.withColumnsRenamed({c: f"{c}_{side}" for c in found.columns if c[0] in "klhm" and c not in by} | {"node": side}) for side in "ab")

    def near() -> Column:
        gap = [F.greatest(F.col(f"lo{a}_b") - F.col(f"hi{a}_a"), F.col(f"lo{a}_a") - F.col(f"hi{a}_b"), F.lit(0.0)) for a in AXES]
        return F.sqrt(sum((g * g for g in gap), F.lit(0.0)))

    def far() -> Column:
        span = [F.greatest(F.col(f"hi{a}_b") - F.col(f"lo{a}_a"), F.col(f"hi{a}_a") - F.col(f"lo{a}_b")) for a in AXES]
        return F.sqrt(sum((g * g for g in span), F.lit(0.0)))

    kept = ["a", "b", *[f"k{a}_{side}" for side in "ab" for a in AXES], "m_a", "m_b", near().alias("near"), far().alias("far")]
    # Each pair of cells once: offsets with a positive first number that isn't 0.
    steps = [(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if (x, y, z) > (0, 0, 0)]
    left, right = sides(0)
    spread = left.select("*", F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{a}") for v, a in zip(s, AXES, strict=True)]) for s in steps])).alias("step"))
    spread = spread.withColumns({c: F.col(c) + F.col(f"step.s{a}") for c, a in zip(cells, AXES, strict=True)}).drop("step")
    pairs = spread.join(right, [*by, *cells]).select(*kept)
    links, level = [], 0
    while True:
        pairs = work.keep(pairs.where(F.col("near") <= eps * (1 + 1e-9)))
        sure = work.keep(pairs.where(F.col("far") <= eps * (1 - 1e-9)).select("a", "b").distinct())
        open_ = pairs.join(sure, ["a", "b"], "left_anti")
        small = (F.col("m_a") * F.col("m_b") <= FEW_PAIRS) | F.lit(level >= MOST_LEVELS)
        keyed = [core.select(F.col("node").alias(side), *[F.col(a).alias(f"{a}_{side}") for a in AXES], *[F.floor((F.col(a) - F.col(c) * width) / width * 2**level).alias(f"k{a}_{side}") for a, c in zip(AXES, cells, strict=True)]) for side in "ab"]
        met = open_.where(small)
        for side, rows in zip("ab", keyed, strict=True):
            met = met.join(rows, [side, *[f"k{a}_{side}" for a in AXES]])
        square = sum(((F.col(f"{a}_a") - F.col(f"{a}_b")) * (F.col(f"{a}_a") - F.col(f"{a}_b")) for a in AXES), F.lit(0.0))
        found = work.keep(met.where(F.sqrt(square) <= eps).select("a", "b").distinct())
        links += [sure, found]
        open_ = work.keep(open_.where(~small).join(found, ["a", "b"], "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, links).distinct()
        level += 1
        left, right = sides(level)
        above = open_.select("a", "b", *[F.col(f"k{a}_{side}").alias(f"p{a}_{side}") for side in "ab" for a in AXES])
        for side, rows in (("a", left), ("b", right)):
            own = rows.select(side, *[c for c in rows.columns if c.endswith(f"_{side}")], *[F.floor(F.col(f"k{a}_{side}") / 2).alias(f"p{a}_{side}") for a in AXES])
            above = above.join(own, [side, *[f"p{a}_{side}" for a in AXES]])
        pairs = above.select(*kept)


def cluster_sizes(cloud: DataFrame) -> DataFrame:
    return cloud.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def filter_by_size(cloud: DataFrame, least: int = 5) -> DataFrame:
    """Points of clusters of least points or more; counts are made before the join, so a large cluster is no one task's load."""
    return cloud.join(cluster_sizes(cloud).where(F.col("n") >= least).select("label"), "label", "left_semi")


def covariance(cloud: DataFrame, by: str = "segment_id") -> DataFrame:
    """Mean and sample covariance of each group."""
    cov = [F.covar_samp(a, b).alias(f"c{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    return cloud.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES], *cov)


def aspects(cloud: DataFrame, by: str = "label") -> DataFrame:
    """(by, aspect): the largest over the second extent of each group's box along its principal axes; infinite where the second is 0."""
    from cloudloom.operators.raster import principal_axes, to_axes

    own = cloud.select(F.col(by).cast("int").alias("segment_id"), *AXES)
    turned = to_axes(own, principal_axes(own))
    extents = turned.groupBy("segment_id").agg(F.sort_array(F.array(*[F.max(a) - F.min(a) for a in AXES]), asc=False).alias("e"))
    return extents.select(F.col("segment_id").cast(cloud.schema[by].dataType).alias(by), F.when(F.get("e", F.lit(1)) > 0, F.get("e", F.lit(0)) / F.get("e", F.lit(1))).otherwise(float("inf")).alias("aspect"))


def filter_by_aspect(cloud: DataFrame, least: float = 0.0, most: float = float("inf"), by: str = "label") -> DataFrame:
    """Points of groups whose aspect lies between least and most, both included."""
    return cloud.join(aspects(cloud, by).where(F.col("aspect").between(least, most)).select(by), by, "left_semi")


def similarity(cloud: DataFrame, by: str = "label", aspect: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs of different clusters, by the Frobenius distance of their covariances and, if aspects (by, aspect) are given, the difference of these.

    A row for each pair is the result itself; clusters are what is left of a cloud after clustering, and few."""
    own = covariance(cloud, by)
    own = own.withColumn("aspect", F.lit(0.0)) if aspect is None else own.join(aspect, by)
    cov = own.select(F.col(by).alias("a"), "aspect", *[f"c{x}{y}" for i, x in enumerate(AXES) for y in AXES[i:]])
    other = cov.select(*[F.col(c).alias("b" if c == "a" else f"o{c}") for c in cov.columns])
    square = sum((F.lit(1.0 if x == y else 2.0) * (F.col(f"c{x}{y}") - F.col(f"oc{x}{y}")) * (F.col(f"c{x}{y}") - F.col(f"oc{x}{y}")) for i, x in enumerate(AXES) for y in AXES[i:]), F.lit(0.0))
    apart = F.when(F.col("aspect") == F.col("oaspect"), 0.0).otherwise(F.abs(F.col("aspect") - F.col("oaspect")))
    return cov.join(other, F.col("a") != F.col("b")).select("a", "b", (1 / (F.sqrt(square) + apart + 1e-5)).alias("similarity"))


def grouped(cloud: DataFrame, k: int = 4, by: str = "label") -> DataFrame:
    """cloud with group_label: its clusters in k spectral groups by their similarity, numbered by their smallest cluster; -1 for noise."""
    from cloudloom.operators.spectral import groups

    found = cloud.where(F.col(by) >= 0)
    links = saved(similarity(found, by, aspects(found, by)).where("a < b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("similarity").alias("weight")))
    if links.isEmpty():
        return cloud.withColumn("group_label", F.when(F.col(by) >= 0, 0).otherwise(-1))
    named = saved(groups(links, k))
    firsts = named.groupBy("label").agg(F.min("node").alias("first"))
    numbers = named.join(ranked(firsts, ["first"]), "label").select(F.col("node").cast(cloud.schema[by].dataType).alias(by), F.col("rank").cast("int").alias("group_label"))
    return cloud.join(numbers, by, "left").withColumn("group_label", F.coalesce("group_label", F.lit(-1)))


def k_distance(cloud: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, rank, d): every point's distance to its nearest other point, ascending, in each group of by."""
    by = by or []
    two = nearest(cloud, cloud, 2, by=by).where("place = 2").select(*by, "d", "qid")
    curve = ranked(two, [*by, "d", "qid"])
    if by:  # ranks go through all groups; each group's own start at its first
        curve = saved(curve)
        curve = curve.join(curve.groupBy(*by).agg(F.min("rank").alias("_first")), by).withColumn("rank", F.col("rank") - F.col("_first"))
    return curve.select(*by, "rank", "d")


def _blocks(curve: DataFrame, reach: int, by: list[str], size: int = 100_000) -> tuple[DataFrame, Window]:
    """The curves in blocks of ranks, each with the rows that reach into it from its neighbours, so windows need no single task."""
    at = F.floor(F.col("rank") / size)
    near = F.array_distinct(F.array(F.floor((F.col("rank") - reach) / size), at, F.floor((F.col("rank") + reach) / size)))
    return curve.withColumn("home", at).withColumn("block", F.explode(near)), Window.partitionBy(*by, "block").orderBy("rank")


def gradient(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, rank, d, slope): central differences, and three-point ones at both ends."""
    by = by or []
    wide, w = _blocks(curve, 2, by)
    d = lambda k: F.lag("d", -k).over(w) if k < 0 else F.lead("d", k).over(w) if k else F.col("d")
    back = lambda k: F.lag("d", k).over(w)
    first = (-3 * d(0) + 4 * d(1) - d(2)) / 2
    last = (3 * d(0) - 4 * back(1) + back(2)) / 2
    out = wide.withColumn("slope", F.coalesce((d(1) - back(1)) / 2, F.when(back(1).isNull(), first), last)).where("block = home")
    return out.select(*by, "rank", "d", "slope")


def smoothed(slopes: DataFrame, half: int = 25, by: list[str] | None = None) -> DataFrame:
    """(by, rank, d, slope, smooth): the cubic Savitzky-Golay mean of 2 * half + 1 slopes; null where fewer stand around."""
    by = by or []
    n = 2 * half + 1
    s2, s4 = 2 * sum(k**2 for k in range(1, half + 1)), 2 * sum(k**4 for k in range(1, half + 1))
    weight = lambda k: (s4 - s2 * k * k) / (n * s4 - s2 * s2)
    wide, w = _blocks(slopes, half, by)
    around = F.collect_list("slope").over(w.rowsBetween(-half, half))
    weights = F.array(*[F.lit(weight(k)) for k in range(-half, half + 1)])
    total = F.aggregate(F.zip_with("around", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    out = wide.withColumn("around", around).where("block = home").withColumn("smooth", F.when(F.size("around") == n, total))
    return out.select(*by, "rank", "d", "slope", "smooth")


def epsilon(cloud: DataFrame, start: int = 5000, threshold: float = 5e-5, by: list[str] | None = None) -> DataFrame:
    """(by, eps): the distance at the first rank from start on whose smoothed slope is over the threshold. One row, null if there is none; with by a row for each group that has one."""
    curve = smoothed(gradient(k_distance(cloud, by), by), by=by)
    over = curve.where((F.col("rank") >= start) & (F.col("smooth") > threshold))
    return (over.groupBy(*by) if by else over).agg(F.min_by("d", "rank").alias("eps"))


def assign(cloud: DataFrame, centers: list[tuple[float, ...]], columns: tuple[str, ...]) -> DataFrame:
    """cloud with label: the nearest centre, of equal ones the first."""
    distances = [sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, center, strict=True)), F.lit(0.0)) for center in centers]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(distances)]))
    return cloud.withColumn("label", best.getField("k"))


def update(labelled: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """label, n and the mean of each cluster."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def kmeans(cloud: DataFrame, k: int, columns: tuple[str, ...], most_rounds: int = 30) -> DataFrame:
    """cloud with label: Lloyd's rounds from centres chosen farthest first, from the smallest point_id on. Only k centres come to the driver."""
    rows = saved(cloud)
    centers = [tuple(rows.agg(F.min_by(F.struct(*columns), "point_id")).first()[0] or ())]
    if not centers[0]:
        return rows.withColumn("label", F.lit(0))
    while len(centers) < k:
        near = F.least(*[sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(columns, m, strict=True)), F.lit(0.0)) for m in centers], F.lit(float("inf")))
        centers.append(tuple(rows.agg(F.max_by(F.struct(*columns), F.struct(near, -F.col("point_id")))).first()[0]))
    for _ in range(most_rounds):
        found = {r["label"]: tuple(r[c] for c in columns) for r in update(assign(rows, centers, columns), columns).collect()}
        moved = [found.get(i, m) for i, m in enumerate(centers)]
        if moved == centers:
            break
        centers = moved
    return assign(rows, centers, columns)


def segment(cloud: DataFrame, k: int = 4, eps: float | None = None, least: int = 2000, more: float = 0.25, start: int = 5000, threshold: float = 5e-5) -> DataFrame:
    """cloud with part and segment_id: k-means on normals, density clusters inside each of its k parts, and of these the ones of least points or more.

    Without an eps each part has its own, its knee and more; a part without a knee has no clusters. Segments are numbered by their smallest point."""
    parts = saved(kmeans(cloud, k, ("nx", "ny", "nz")).withColumnRenamed("label", "part"))
    if eps is not None:
        return filter_by_size(dbscan(parts, eps, by=["part"]), least).withColumnRenamed("label", "segment_id")
    return filter_by_size(knee_clusters(parts, "part", more, start, threshold), least).withColumnRenamed("label", "segment_id")


def knee_clusters(cloud: DataFrame, by: str, more: float, start: int, threshold: float) -> DataFrame:
    """cloud with label: density clusters inside each group of by, each with its knee and more as eps; -1 for noise and for groups without a knee. Numbered through all groups by their smallest point.

    All groups are clustered at once: each group's places are measured in its own eps."""
    knees = epsilon(cloud, start, threshold, [by]).select(by, (F.col("eps") + more).alias("_eps"))
    rows = saved(cloud.drop("label").join(knees, by, "left"))
    own = dbscan(rows.where("_eps > 0").select(by, "point_id", *[(F.col(a) / F.col("_eps")).alias(a) for a in AXES]), 1.0, by=[by])
    found = saved(own.where("label >= 0").select(by, "point_id", F.col("label").alias("_label")))
    numbers = ranked(found.groupBy("_label").agg(F.min("point_id").alias("first")), ["first"]).select("_label", F.col("rank").cast("int").alias("number"))
    labels = found.join(numbers, "_label").select(by, "point_id", "number")
    return rows.join(labels, [by, "point_id"], "left").withColumn("label", F.coalesce("number", F.lit(-1))).drop("number", "_eps")


def extreme_clusters(cloud: DataFrame) -> DataFrame:
    """One row: the clusters that hold the highest and the lowest point."""
    return cloud.agg(F.max_by("label", F.struct(F.col("z"), -F.col("point_id"))).alias("max_label"), F.min_by("label", F.struct("z", "point_id")).alias("min_label"))


def brightest(cloud: DataFrame) -> DataFrame:
    """One row: the cluster with the largest mean of r + g + b, of equal ones the smallest."""
    light = cloud.groupBy("label").agg(F.round(F.avg("r") + F.avg("g") + F.avg("b"), 9).alias("light"), *[F.avg(c).alias(c) for c in "rgb"])
    return light.agg(F.max_by("label", F.struct(F.col("light"), -F.col("label"))).alias("label"), F.max("light").alias("light"))


def adaptive(cloud: DataFrame, keys: list[Column], c: float) -> DataFrame:
    """Points of which any channel reaches its cell's threshold, the mean of all rounded channels less c. Means are made before the join, so cells of any size spread."""
    level = {x: F.bround(F.col(x) * 255, 0) for x in "rgb"}
    named = cloud.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    names = [f"_k{i}" for i in range(len(keys))]
    cut = named.groupBy(*names).agg((F.avg((level["r"] + level["g"] + level["b"]) / 3) - c).alias("_cut"))
    kept = named.join(cut, names).where(F.greatest(*level.values()) >= F.round("_cut", 9))
    return kept.drop(*names, "_cut")
