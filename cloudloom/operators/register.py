"""Rigid registration: normals, descriptors and their matches, RANSAC in batches, point-to-plane steps as one aggregate each, and their control over several scales."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.geometry import AXES, affine
from cloudloom.operators import leaves, voxel
from cloudloom.operators.clusters import ranked
from cloudloom.operators.neighbors import capped, listed, nearest, within
from cloudloom.sources.shared import saved


def normals(cloud: DataFrame, radius: float, most: int = 30) -> DataFrame:
    """cloud with nx, ny, nz: the direction of least variance of up to most neighbours within radius, upwards; (0, 0, 1) with fewer than three."""
    near = listed(cloud, cloud, most, radius=radius, carry=AXES)
    cov = near.groupBy(F.col("qid").alias("point_id")).agg(F.count(F.lit(1)).alias("k"), *[F.covar_pop(f"p{a}", f"p{b}").alias(f"c{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]])

    def solve(batches):
        for pdf in batches:
            m = pdf[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy().reshape(-1, 3, 3)
            n = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
            n = np.where(n[:, 2:] < 0, -n, n)
            n[pdf["k"].to_numpy() < 3] = (0.0, 0.0, 1.0)
            yield pd.DataFrame({"point_id": pdf["point_id"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})

    return cloud.drop("nx", "ny", "nz").join(cov.mapInPandas(solve, "point_id long, nx double, ny double, nz double"), "point_id")


def correspondences(source: DataFrame, target: DataFrame, threshold: float) -> DataFrame:
    """(s*, t*, n*): each source point with its nearest target point within the threshold."""
    best = capped(within(source, target, threshold), 1)
    s = source.select(F.col("point_id").alias("qid"), *[F.col(a).alias(f"s{a}") for a in AXES])
    t = target.select(F.col("point_id").alias("pid"), *[F.col(a).alias(f"t{a}") for a in AXES], *[F.col(f"n{a}") for a in AXES])
    return best.join(s, "qid").join(t, "pid")


def normal_equations(pairs: DataFrame) -> DataFrame:
    """One row: n, the squared error, the 21 sums of J'J (a00 to a55) and the 6 of J'e (b0 to b5)."""
    j = [F.col("sy") * F.col("nz") - F.col("sz") * F.col("ny"), F.col("sz") * F.col("nx") - F.col("sx") * F.col("nz"), F.col("sx") * F.col("ny") - F.col("sy") * F.col("nx"), F.col("nx"), F.col("ny"), F.col("nz")]
    e = sum(((F.col(f"s{a}") - F.col(f"t{a}")) * F.col(f"n{a}") for a in AXES), F.lit(0.0))
    rows = pairs.select(*[c.alias(f"j{i}") for i, c in enumerate(j)], e.alias("e"))
    sums = [F.sum(F.col(f"j{i}") * F.col(f"j{k}")).alias(f"a{i}{k}") for i in range(6) for k in range(i, 6)]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("squares"), *sums, *[F.sum(F.col(f"j{i}") * F.col("e")).alias(f"b{i}") for i in range(6)])


def icp(source: DataFrame, target: DataFrame, threshold: float, rounds: int = 30, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(4 x 4 transform, fitness): point-to-plane rounds; a round is a join and one aggregate, and the 6 x 6 system is solved on the driver."""
    total, matrix, fitness = source.count(), np.eye(4) if start is None else np.array(start, float), 0.0
    target = saved(target)
    for _ in range(rounds):
        moved = affine(source, matrix.tolist())
        row = normal_equations(correspondences(moved, target, threshold)).first()
        fitness = row["n"] / max(total, 1)
        if row["n"] < 6:
            break
        a = np.zeros((6, 6))
        for i in range(6):
            for k in range(i, 6):
                a[i, k] = a[k, i] = row[f"a{i}{k}"]
        x = np.linalg.lstsq(a, -np.array([row[f"b{i}"] for i in range(6)]), rcond=None)[0]
        step = np.eye(4)
        angle = np.linalg.norm(x[:3])
        if angle > 0:
            u = x[:3] / angle
            cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
            step[:3, :3] = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        step[:3, 3] = x[3:]
        matrix = step @ matrix
        if np.abs(x).max() < 1e-10:
            break
    return matrix, fitness


def rigid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rigid 4 x 4 transform that best takes points a to b."""
    ca, cb = a.mean(axis=0), b.mean(axis=0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    out = np.eye(4)
    out[:3, :3] = vt.T @ d @ u.T
    out[:3, 3] = cb - out[:3, :3] @ ca
    return out


def ransac(pairs: DataFrame, threshold: float, tries: int = 100_000, seed: int = 0, edge: float = 0.9, confidence: float = 0.999, batch: int = 2000) -> DataFrame:
    """Attempts (attempt, inliers, transform), best first: each draws three of the pairs (pair_id from 0, s*, t*), and counts the pairs that its transform fits.

    A triple is dropped if an edge of it is shorter than edge times the other side's, or if its own transform misses one of its pairs. The triples are drawn by
    number, so a join brings their points. Attempts go in batches, of which every task gets the transforms and counts over its part of the pairs; no more follow
    once the share of inliers makes it as sure as confidence that some triple was free of wrong pairs."""
    spark = pairs.sparkSession
    names = [f"{s}{a}" for s in "st" for a in AXES]
    pairs = saved(pairs.select("pair_id", *names))
    n = pairs.count()
    if n < 3:
        return spark.createDataFrame([], "attempt long, inliers long, transform array<array<double>>")

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                p = np.array([[q[c] for c in names] for q in r.points])
                a, b = p[:, :3], p[:, 3:]
                la, lb = (np.linalg.norm(x - np.roll(x, 1, axis=0), axis=1) for x in (a, b))
                if np.all(la >= edge * lb) and np.all(lb >= edge * la) and la.min() > 1e-9:
                    m = rigid(a, b)
                    if np.linalg.norm(a @ m[:3, :3].T + m[:3, 3] - b, axis=1).max() <= threshold:
                        out.append((r.attempt, m.tolist()))
            yield pd.DataFrame(out, columns=["attempt", "transform"])

    rated, done = [], 0
    while done < tries:
        size = min(batch, tries - done)
        draw = spark.range(done, done + size).select(F.col("id").alias("attempt"), F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)) for k in range(3)])).alias("pair_id"))
        triples = draw.join(pairs, "pair_id").groupBy("attempt").agg(F.array_sort(F.collect_set(F.struct("pair_id", *names))).alias("points")).where(F.size("points") == 3)
        found = saved(triples.mapInPandas(solve, "attempt long, transform array<array<double>>"))
        done += size
        rated.append(saved(_counted(pairs, found, names, threshold)))
        best = rated[-1].agg(F.max("inliers")).first()[0] or 0
        share = (best / n) ** 3
        if share >= 1 or share > 0 and done >= np.log(1 - confidence) / np.log(1 - share):
            break
    return reduce(DataFrame.unionByName, rated).orderBy(F.desc("inliers"), "attempt")


def _counted(pairs: DataFrame, found: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """found (at most a batch of attempts, so they may be sent to all tasks) with the number of pairs that each transform fits."""
    rows = found.collect()
    ids, matrices = [r["attempt"] for r in rows], np.array([r["transform"] for r in rows], float).reshape(-1, 4, 4)
    shared = pairs.sparkSession.sparkContext.broadcast(matrices)

    def count(batches):
        total = np.zeros(len(shared.value), np.int64)
        for pdf in batches:
            p = pdf[names].to_numpy(float)
            for k, m in enumerate(shared.value):
                off = p[:, :3] @ m[:3, :3].T + m[:3, 3] - p[:, 3:]
                total[k] += int((np.einsum("ij,ij->i", off, off) <= threshold * threshold).sum())
        yield pd.DataFrame({"attempt": ids, "n": total})

    counts = pairs.mapInPandas(count, "attempt long, n long").groupBy("attempt").agg(F.sum("n").alias("inliers"))
    return found.join(counts, "attempt").select("attempt", "inliers", "transform")


#: Histogram bins of each of the three angles.
BINS = 11


def fpfh(cloud: DataFrame, radius: float, most: int = 100) -> DataFrame:
    """cloud (with normals) with f0 to f32: fast point feature histograms of up to most neighbours within radius, the point itself among them.

    A pair's frame stands on the end whose normal is nearer to the line between them; three angles fall into 11 bins each. A point's
    own histogram, in percent, is added to the sum of its neighbours' ones over their squared distance, brought to 100 for each angle. A point without
    neighbours has zeros."""
    used = (*AXES, *[f"n{a}" for a in AXES])
    held = leaves.Leaves(cloud, most, AXES, used)
    asked = leaves.reaches(cloud, held, radius, used)
    dot = lambda a, b: sum((F.col(f"{a}{x}") * F.col(f"{b}{x}") for x in AXES[1:]), F.col(f"{a}x") * F.col(f"{b}x"))
    cross = lambda a, b: {x: F.col(f"{a}{y}") * F.col(f"{b}{z}") - F.col(f"{a}{z}") * F.col(f"{b}{y}") for x, y, z in ("xyz", "yzx", "zxy")}
    near = leaves.gathered(asked, held).where("qid <> pid").withColumnsRenamed({f"{s}n{a}": f"{t}{a}" for s, t in ("qm", "po") for a in AXES})
    pairs = near.withColumns({f"e{a}": F.col(f"p{a}") - F.col(f"q{a}") for a in AXES})
    pairs = pairs.withColumns({"c1": dot("m", "e") / F.col("d"), "c2": dot("o", "e") / F.col("d")}).withColumn("turned", F.abs("c1") < F.abs("c2"))
    choose = lambda a, b: F.when(F.col("turned"), a).otherwise(b)
    pairs = pairs.withColumns({f"{t}{a}": choose(F.col(f"{x}{a}") * k, F.col(f"{y}{a}")) for t, x, y, k in (("n", "o", "m", 1), ("l", "m", "o", 1), ("g", "e", "e", -1)) for a in AXES})
    pairs = pairs.withColumns({f"v{a}": c for a, c in cross("g", "n").items()}).withColumn("vn", F.sqrt(dot("v", "v")))
    pairs = pairs.withColumns({f"v{a}": F.col(f"v{a}") / F.col("vn") for a in AXES})
    pairs = pairs.withColumns({f"w{a}": c for a, c in cross("n", "v").items()})
    # Where the frame isn't defined all three angles count as 0.
    flat = (F.col("d") == 0) | (F.col("vn") == 0)
    angles = [(F.atan2(dot("w", "l"), dot("n", "l")) + np.pi) / (2 * np.pi), (dot("v", "l") + 1) / 2, (choose(-F.col("c2"), F.col("c1")) + 1) / 2]
    bins = [F.least(F.greatest(F.floor(BINS * F.when(flat, 0.5).otherwise(x)), F.lit(0)), F.lit(BINS - 1)).alias(f"b{i}") for i, x in enumerate(angles)]
    # Pairs are never written: a point's counts are, and its neighbours are looked up once more to add theirs.
    counts = F.array(*[F.count_if(F.col(f"b{i // BINS}") == i % BINS).cast("int") for i in range(3 * BINS)])
    counted = saved(pairs.select("qid", *bins).groupBy("qid").agg(counts.alias("counts"), F.count(F.lit(1)).alias("n")))
    columns = [f"f{i}" for i in range(3 * BINS)]
    percent = lambda i: F.get("counts", F.lit(i)) * 100 / F.col("n")
    own = counted.select("qid", *[percent(i).alias(c) for i, c in enumerate(columns)])
    again = leaves.gathered(asked.drop(*[f"q{c}" for c in used]), held.carrying(counted.withColumnRenamed("qid", "pid")))
    weighted = again.where("qid <> pid AND d > 0 AND n IS NOT NULL").withColumn("weight", 1 / (F.col("d") * F.col("d")))
    sums = weighted.groupBy("qid").agg(*[F.sum(percent(i) * F.col("weight")).alias(f"s{c}") for i, c in enumerate(columns)])
    third = lambda i: sum((F.col(f"sf{j}") for j in range(i // BINS * BINS + 1, i // BINS * BINS + BINS)), F.col(f"sf{i // BINS * BINS}"))
    both = own.join(sums, "qid", "left").select(F.col("qid").alias("point_id"), *[(F.col(c) + F.coalesce(F.try_divide(F.col(f"s{c}") * 100, third(i)), F.lit(0.0))).alias(c) for i, c in enumerate(columns)])
    return cloud.join(both, "point_id", "left").fillna(0.0, columns)


def described(cloud: DataFrame, size: float) -> DataFrame:
    """The cloud at one point for each voxel of size, with normals and FPFH."""
    return saved(fpfh(saved(normals(voxel.reduced(cloud, size), 2 * size, 30)), 5 * size, 100))


def fitness(source: DataFrame, target: DataFrame, matrix: np.ndarray, threshold: float) -> float:
    """The share of source points that, moved by matrix, have a target point within the threshold."""
    moved = affine(source, matrix.tolist())
    return within(moved, target, threshold).select("qid").distinct().count() / max(source.count(), 1)


def register(source: DataFrame, target: DataFrame, sizes: tuple[float, ...] = (20.0, 25.0, 30.0), ransac_fitness: float = 0.90, icp_fitness: tuple[float, ...] = (0.65, 0.70, 0.75), most_tries: int = 75) -> tuple[np.ndarray, dict]:
    """(4 x 4 transform of source onto target, log): for each voxel size, RANSAC on mutually nearest descriptors until its fitness is reached, then ICP on the cloud at
    two points a cubic unit; the best result counts, and no larger size is tried once the size's ICP fitness is reached."""
    log: dict = {"ransac": 0.0, "icp": 0.0, "size": None, "tries": 0}
    best, fine = np.eye(4), None
    for size, wanted in zip(sizes, icp_fitness, strict=True):
        low, high = described(source, size), described(target, size)
        pairs = matched(low, high)
        found, now = np.eye(4), 0.0
        for k in range(most_tries):
            log["tries"] += 1
            first = ransac(pairs, 1.5 * size, seed=k).first()
            if first is not None:
                matrix = np.array(first["transform"])
                own = fitness(low, high, matrix, 1.5 * size)
                if own > now:
                    found, now = matrix, own
                if own > log["ransac"] and not log["icp"]:
                    best, log["ransac"], log["size"] = matrix, own, size
            if now >= ransac_fitness or first is None:
                break
        if now >= ransac_fitness:
            if fine is None:
                fine = saved(voxel.reduced(source, None)), saved(normals(target, 2.0, 30))
            matrix, own = icp(fine[0], fine[1], 0.4 * size, start=found)
            if own > log["icp"]:
                best, log["icp"], log["ransac"], log["size"] = matrix, own, now, size
            if log["icp"] >= wanted:
                break
    return best, log


def matched(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs (pair_id from 0, s*, t*) of points that are each other's nearest by their descriptors."""
    both = mutual_pairs(source, target, tuple(f"f{i}" for i in range(3 * BINS)))
    s = source.select(F.col("point_id").alias("s_id"), *[F.col(a).alias(f"s{a}") for a in AXES])
    t = target.select(F.col("point_id").alias("t_id"), *[F.col(a).alias(f"t{a}") for a in AXES])
    return saved(ranked(both.join(s, "s_id").join(t, "t_id"), ["s_id"]).withColumnRenamed("rank", "pair_id"))


def mutual_pairs(source: DataFrame, target: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """(s_id, t_id) that are each other's nearest by the descriptor columns."""
    there = nearest(source, target, 1, axes).select(F.col("qid").alias("s_id"), F.col("pid").alias("t_id"))
    back = nearest(target, source, 1, axes).select(F.col("pid").alias("s_id"), F.col("qid").alias("t_id"))
    return there.join(back, ["s_id", "t_id"])
