"""Density clusters by cells against all pairs, crowded cells, knees of many groups at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import clusters
from cloudloom.sources.shared import Workspace


def plain(points, eps, least):
    """{id: label} by all pairs."""
    ids = [p[0] for p in points]
    at = np.array([p[1:] for p in points])
    near = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    root = {}
    for i in range(len(ids)):
        if core[i] and i not in root:
            stack = [i]
            root[i] = i
            while stack:
                x = stack.pop()
                for y in np.flatnonzero(near[x] & core):
                    if y not in root:
                        root[y] = i
                        stack.append(y)
    least_of = {}
    for i, r in root.items():
        least_of[r] = min(least_of.get(r, ids[i]), ids[i])
    order = {v: k for k, v in enumerate(sorted(least_of.values()))}
    out = {}
    for i, name in enumerate(ids):
        if i in root:
            out[name] = order[least_of[root[i]]]
        else:
            out[name] = min((order[least_of[root[j]]] for j in np.flatnonzero(near[i] & core)), default=-1)
    return out


@pytest.mark.parametrize(("seed", "few"), [(1, 1024), (2, 1), (3, 4)])
def test_labels_equal_all_pairs(spark, monkeypatch, seed, few):
    monkeypatch.setattr(clusters, "FEW_PAIRS", few)
    draw = np.random.default_rng(seed)
    blobs = [draw.normal(c, s, (n, 3)) for c, s, n in (((0, 0, 0), 0.3, 150), ((3.2, 0, 0), 0.3, 120), ((0, 9, 0), 2.0, 80), ((-20, 0, 5), 0.01, 40))]
    lattice = np.array([(30 + i, j, 0.0) for i in range(8) for j in range(8)])  # distances of exactly eps
    at = np.concatenate([*blobs, lattice, lattice[:5], draw.uniform(-30, 30, (60, 3))])
    points = [(int(i), *map(float, p)) for i, p in zip(draw.permutation(len(at)), at, strict=True)]
    cloud = spark.createDataFrame(points, "point_id long, x double, y double, z double")
    for eps, least in ((1.0, 3), (0.25, 5)):
        got = {r["point_id"]: r["label"] for r in clusters.dbscan(cloud, eps, least).collect()}
        assert got == plain(points, eps, least)


def test_crowded_cells_make_few_rows(spark):
    """Three heaps of 20,000 points each: two a hair nearer than eps, one a hair farther; no pairs of points within a heap."""
    heap = spark.range(20_000).select("id", *[(F.rand(k) * 0.2).alias(a) for k, a in enumerate("xyz")])
    place = {0: 0.0, 1: 1.15, 2: 2.37}
    parts = [heap.select((F.col("id") * 3 + k).alias("point_id"), (F.col("x") + x).alias("x"), "y", "z") for k, x in place.items()]
    cloud = parts[0].unionByName(parts[1]).unionByName(parts[2])
    with Workspace(spark) as work:
        cloud = work.keep(cloud)
        ends = [tuple(r) for r in cloud.groupBy((F.col("point_id") % 3).alias("k")).agg(F.min("x"), F.max("x")).orderBy("k").collect()]
        assert ends[1][1] - ends[0][2] < 1 < ends[2][1] - ends[1][2]  # first gap under 1, second over 1
        out = clusters.dbscan(cloud, 1.0).groupBy((F.col("point_id") % 3).alias("k"), "label").count().collect()
    assert sorted((r["k"], r["label"], r["count"]) for r in out) == [(0, 0, 20_000), (1, 0, 20_000), (2, 1, 20_000)]


def test_knees_of_all_groups_at_once(spark):
    """Each group as it is clustered alone."""
    draw = random.Random(5)
    rows = []
    for g, (spread, n) in enumerate(((0.05, 240), (1.0, 240), (0.3, 20))):
        rows += [(1000 * g + i, "abc"[g], *[draw.gauss(5 * (i % 3), spread) for _ in range(3)]) for i in range(n)]
    cloud = spark.createDataFrame(rows, "point_id long, part string, x double, y double, z double")
    got = clusters.knee_clusters(cloud, "part", 0.1, 60, 1e-5)
    found = {}
    for r in got.collect():
        found.setdefault(r["part"], {})[r["point_id"]] = r["label"]
    firsts = []
    for part in "abc":
        own = cloud.where(F.col("part") == part)
        eps = clusters.epsilon(own, 60, 1e-5).first()["eps"]
        if eps is None:
            assert set(found[part].values()) == {-1}
            continue
        alone = {r["point_id"]: r["label"] for r in clusters.dbscan(own, eps + 0.1).collect()}
        pairs = {(alone[i], found[part][i]) for i in alone}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all((a == -1) == (b == -1) for a, b in pairs)
        firsts += [(min(i for i in alone if alone[i] == a), b) for a, b in pairs if a >= 0]
    assert [b for _, b in sorted(firsts)] == list(range(len(firsts))) and len(firsts) >= 2


def test_points_of_several_groups(spark):
    """The same points in two groups, and in a third some of them: each group has clusters of its own."""
    draw = np.random.default_rng(8)
    points = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([draw.normal(0, 0.3, (30, 3)), draw.normal(8, 0.3, (30, 3))]))]
    rows = [(g, *p) for g in "abc" for p in points if g != "c" or p[0] % 2]
    got = clusters.dbscan(spark.createDataFrame(rows, "part string, point_id long, x double, y double, z double"), 1.0, by=["part"]).collect()
    assert len(got) == len(rows)
    for g in "abc":
        own = [p for p in points if g != "c" or p[0] % 2]
        alone, found = plain(own, 1.0, 3), {r["point_id"]: r["label"] for r in got if r["part"] == g}
        pairs = {(alone[i], found[i]) for i in alone}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) >= 2
    assert len({r["label"] for r in got if r["label"] >= 0}) == len({(r["part"], r["label"]) for r in got if r["label"] >= 0})
