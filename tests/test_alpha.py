"""Alpha shapes against all triples of points; skeletons of planted bands."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import alpha


def brute(at, most):
    """Triples whose circle is small and holds no other point."""
    found = np.array(list(combinations(range(len(at)), 3)))
    middle, radius = alpha.circles(at, found)
    small = radius < most
    found, middle, radius = found[small], middle[small], radius[small]
    d = np.hypot(middle[:, None, 0] - at[None, :, 0], middle[:, None, 1] - at[None, :, 1])
    d[np.arange(len(found))[:, None], found] = np.inf
    return {tuple(t) for t in found[(d > radius[:, None]).all(axis=1)].tolist()}


@pytest.mark.parametrize("of_tile", [10, 400])
def test_triangles_equal_all_triples(spark, of_tile):
    draw = np.random.default_rng(of_tile)
    clouds = {"a": draw.uniform(-6, 6, (170, 2)), "b": np.concatenate([draw.normal(0, 0.5, (60, 2)), draw.normal(9, 1.5, (60, 2))]), "c": draw.uniform(0, 1, (2, 2))}
    rows = [(s, i, *map(float, p)) for s, at in clouds.items() for i, p in enumerate(at)] + [("a", 900 + i, *map(float, p)) for i, p in enumerate(clouds["a"][:7])]
    got = {}
    for r in alpha.triangles(spark.createDataFrame(rows, "shape string, point_id long, x double, y double"), 0.8, of_tile).collect():
        assert (r["a"], r["b"], r["c"]) not in got.setdefault(r["shape"], set())
        got[r["shape"]].add((r["a"], r["b"], r["c"]))
    assert got == {s: brute(clouds[s], 1 / 0.8) for s in "ab"}


def test_a_ring_keeps_its_hole(spark):
    turn = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    at = np.concatenate([np.column_stack([np.cos(turn), np.sin(turn)]) * r for r in (5.0, 5.4, 5.8)])
    cloud = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(at)], "shape int, point_id long, x double, y double")
    found = alpha.triangles(cloud)
    edges = {tuple(r[1:]) for r in alpha.outline(found).collect()}
    assert edges == {tuple(sorted((k + a, k + (a + 1) % 90))) for k in (0, 180) for a in range(90)}
    drawn = cloud.withColumns({c: F.col(c) * 10 + 60 for c in "xy"})
    got = {(r["col"] - 60, r["row"] - 60) for r in alpha.covered(drawn, found).collect()}
    assert {(x, y) for x in range(-60, 61) for y in range(-60, 61) if 50.2 <= np.hypot(x, y) <= 57.8} <= got and all(49.8 <= np.hypot(x, y) <= 58.1 for x, y in got)


def test_a_grid_is_covered_once(spark):
    """Points on circles of four: each square is split one way, in whatever tile."""
    cloud = spark.createDataFrame([(1, 20 * i + j, i * 0.5, j * 0.5) for i in range(20) for j in range(20)], "shape int, point_id long, x double, y double")
    found = alpha.triangles(cloud, points_of_tile=40)
    assert found.count() == 2 * 19 * 19 and alpha.outline(found).count() == 4 * 19


def test_skeleton_of_a_band(spark):
    """A flat band in space, and its line of middles."""
    draw = np.random.default_rng(6)
    flat = np.column_stack([draw.uniform(-8, 8, 1500), draw.uniform(-0.6, 0.6, 1500), np.zeros(1500)])
    turn = np.linalg.qr(draw.normal(size=(3, 3)))[0]
    at = flat @ turn.T + (5.0, -7.0, 30.0)
    cloud = spark.createDataFrame([(i, 3, *map(float, p)) for i, p in enumerate(at)] + [(9000, 4, 0.0, 0.0, 0.0)], "point_id long, label int, x double, y double, z double")
    out = alpha.skeletons(cloud, scale=20).toPandas()
    assert set(out["label"]) == {3}
    back = (out[["x", "y", "z"]].to_numpy() - (5.0, -7.0, 30.0)) @ turn
    assert np.abs(back[:, 2]).max() < 0.05
    middle = back[np.abs(back[:, 0]) < 6.5]
    assert np.ptp(middle[:, 0]) > 12.5 and np.quantile(np.abs(middle[:, 1]), 0.9) < 0.3
