"""Curves through planted arcs, merged meshes, and recovery in order against one segment after the other."""

import numpy as np

from cloudloom.operators import curves, voxel
from cloudloom.sources.shared import saved


def arcs(n=60):
    """Two arcs whose axes are turned in space, their points on polynomials of degree 2 and 4, and a cluster that is too small."""
    out = {}
    for label, (bend, lift, seed) in enumerate(((0.02, 0.0005, 1), (-0.01, 0.0, 2))):
        draw = np.random.default_rng(seed)
        x = np.sort(draw.uniform(-20, 20, n))
        own = np.column_stack([x, bend * x**2, lift * x**4 / 40])
        turn = np.linalg.qr(draw.normal(size=(3, 3)))[0]
        out[label] = own @ turn.T + draw.uniform(-50, 50, 3)
    return out


def test_curves_pass_through_planted_arcs(spark):
    """A parabola stays one in its own principal axes only if these are its axes; so a flat arc's curve meets its points, and any curve lies near them."""
    rows = [(1000 * label + i, label, *map(float, p)) for label, points in arcs().items() for i, p in enumerate(points)] + [(5000 + i, 9, float(i), 0.0, 0.0) for i in range(4)]
    cloud = spark.createDataFrame(rows, "point_id long, label int, x double, y double, z double")
    got = curves.cluster_curves(cloud).collect()
    at = {r[0]: np.array(r[2:]) for r in rows}
    for label, most in ((1, 0.2), (0, 1.5)):
        own = sorted((r for r in got if r["label"] == label), key=lambda r: r["vertex"])
        assert [r["vertex"] for r in own] == list(range(60))
        apart = [np.linalg.norm(np.array([r["x"], r["y"], r["z"]]) - at[r["point_id"]]) for r in own]
        assert max(apart) < most
        ends = [own[0]["point_id"] % 1000, own[-1]["point_id"] % 1000]
        assert sorted(ends) == [0, 59]
    assert {r["label"] for r in got} == {0, 1}


def test_curve_equals_numpy(spark):
    draw = np.random.default_rng(8)
    at = draw.normal(size=(80, 3)) * (9, 3, 1) + 5
    cloud = spark.createDataFrame([(i, 4, *map(float, p)) for i, p in enumerate(at)], "point_id long, label int, x double, y double, z double")
    got = {r["point_id"]: (r["vertex"], r["x"], r["y"], r["z"]) for r in curves.cluster_curves(cloud).collect()}
    values, vectors = np.linalg.eigh(np.cov(at.T))
    own = (at - at.mean(0)) @ vectors[:, ::-1]
    t = own[:, 0]
    bent = np.column_stack([t, np.polyval(np.polyfit(t, own[:, 1], 3), t), np.polyval(np.polyfit(t, own[:, 2], 4), t)]) @ vectors[:, ::-1].T + at.mean(0)
    assert np.allclose([got[i][1:] for i in range(80)], bent, atol=1e-6)
    order = [i for i, _ in sorted(got.items(), key=lambda x: x[1][0])]
    assert order in (np.argsort(t).tolist(), np.argsort(-t).tolist())


def test_merged_meshes(spark):
    vertices = [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 2.0), ("c", 0, 3.0), ("b", 0, 4.0), ("b", 1, 5.0), ("b", 2, 6.0), ("b", 3, 7.0)]
    faces = [("a", 0, 1, 2), ("b", 3, 1, 0), ("b", 1, 2, 3)]
    v, f = curves.merged(spark.createDataFrame(vertices, "part string, vertex long, x double"), spark.createDataFrame(faces, "part string, a long, b long, c long"), "part", ("a", "b", "c"))
    place = {x: i for i, (_, _, x) in enumerate(sorted(vertices))}
    assert {r["x"]: r["vertex"] for r in v.collect()} == place
    assert sorted(map(tuple, f.collect())) == [("a", 0, 1, 2), ("b", 4, 5, 6), ("b", 6, 4, 3)]
    line = curves.path(spark.createDataFrame(vertices, "part string, vertex long, x double"), "part")
    assert sorted(map(tuple, line.collect())) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2), ("b", 2, 3)]


def test_recovery_in_order_equals_one_after_the_other(spark):
    draw = np.random.default_rng(4)
    full = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([draw.uniform(0, 6, (400, 3)), draw.uniform(40, 46, (400, 3))]))]
    seeds = [(s, *map(float, draw.uniform(low, low + 6, 3))) for s, low in ((3, 0), (1, 0), (7, 40), (2, 40), (5, 0)) for _ in range(6)]
    cloud = saved(spark.createDataFrame(full, "point_id long, x double, y double, z double"))
    region = saved(spark.createDataFrame(seeds, "segment_id int, x double, y double, z double"))
    sizes = (1.0, 0.8)
    got = {(r["segment_id"], r["point_id"]) for r in voxel.recover_in_order(region, cloud, sizes).collect()}
    want, left = set(), cloud
    for s in (1, 2, 3, 5, 7):
        own = saved(voxel.recover(region.where(f"segment_id = {s}"), left, sizes))
        want |= {(s, r["point_id"]) for r in own.collect()}
        left = saved(left.join(own.select("point_id"), "point_id", "left_anti"))
    assert got == want and len(got) == len({p for _, p in got}) > 20
    assert voxel.recover_in_order(region.limit(0), cloud, sizes).count() == 0
