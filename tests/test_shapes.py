"""Sparse and skewed clouds, fits, registration from descriptors, boxes and workflows, on planted shapes."""

import struct

import numpy as np
from pyspark.sql import functions as F

from cloudloom.functions import geometry
from cloudloom.operators import clusters, curves, neighbors, register, voxel, workflows
from cloudloom.sources import ply


def frame(spark, points, **more):
    rows = [(i, *map(float, p), *[float(v[i]) if np.ndim(v) else float(v) for v in more.values()]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double" + "".join(f", {c} double" for c in more))


def test_sparse_and_flat_clouds_stay(spark):
    rng = np.random.default_rng(1)
    sparse = frame(spark, rng.uniform(0, 100, (50, 3)), r=0.5, g=0.5, b=0.5)
    flat = frame(spark, np.column_stack([rng.uniform(0, 5, (60, 2)), np.zeros(60)]), r=0.5, g=0.5, b=0.5)
    tiny = frame(spark, rng.uniform(0, 0.5, (40, 3)), r=0.5, g=0.5, b=0.5)
    for cloud, n in ((sparse, 50), (flat, 60), (tiny, 40)):
        out = voxel.downsample(cloud).collect()
        assert len(out) == n and all(r.i is None and r.n == 1 for r in out)
    dense = frame(spark, rng.uniform(0, 3, (600, 3)), r=0.5, g=0.5, b=0.5)
    assert voxel.downsample(dense).count() < 150 and voxel.reduced(dense, None).count() < 150


def test_axes_turn_once(spark):
    assert geometry.affine(frame(spark, [(1, 2, 3)]), geometry.PERMUTATION).select("x", "y", "z").first() == (3.0, 1.0, 2.0)


def test_recovery_equals_all_cells(spark):
    rng = np.random.default_rng(4)
    full = rng.uniform(-3, 5, (300, 3))
    segments = {0: full[:12], 1: full[5:25] * 0.5}
    rows = [(s, *map(float, p)) for s, ps in segments.items() for p in ps]
    region = spark.createDataFrame(rows, "segment_id int, x double, y double, z double")
    got = {(r.segment_id, r.point_id) for r in voxel.recover(region, frame(spark, full), (1.0, 0.8)).collect()}
    want = set()
    for s, ps in segments.items():
        ids = []
        for size in (1.0, 0.8):
            low = ps.min(axis=0) - size / 2
            cells = {tuple(c) for c in np.floor((ps - low) / size)}
            ids = [i for i, p in enumerate(full) if tuple(np.floor((p - low) / size)) in cells]
            ps = full[ids]
        want |= {(s, i) for i in ids}
    assert got == want


def test_nearest_with_far_outliers_and_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "FEW", 10)
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(150, 3)), [(1e6, 0, 0), (0, -1e7, 3)], [(0, 0, 0)] * 4])
    groups = [i % 2 for i in range(len(points))]
    cloud = frame(spark, points, part=groups)
    got = {(r.qid, r.place): (r.pid, r.d) for r in neighbors.nearest(cloud, cloud, 4, by=["part"]).collect()}
    for i, p in enumerate(points):
        own = [k for k in range(len(points)) if groups[k] == groups[i]]
        d = np.sqrt(((points[own] - p) ** 2).sum(axis=1))
        want = [(own[k], d[k]) for k in np.lexsort((own, d))[:4]]
        assert [got[i, k + 1][0] for k in range(4)] == [w[0] for w in want]
        assert np.allclose([got[i, k + 1][1] for k in range(4)], [w[1] for w in want])


def test_planted_polynomials(spark):
    xs = np.linspace(1000, 1004, 30)
    rows = [("line", float(x), float(10 * x - 10000)) for x in xs] + [("cubic", float(x - 1000), float(2 - 3 * (x - 1000) + 0.5 * (x - 1000) ** 3)) for x in xs] + [("one", 5.0, 7.0)] * 3
    got = {r.segment: r.coefficients for r in curves.polynomials(spark.createDataFrame(rows, "segment string, x double, y double"), "segment", "x", "y", 3).collect()}
    assert np.allclose(got["cubic"], [2, -3, 0, 0.5], atol=1e-8)
    assert np.allclose(np.polynomial.Polynomial(got["line"])(xs), 10 * xs - 10000, atol=1e-5) and abs(got["line"][1] - 10) < 1
    assert abs(np.polynomial.Polynomial(got["one"])(5.0) - 7) < 1e-9


def test_stl_files(spark, tmp_path):
    corners = [[(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(1, 1, 1), (2, 1, 1), (1, 2, 1.5)]]
    text = "solid s\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in t) + "endloop\nendfacet\n" for t in corners) + "endsolid s\n"
    (tmp_path / "a.stl").write_text(text)
    (tmp_path / "b.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 1, *[v for p in t for v in p], 0) for t in corners))
    want = [tuple(float(v) for v in p) for t in corners for p in t]
    for name in ("a.stl", "b.stl"):
        assert [(r.x, r.y, r.z) for r in ply.read_any(spark, str(tmp_path / name)).orderBy("point_id").collect()] == want
    (tmp_path / "c.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 0))
    assert ply.read_any(spark, str(tmp_path / "c.stl")).count() == 0


def test_registration_recovers_a_far_motion(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 12, (900, 2))
    points = np.column_stack([xy, 2 * np.sin(xy[:, 0]) + np.cos(1.7 * xy[:, 1]) + 0.02 * xy[:, 0] ** 2])
    a = 2.0
    truth = np.eye(4)
    truth[:3, :3] = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    truth[:3, 3] = [30, -12, 4]
    moved = (points - truth[:3, 3]) @ truth[:3, :3]
    # The same voxels on both sides: each cloud is small enough to keep its points.
    matrix, log = register.register(frame(spark, moved), frame(spark, points), (0.05,), ransac_fitness=0.5, icp_fitness=(0.5,), most_tries=2)
    assert log["size"] == 0.05
    described = register.fpfh(register.normals(frame(spark, points), 1.5), 2.0)
    other = register.fpfh(register.normals(frame(spark, moved), 1.5), 2.0)
    pairs = register.matched(other, described)
    assert pairs.count() > 300
    best = np.array(register.ransac(pairs, 0.05).first().transform)
    assert np.abs(best - truth).max() < 1e-6


def test_boxes_and_groups(spark):
    rng = np.random.default_rng(3)
    boxes = [(10, 1, 0.5), (9.5, 1, 0.5), (2, 2, 0.1), (2.1, 2, 0.1), (0, 0, 0)]
    points = np.vstack([rng.uniform(0, 1, (400, 3)) * b for b in boxes])
    labels = np.repeat(np.arange(5), 400)
    cloud = frame(spark, points, label=labels).withColumn("label", F.col("label").cast("int"))
    got = {r.label: r.aspect for r in clusters.aspects(cloud).collect()}
    assert 8 < got[0] < 11 and 8 < got[1] < 11 and got[2] < 1.5 and got[4] == float("inf")
    kept = lambda **o: {r.label for r in clusters.filter_by_aspect(cloud, **o).select("label").distinct().collect()}
    assert kept(most=4.0) == {2, 3} and kept(least=3.0, most=100.0) == {0, 1}
    four = cloud.where("label < 4")
    named = {r.label: r.group_label for r in clusters.grouped(four, 2).select("label", "group_label").distinct().collect()}
    assert named[0] == named[1] and named[2] == named[3] and named[0] != named[2]


def test_segments_by_their_own_knees(spark):
    sheet = [(x, y, z) for z in (0, 60) for x in range(12) for y in range(12)]
    up = np.array([p[2] == 0 for p in sheet], float)
    cloud = frame(spark, sheet, nx=0.0, ny=0.0, nz=2 * up - 1)
    out = clusters.segment(cloud, 2, eps=1.5, least=100).collect()
    assert {(r.z, r.segment_id) for r in out} == {(0.0, 0), (60.0, 1)}
    assert clusters.segment(cloud, 2, least=100).count() == 0  # no knee on a regular grid
    turned = neighbors.corrected_normals(cloud, cloud.where("point_id = 0"), 2).where("flipped")
    assert {r.point_id: r.nz for r in turned.collect()} == {0: -1.0, 1: -1.0, 12: -1.0}


def test_paint_of_bright_points(spark):
    rng = np.random.default_rng(5)
    green = np.arange(200) % 4 == 0
    cloud = frame(spark, rng.uniform(0, 1, (200, 3)), r=np.where(green, 0.3, 0.1), g=np.where(green, 0.9, 0.1), b=np.where(green, 0.2, 0.1))
    assert workflows.paint(cloud) == "green"
    lines = workflows.line_points(cloud.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)}), "green", k=1)
    assert {r.point_id for r in lines.collect()} == set(np.flatnonzero(green).tolist())
