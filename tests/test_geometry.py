"""Planted shapes whose truth is known."""

import numpy as np
import pytest

from cloudloom.functions.geometry import affine, cylinders
from cloudloom.operators import clusters, neighbors, raster, register, voxel
from cloudloom.sources import packages, ply
from cloudloom.streaming.voxels import running_voxels

SCHEMA = "point_id long, x double, y double, z double"


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], SCHEMA)


def surface(n=400, seed=1):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 10, (n, 2))
    return np.column_stack([xy, np.sin(xy[:, 0]) + 0.3 * xy[:, 1] ** 2 / 5])


def test_nearest_equals_brute_force(spark):
    points = np.random.default_rng(2).normal(size=(120, 3)) ** 3
    cloud = frame(spark, points)
    got = {(r.qid, r.place): r.pid for r in neighbors.nearest(cloud, cloud, 5).collect()}
    for i, p in enumerate(points):
        want = np.lexsort((np.arange(len(points)), np.sqrt(((points - p) ** 2).sum(axis=1))))[:5]
        assert [got[i, k + 1] for k in range(5)] == want.tolist()
    assert neighbors.nearest(cloud.limit(0), cloud, 3).count() == 0
    assert neighbors.nearest(cloud.limit(2), cloud.limit(2), 5).count() == 4


def test_two_sheets_are_two_clusters(spark):
    sheet = [(x, y, z) for z in (0, 10) for x in range(8) for y in range(8)]
    rows = clusters.dbscan(frame(spark, [*sheet, (50, 50, 50)]), 1.5).collect()
    assert {r.label for r in rows if r.z == 0} == {0} and {r.label for r in rows if r.z == 10} == {1} and [r.label for r in rows if r.x == 50] == [-1]


def test_icp_and_ransac_recover_a_motion(spark):
    points = surface()
    a = 0.03
    truth = np.eye(4)
    truth[:3, :3] = [[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]
    truth[:3, 3] = [0.05, -0.04, 0.02]
    target = register.normals(frame(spark, points), 1.5)
    source = affine(frame(spark, points), np.linalg.inv(truth).tolist())
    found, fitness = register.icp(source, target, 0.6, rounds=12)
    assert fitness == 1.0 and np.abs(found - truth).max() < 1e-3
    moved = points @ truth[:3, :3].T + truth[:3, 3]
    moved[:40] += 5.0  # wrong pairs
    pairs = spark.createDataFrame([(i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(points, moved, strict=True))], "pair_id long, sx double, sy double, sz double, tx double, ty double, tz double")
    best = register.ransac(pairs, 0.01, tries=60).first()
    assert best.inliers == len(points) - 40 and np.abs(np.array(best.transform) - truth).max() < 1e-6


def test_plane_normals_and_axes(spark):
    cloud = frame(spark, [(x, y, 0) for x in range(7) for y in range(5)])
    assert all(abs(r.nz - 1) < 1e-9 for r in register.normals(cloud, 1.6).collect())
    segment = cloud.selectExpr("*", "1 AS segment_id")
    axes = raster.principal_axes(segment)
    row = axes.first()
    assert abs(abs(row.axes[0][0]) - 1) < 1e-9 and abs(row.axes[2][2] - 1) < 1e-9
    back = raster.to_axes(raster.to_axes(segment, axes), axes, back=True).collect()
    assert all(abs(r.x - round(r.x)) < 1e-9 and abs(r.z) < 1e-9 for r in back)


def test_diagonal_pixels(spark):
    pixels = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 9, 9)], "segment_id int, row long, col long")
    for connectivity, n in ((8, 2), (4, 3)):
        assert raster.label_pixels(pixels, connectivity).select("component").distinct().count() == n


def test_short_curves_and_vertical_edges(spark):
    for n, known in ((50, False), (60, True)):
        eps = clusters.epsilon(frame(spark, [(1.1**i, 0, 0) for i in range(n)]), start=0, threshold=1e-9).first().eps
        assert (eps is not None) == known
    row = cylinders(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 2.0)], "x double, y double, z double, x2 double, y2 double, z2 double")).first()
    assert (row.angle, row.height) == (0.0, 4.0)


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_round_trip(spark, tmp_path, kind):
    points = [(0.5, 1.25, -2.0, 255, 0, 51), (1.5, 0.0, 3.0, 0, 255, 102), (0.0, 1.0, 0.0, 1, 2, 3)]
    head = f"ply\nformat {kind} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    if kind == "ascii":
        body = "\n".join(" ".join(map(str, p)) for p in points).encode() + b"\n3 0 1 2\n"
    else:
        o = ">" if "big" in kind else "<"
        body = b"".join(np.array(p[:3], o + "f4").tobytes() + bytes(p[3:]) for p in points)
        body += b"\x03" + np.array([0, 1, 2], o + "i4").tobytes()
    path = tmp_path / "a.ply"
    path.write_bytes(head.encode() + body)
    cloud = ply.read_any(spark, str(path))
    assert [(r.x, r.y, r.z, round(r.r * 255), r.nx) for r in cloud.orderBy("point_id").collect()] == [(*p[:4], None) for p in points]
    assert ply.read_faces(spark, str(path)).select("v0", "v1", "v2").first() == (0, 1, 2)
    assert ply.vertex_normals(cloud, ply.read_faces(spark, str(path))).where("nx IS NOT NULL").count() == 3
    ply.write_cloud(cloud.coalesce(1), str(tmp_path / "out"))
    again = spark.read.format("binaryFile").load(str(tmp_path / "out" / "part-*"))
    assert len(ply.parse(again.first().content)["vertex"]) == 3
    with pytest.raises(ValueError):
        ply.read_any(spark, "a.obj")


def test_voxels_of_a_grid_batch_and_stream(spark, tmp_path):
    cloud = frame(spark, [(x, y, 0) for x in range(6) for y in range(6)])
    cloud.write.parquet(str(tmp_path / "in"))
    stream = running_voxels(spark.readStream.schema(cloud.schema).parquet(str(tmp_path / "in")), 2.0)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("voxels").start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in running_voxels(cloud, 2.0).collect()}
    assert {tuple(r) for r in spark.table("voxels").collect()} == want and len(want) == 9
    assert voxel.metrics(cloud).first().density is None


def test_package(tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "a.txt").write_text("x")
    (tmp_path / "t.xml").write_text('<case><car model="" name=""/></case>')
    packages.rewrite(str(tmp_path / "t.xml"), str(tmp_path / "run1" / "o.xml"), {"car": {"model": "M44"}, "none": {"a": "b"}})
    assert 'model="M44"' in (tmp_path / "run1" / "o.xml").read_text()
    digest = packages.publish(str(tmp_path / "run1"), str(tmp_path), str(tmp_path / "up"))
    assert digest == packages.sha1(str(tmp_path / "up" / "run1.tar")) and digest in (tmp_path / "up" / "run1.xml").read_text()
