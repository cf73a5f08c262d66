"""The PLY data source: one file read by many tasks, round trips, odd files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.sources import ply, ply_source


@pytest.fixture(scope="module")
def source(spark):
    ply_source.register(spark)
    return lambda path, **options: spark.read.format("ply").options(**options).load(str(path))


def big(path, n, order="<"):
    draw = np.random.default_rng(n)
    rows = np.zeros(n, [("x", f"{order}f4"), ("y", f"{order}f4"), ("z", f"{order}f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("confidence", f"{order}i2")])
    for c in ("x", "y", "z"):
        rows[c] = draw.normal(size=n)
    for c in ("red", "green", "blue"):
        rows[c] = draw.integers(0, 256, n)
    kinds = {"f4": "float", "f8": "double", "u1": "uchar", "i2": "short"}
    head = ["ply", f"format binary_{'little' if order == '<' else 'big'}_endian 1.0", "comment made here", f"element vertex {n}", *[f"property {kinds[rows.dtype[c].str[1:]]} {c}" for c in rows.dtype.names], "element face 1", "property list uchar int vertex_indices", "end_header", ""]
    path.write_bytes("\n".join(head).encode() + rows.tobytes() + b"\x03" + np.array([0, 1, 2], f"{order}i4").tobytes())
    return rows


@pytest.mark.parametrize("order", ["<", ">"])
def test_a_file_is_read_by_many_tasks(source, tmp_path, order):
    rows = big(tmp_path / "scan.ply", 5000, order)
    cloud = source(tmp_path / "scan.ply", rangeBytes=10_000)
    assert cloud.rdd.getNumPartitions() == -(-5000 // (10_000 // rows.dtype.itemsize))
    got = cloud.orderBy("point_id").collect()
    assert [r["point_id"] for r in got] == list(range(5000))
    assert np.array_equal([[r["x"], r["y"], r["z"]] for r in got], np.column_stack([rows["x"], rows["y"], rows["z"]]).astype(float))
    assert np.allclose([r["g"] for r in got], rows["green"] / 255) and got[0]["nx"] is None
    whole = ply.read_cloud(cloud.sparkSession, str(tmp_path / "scan.ply")).drop("path")
    assert cloud.drop("path").exceptAll(whole).isEmpty() and whole.count() == 5000


def test_round_trip(spark, source, tmp_path):
    cloud = spark.range(1000).select(F.col("id").alias("point_id"), *[F.rand(k).alias(a) for k, a in enumerate(("x", "y", "z", "nx", "ny", "nz"))], *[(F.pmod(F.col("id") * (k + 3), F.lit(256)) / 255).alias(c) for k, c in enumerate("rgb")]).repartition(4)
    cloud = cloud.cache()
    for _ in range(2):  # the second time replaces the first
        cloud.write.format("ply").mode("overwrite").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.ply"))) == 4 == len(list((tmp_path / "out").iterdir()))
    again = source(tmp_path / "out")
    shown = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.select("x", "y", "z", "nx", "ny", "nz", "r", "g", "b").collect())
    assert shown(again) == shown(cloud)
    cloud.limit(10).select("x", "y", "z").write.format("ply").mode("append").save(str(tmp_path / "out"))
    assert source(tmp_path / "out").count() == 1010 and source(tmp_path / "out").where("r IS NULL").count() == 10


def test_odd_files(source, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    (tmp_path / "b.PLY").write_text("ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
    (tmp_path / "c.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
    (tmp_path / "notes.txt").write_text("no cloud")
    assert [(r["x"], r["y"], r["z"]) for r in source(tmp_path).orderBy("point_id").collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    with pytest.raises(Exception, match="missing"):
        source(tmp_path / "missing.ply").count()


def test_saved_twice(spark, source, tmp_path):
    cloud = spark.createDataFrame([(0, 600.0, 0.0, -1200.0)], "point_id long, x double, y double, z double")
    ply_source.save_registered(cloud, str(tmp_path), "run")
    places = [tuple(source(tmp_path / f"run_{s}").select("x", "y", "z").first()) for s in ("registered", "registered_paraview")]
    assert places[0] == (600.0, 0.0, -1200.0) and np.allclose(places[1], (1.0, 0.0, -2.0))
