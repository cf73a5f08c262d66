import numpy as np
import pytest

from cloudloom.operators import leaves, neighbors, register


def cloud(spark, at, ids=None):
    ids = range(len(at)) if ids is None else ids
    rows = [(i, *map(float, p), f"c{int(np.nan_to_num(p[0], posinf=0) * 10) % 7}") for i, p in zip(ids, at, strict=True)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, color string").repartition(3)


def brute(q, p, k, radius=np.inf):
    d = np.sqrt((q[:, None, 0] - p[None, :, 0]) ** 2 + (q[:, None, 1] - p[None, :, 1]) ** 2 + (q[:, None, 2] - p[None, :, 2]) ** 2)
    out = {}
    for i, row in enumerate(d):
        order = [j for j in np.lexsort((np.arange(len(p)), row)) if row[j] <= radius][:k]
        out |= {(i, place + 1): (int(j), float(row[j])) for place, j in enumerate(order)}
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(leaves, "LEAF", 40)
    monkeypatch.setattr(leaves, "ASKERS", 90)
    monkeypatch.setattr(leaves, "BUCKET", 8)
    monkeypatch.setattr(leaves, "TOGETHER", 16)


def test_lists_over_many_leaves_equal_brute_force(spark, small):
    """Dense and sparse parts, a heap of equal places, ties, far-off queries, leaves of fewer points than k, columns that go along."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 1, (250, 3)), rng.normal(30, 0.01, (150, 3)), np.full((300, 3), 5.0), rng.integers(0, 4, (120, 3)), [[500.0, -500, 0]]])
    q = np.concatenate([p[::3], rng.normal(0, 40, (60, 3))])
    points, queries = cloud(spark, p), cloud(spark, q)
    for k, radius in ((5, None), (70, None), (9, 1.5)):
        rows = neighbors.listed(queries, points, k, radius=radius, keep=("z",), carry=("color", "x")).collect()
        got = {(r.qid, r.place): (r.pid, r.d) for r in rows}
        assert len(got) == len(rows) and got == brute(q, p, k, np.inf if radius is None else radius)
        assert all(r.pcolor == f"c{int(r.px * 10) % 7}" and r.px == p[r.pid][0] and r.qz == q[r.qid][2] for r in rows)


def test_no_pair_is_shuffled_where_a_leaf_settles_it(spark, monkeypatch):
    """Joins by cells explode each query to 27 rows and shuffle all candidates; here rows are shuffled once, and lists only where leaves meet."""
    monkeypatch.setattr(neighbors, "FEW", 10)
    rng = np.random.default_rng(3)
    p = rng.random((400, 3))
    found = neighbors.nearest(cloud(spark, p), cloud(spark, p), 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " Join " not in plan
    assert {(r.qid, r.place): (r.pid, r.d) for r in found.collect()} == brute(p, p, 4)


def test_nothing_and_points_without_a_place(spark):
    none = cloud(spark, np.zeros((0, 3)))
    some = cloud(spark, [[0, 0, 0], [np.nan, 0, 0], [np.inf, 1, 1], [1, 0, 0]])
    assert neighbors.listed(some, none, 3).count() == neighbors.listed(none, some, 3).count() == 0
    assert sorted((r.qid, r.pid) for r in neighbors.listed(some, some, 3).collect()) == [(0, 0), (0, 3), (3, 0), (3, 3)]
    named = some.selectExpr("concat('n', point_id) AS point_id", "x", "y", "z")
    assert sorted((r.qid, r.pid) for r in neighbors.listed(named, named, 1).collect()) == [("n0", "n0"), ("n3", "n3")]


def pair_joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_votes_take_the_colours_along(spark):
    """No list of neighbours is joined with the colours."""
    rng = np.random.default_rng(5)
    p = rng.random((60, 3))
    points = cloud(spark, p).replace({"c0": "red", "c1": "green", "c2": "black"}, subset=["color"])
    out = neighbors.majority(points, points, 7)
    assert pair_joins(out) == 0 and out.count() == 60


def test_normals_join_no_pairs_and_equal_numpy(spark, small):
    rng = np.random.default_rng(6)
    p = rng.random((150, 3)) * [10, 10, 0.1]
    out = register.normals(cloud(spark, p), 2.0, 12)
    assert pair_joins(out) == 1  # with the cloud
    lists = brute(p, p, 12, 2.0)
    for r in out.collect():
        own = p[[lists[r.point_id, k][0] for k in range(1, 13) if (r.point_id, k) in lists]]
        n = np.linalg.eigh(np.cov(own.T, bias=True))[1][:, 0] if len(own) > 2 else np.array([0, 0, 1.0])
        assert np.allclose(np.abs(n @ [r.nx, r.ny, r.nz]), 1, atol=1e-6) and r.nz >= 0


def test_histograms_write_no_pairs(spark, small, monkeypatch):
    rng = np.random.default_rng(7)
    p = rng.random((150, 3)) * 4
    points = register.normals(cloud(spark, p), 2.0, 12)
    written, save = [], register.saved
    monkeypatch.setattr(register, "saved", lambda df, *a: written.append(df.columns) or save(df, *a))
    rows = register.fpfh(points, 1.0, 9).collect()
    assert written and not any("pid" in c for c in written)
    near = {q for q, place in brute(p, p, 2, 1.0) if place == 2}
    for r in rows:
        sums = [sum(r[f"f{i}"] for i in range(t, t + 11)) for t in (0, 11, 22)]
        assert np.allclose(sums, 200 if r.point_id in near else 0)
