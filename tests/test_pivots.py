"""Nearest points over many axes: exact, with far fewer candidates than pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import neighbors
from cloudloom.sources.shared import Workspace, saved

AXES = tuple(f"f{i}" for i in range(33))


def cloud(spark, at, first=0):
    rows = [(first + i, *map(float, p)) for i, p in enumerate(at)]
    return saved(spark.createDataFrame(rows, "point_id long, " + ", ".join(f"{a} double" for a in AXES)))


def brute(q, p, k):
    out = {}
    for i, at in enumerate(q):
        d = np.sqrt(np.square(p - at).sum(1))
        order = np.lexsort((np.arange(len(p)), np.round(d, 9)))[:k]
        out[i] = [(int(j), round(float(d[j]), 6)) for j in order]
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_pivots_equal_brute_force(spark, monkeypatch, k):
    draw = np.random.default_rng(k)
    middles = draw.normal(size=(25, 33)) * 4
    points = np.concatenate([middles[draw.integers(0, 25, 700)] + draw.normal(size=(700, 33)) * 0.3, np.repeat(middles[:1], 5, axis=0)])
    asked = np.concatenate([points[:150] + 0.01, draw.normal(size=(60, 33)) * 4])
    monkeypatch.setattr(neighbors, "FEW", 20)
    q, p = cloud(spark, asked), cloud(spark, points)
    got = {}
    for r in neighbors.nearest(q, p, k, AXES).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((r["pid"], round(r["d"], 6)))
    assert {i: [d for _, d in v] for i, v in got.items()} == {i: [d for _, d in v] for i, v in brute(asked, points, k).items()}
    assert sum(got[i] == v for i, v in brute(asked, points, k).items()) >= len(asked) - 5  # equal distances may round apart
    with Workspace(spark) as work:
        made = neighbors.pivot_pairs(q, p, k, AXES, 52, work).count()
    assert made < len(asked) * len(points) / 2 and neighbors.pivot_pairs(q.limit(0), p, k, AXES, 5, Workspace(spark)).count() == 0


def test_fewer_points_than_asked(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "FEW", 1)
    draw = np.random.default_rng(9)
    q, p = cloud(spark, draw.normal(size=(6, 33))), cloud(spark, draw.normal(size=(4, 33)))
    got = neighbors.nearest(q, p, 7, AXES)
    assert got.groupBy("qid").count().where(F.col("count") == 4).count() == 6
