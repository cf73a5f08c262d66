"""Oriented normals: the tree against Kruskal's, planted shells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import orient, register, workflows


def kruskal(links):
    """(root, sign against it) of each node, by sorting all links; the root is the smallest node."""
    part, sign, members = {}, {}, {}
    for a, b, *_ in links:
        for x in (a, b):
            part.setdefault(x, x), sign.setdefault(x, 1), members.setdefault(x, [x])
    for _, a, b, s in sorted((w, a, b, s) for a, b, w, s in links if a != b):
        p, q = part[a], part[b]
        if p == q:
            continue
        turn = sign[a] * sign[b] * s
        for x in members[q]:
            part[x], sign[x] = p, sign[x] * turn
        members[p] += members.pop(q)
    for p, own in list(members.items()):
        least = min(own)
        turn = sign[least]
        for x in own:
            part[x], sign[x] = least, sign[x] * turn
    return {x: (part[x], sign[x]) for x in part}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_signs_equal_kruskal(spark, seed):
    draw = random.Random(seed)
    links = []
    for base, n in ((0, 60), (1000, 25), (2000, 2)):
        for _ in range(4 * n):
            a, b = sorted(draw.sample(range(n), 2))
            links.append((base + a, base + b, draw.choice([0.0, 0.25, draw.random()]), draw.choice([-1, 1])))
    # One sign for each pair and weight, as links of a cloud have.
    links = list({(a, b): (a, b, w, s) for a, b, w, s in links}.values()) + [(5, 5, 0.0, -1)]
    got = {r["node"]: (r["root"], r["sign"]) for r in orient.spanning_signs(spark.createDataFrame(links, "a long, b long, weight double, sign int")).collect()}
    want = kruskal(links)
    groups = lambda m: {frozenset(x for x in m if m[x][0] == r) for r in {v[0] for v in m.values()}}
    assert groups(got) == groups(want)
    for own in groups(want):
        first = min(own)
        assert {x: got[x][1] * got[first][1] for x in own} == {x: want[x][1] * want[first][1] for x in own}


def test_signs_of_no_links(spark):
    assert orient.spanning_signs(spark.createDataFrame([], "a long, b long, weight double, sign int")).count() == 0


def shell(n, radius, center, first):
    """Points spread over a sphere with their outward normals."""
    out = []
    for i in range(n):
        z = 1 - 2 * (i + 0.5) / n
        flat, turn = math.sqrt(1 - z * z), i * math.pi * (3 - math.sqrt(5))
        v = (flat * math.cos(turn), flat * math.sin(turn), z)
        out.append((first + i, *[c + radius * x for c, x in zip(center, v, strict=True)], *v))
    return out


def test_shells_face_outward(spark):
    draw = random.Random(7)
    rows = shell(260, 5.0, (0.0, 0.0, 0.0), 0) + shell(120, 2.0, (40.0, 0.0, -30.0), 1000) + [(5000, 400.0, 0.0, 0.0, 0.0, 0.0, -1.0)]
    given = [(i, x, y, z, *[s * v for v in n]) for i, x, y, z, *n in rows for s in [draw.choice([-1.0, 1.0]) if i != 5000 else 1.0]]
    cloud = spark.createDataFrame(given, "point_id long, x double, y double, z double, nx double, ny double, nz double")
    # The lone point's nearest lie in the small shell, so it hangs on that tree; without it both shells are whole.
    got = {r["point_id"]: r for r in orient.oriented(cloud.where("point_id < 5000"), 8).collect()}
    assert len(got) == 380
    for i, _, _, _, *n in rows[:-1]:
        assert np.allclose([got[i][c] for c in orient.NORMAL], n)
    assert {i for i in got if got[i]["flipped"]} == {g[0] for g, r in zip(given, rows, strict=True) if g[4:] != r[4:] and g[0] < 5000}
    alone = orient.oriented(cloud.where("point_id = 5000")).first()
    assert alone["flipped"] and alone["nz"] == 1.0


def test_prepared_cloud(spark):
    """A dense box shell comes out thinner, with colours, and with normals that face away from its middle."""
    draw = np.random.default_rng(3)
    at = draw.normal(size=(4000, 3))
    at = 6 * at / np.linalg.norm(at, axis=1, keepdims=True)
    cloud = spark.createDataFrame([(i, *map(float, p), 0.5, 0.25, 1.0) for i, p in enumerate(at)], "point_id long, x double, y double, z double, r double, g double, b double")
    thin = workflows.prepare(cloud, target=1.0, normals=False)
    assert thin.columns == ["point_id", "x", "y", "z", "r", "g", "b"] and 300 < thin.count() < 2000
    out = workflows.prepare(cloud, target=1.0, radius=2.5).collect()
    assert len(out) == thin.count() and all(abs(r["r"] - 0.5) < 1e-9 and abs(r["b"] - 1) < 1e-9 for r in out)
    outward = [r["nx"] * r["x"] + r["ny"] * r["y"] + r["nz"] * r["z"] > 0 for r in out]
    assert all(outward)
    whole = workflows.prepare(cloud.limit(50), by_voxel=False)
    assert whole.count() == 50 and register.normals(cloud.limit(50), 2.0, 10).select(F.count("*")).first()[0] == 50
