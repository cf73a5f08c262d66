"""Queries of the neighbour joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cloudloom.functions.geometry import AXES, affine
from cloudloom.operators import neighbors, register
from cloudloom.sources.clouds import EMBEDDINGS_SQL, EVENTS_SQL, embeddings_cloud, events_cloud

SHIFT = 0.5


def _colored(cloud):
    return cloud.withColumn("color", F.get(F.array(*map(F.lit, ["red", "green", "black", "white"])), F.col("label") % 4))


def _moved(cloud):
    return cloud.withColumns({a: F.col(a) + SHIFT for a in AXES})


def _masks(cloud):
    return cloud.select("point_id", (F.col("x") > 0).alias("red"), (F.col("label") % 2 == 0).alias("blue"), (F.col("label") % 3 == 0).alias("black"), (F.col("y") > 0).alias("green"))


def _by_sets(s, d):
    """The same by set operations: (red less blue) with (black less green), and (blue less red) with (green less black)."""
    m = _masks(embeddings_cloud(s, d))
    ids = lambda c: m.where(c).select("point_id")
    return ids("red").subtract(ids("blue")).intersect(ids("black").subtract(ids("green"))).union(ids("blue").subtract(ids("red")).intersect(ids("green").subtract(ids("black"))))


def _pairs(df):
    return df.select(F.col("qid").alias("point_id"), F.col("pid").alias("neighbor_id"), F.round("d", 9).alias("d"), F.col("place").cast("int").alias("place"))


def _correct(s, d, k: int = 2):
    """Normals of label 9 turned round, with those near them that disagree."""
    cloud = embeddings_cloud(s, d)
    out = neighbors.corrected_normals(cloud, cloud.where("label = 9"), k)
    return out.select("point_id", "flipped", *[F.round(c, 9).alias(c) for c in ("nx", "ny", "nz")])


def _fpfh(s, d):
    return register.fpfh(embeddings_cloud(s, d), 8.0, 100).select("point_id", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(33)])


def _registered(s, d):
    """The cloud turned and moved far, and brought back over several scales: what was reached."""
    target = embeddings_cloud(s, d).select("point_id", "x", "y", "z")
    turn = [[0.0, -1.0, 0.0, 30.0], [1.0, 0.0, 0.0, -12.0], [0.0, 0.0, 1.0, 7.0], [0.0, 0.0, 0.0, 1.0]]
    matrix, log = register.register(affine(target, turn), target, (4.0, 5.0), icp_fitness=(0.65, 0.70), most_tries=3)
    error = float(np.abs(matrix @ np.array(turn) - np.eye(4)).max())
    return s.createDataFrame([(log["tries"], float(log["ransac"]), float(log["icp"]), round(error, 6))], "tries int, ransac_fitness double, icp_fitness double, error double")


def _equations(s, d):
    target = embeddings_cloud(s, d)
    out = register.normal_equations(register.correspondences(_moved(target), target, 4.0))
    return out.select(*[F.round(c, 6).alias(c) if c != "n" else F.col(c) for c in out.columns])


def _icp(s, d):
    """A cloud turned and moved a little, brought back: the fitness, and how far the found motion is from the true one."""
    target = embeddings_cloud(s, d)
    a = 0.002
    motion = np.array([[np.cos(a), -np.sin(a), 0, 0.05], [np.sin(a), np.cos(a), 0, -0.04], [0, 0, 1, 0.03], [0, 0, 0, 1]])
    found, fitness = register.icp(affine(target, np.linalg.inv(motion).tolist()), target, 1.0, rounds=4)
    return s.createDataFrame([(float(fitness), round(float(np.abs(found - motion).max()), 6))], "fitness double, error double")


def _ransac(s, d):
    """Pairs of which a tenth is wrong: the best attempts and how many pairs they fit."""
    cloud = embeddings_cloud(s, d)
    moved = affine(cloud, [[0.0, -1.0, 0.0, 5.0], [1.0, 0.0, 0.0, -2.0], [0.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]])
    wrong = F.when(F.col("point_id") % 10 == 0, 40.0).otherwise(0.0)
    pairs = cloud.select(F.col("point_id").alias("pair_id"), *[F.col(a).alias(f"s{a}") for a in AXES]).join(moved.select(F.col("point_id").alias("pair_id"), *[(F.col(a) + wrong).alias(f"t{a}") for a in AXES]), "pair_id")
    return register.ransac(pairs, 0.5).select("attempt", "inliers", F.transform(F.flatten("transform"), lambda v: F.round(v, 6)).alias("transform"))


QUERIES = {
    "icp_register": _icp,
    "fpfh": _fpfh,
    "register_scales": _registered,
    "ransac_register": _ransac,
    "knn_self": lambda s, d: _pairs(neighbors.nearest(embeddings_cloud(s, d), embeddings_cloud(s, d), 8)),
    "knn_cells": lambda s, d: _pairs(neighbors.nearest(events_cloud(s, d), events_cloud(s, d), 4)),
    "knn_two_sides": lambda s, d: _pairs(neighbors.nearest(embeddings_cloud(s, d).where("label = 0"), embeddings_cloud(s, d).where("label <> 0"), 12)),
    "radius_neighbors": lambda s, d: _pairs(neighbors.capped(neighbors.within(embeddings_cloud(s, d), embeddings_cloud(s, d), 5.0), 10)),
    "exact_match": lambda s, d: neighbors.exact_matches(embeddings_cloud(s, d).where("label < 5"), embeddings_cloud(s, d)),
    "remove_nearest": lambda s, d: neighbors.remove_nearest(embeddings_cloud(s, d), _moved(embeddings_cloud(s, d).where("label = 9"))).select("point_id"),
    "majority_color_knn": lambda s, d: neighbors.majority(embeddings_cloud(s, d), _colored(embeddings_cloud(s, d)), 8),
    "inconsistency_flags": lambda s, d: neighbors.inconsistent(_masks(embeddings_cloud(s, d))).select("point_id"),
    "inconsistency_flags_intersect": _by_sets,
    "normal_correction": _correct,
    "icp_normal_equations": _equations,
    "height_masks_full": lambda s, d: neighbors.height_masks(embeddings_cloud(s, d), 4.0),
    "normals": lambda s, d: register.normals(embeddings_cloud(s, d), 8.0, 30).select("point_id", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")]),
}

_CLOUD = f"WITH e AS MATERIALIZED (SELECT * FROM {EMBEDDINGS_SQL})"
_D = "sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z))"


def _nearest(left: str, right: str, k: int, most: str = "TRUE", columns: str = "") -> str:
    return f"""(SELECT * FROM (SELECT q.point_id, p.point_id AS neighbor_id, {_D} AS d, row_number() OVER (PARTITION BY q.point_id ORDER BY {_D}, p.point_id) AS place {columns}
 FROM {left} q, {right} p WHERE {most}) WHERE place <= {k})"""


_SHOWN = "point_id, neighbor_id, round(d, 9) AS d, CAST(place AS INT) AS place"
_COLOR = "list_extract(['red', 'green', 'black', 'white'], label % 4 + 1)"
_VOTES = ", ".join(f"count(*) FILTER (color = '{c}') AS {c}" for c in ("red", "green", "black", "white"))
_MAJORITY = "CASE greatest(red, green, black, white) WHEN red THEN 'red' WHEN green THEN 'green' WHEN black THEN 'black' ELSE 'white' END"
_FLAGS = "x > 0 AS red, label % 2 = 0 AS blue, label % 3 = 0 AS black, y > 0 AS green"
_FLAGGED = f"{_CLOUD} SELECT point_id FROM (SELECT point_id, {_FLAGS} FROM e) WHERE (red AND NOT blue AND black AND NOT green) OR (blue AND NOT red AND green AND NOT black)"
_J = ["(sy * nz - sz * ny)", "(sz * nx - sx * nz)", "(sx * ny - sy * nx)", "nx", "ny", "nz"]
_E = "((sx - tx) * nx + (sy - ty) * ny + (sz - tz) * nz)"
_SIGNS = " OR ".join(f"sign(t.{c}) <> sign(-m.{c})" for c in ("nx", "ny", "nz"))


def _masks_sql() -> str:
    return f"""{_CLOUD}, cells AS (SELECT arg_max(point_id, row(z, -point_id)) AS top, arg_min(point_id, row(z, point_id)) AS bottom FROM e GROUP BY floor(x / 4), floor(y / 4)),
 c0 AS MATERIALIZED (SELECT point_id, x, y, z, CASE WHEN point_id IN (SELECT top FROM cells) AND point_id IN (SELECT bottom FROM cells) THEN 'black' WHEN point_id IN (SELECT top FROM cells) THEN 'red'
  WHEN point_id IN (SELECT bottom FROM cells) THEN 'green' ELSE 'white' END AS color FROM e),
 v1 AS (SELECT point_id, {_VOTES} FROM {_nearest('c0', 'c0', 128, columns=', p.color')} GROUP BY point_id),
 c1 AS MATERIALIZED (SELECT point_id, x, y, z, {_MAJORITY} AS color FROM v1 JOIN (SELECT point_id, x, y, z FROM c0) USING (point_id)),
 v2 AS (SELECT point_id, {_VOTES} FROM {_nearest("(SELECT * FROM c1 WHERE color = 'black')", "(SELECT * FROM c1 WHERE color <> 'black')", 12, columns=', p.color')} GROUP BY point_id)
 SELECT point_id, CASE WHEN red IS NULL THEN color ELSE {_MAJORITY} END AS color FROM c1 LEFT JOIN v2 USING (point_id)"""


def _fpfh_sql() -> str:
    dot = lambda a, b: f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"
    cross = lambda t, a, b: ", ".join(f"{a}{y} * {b}{z} - {a}{z} * {b}{y} AS {t}{x}" for x, y, z in ("xyz", "yzx", "zxy"))
    bin_ = lambda x, n: f"CAST(least(greatest(floor(11 * CASE WHEN vn = 0 OR d = 0 THEN 0.5::DOUBLE ELSE {x} END), 0), 10) AS INT) AS b{n}"
    own = ", ".join(f"count(*) FILTER (b{i // 11} = {i % 11}) * 100.0::DOUBLE / count(*) AS f{i}" for i in range(33))
    sums = ", ".join(f"sum(h.f{i} / (p.d * p.d)) AS s{i}" for i in range(33))
    thirds = ["(" + " + ".join(f"s{j}" for j in range(11 * t, 11 * t + 11)) + ")" for t in range(3)]
    return f"""{_CLOUD}, pairs AS (SELECT k.point_id, k.neighbor_id, k.d, q.nx AS mx, q.ny AS my, q.nz AS mz, p.nx AS ox, p.ny AS oy, p.nz AS oz, p.x - q.x AS ex, p.y - q.y AS ey, p.z - q.z AS ez
  FROM {_nearest('e', 'e', 100, f'{_D} <= 8')} k JOIN e q ON q.point_id = k.point_id JOIN e p ON p.point_id = k.neighbor_id WHERE k.point_id <> k.neighbor_id),
 c AS (SELECT *, {dot('m', 'e')} / d AS c1, {dot('o', 'e')} / d AS c2 FROM pairs),
 t AS (SELECT point_id, neighbor_id, d, CASE WHEN abs(c1) < abs(c2) THEN -c2 ELSE c1 END AS a, {', '.join(f'CASE WHEN abs(c1) < abs(c2) THEN o{x} ELSE m{x} END AS n{x}, CASE WHEN abs(c1) < abs(c2) THEN m{x} ELSE o{x} END AS l{x}, CASE WHEN abs(c1) < abs(c2) THEN -e{x} ELSE e{x} END AS g{x}' for x in 'xyz')} FROM c),
 u AS (SELECT *, {cross('u', 'g', 'n')} FROM t), v0 AS (SELECT *, sqrt({dot('u', 'u')}) AS vn FROM u), v AS (SELECT *, ux / vn AS vx, uy / vn AS vy, uz / vn AS vz FROM v0), w AS (SELECT *, {cross('w', 'n', 'v')} FROM v),
 b AS MATERIALIZED (SELECT point_id, neighbor_id, d, {bin_(f"(atan2({dot('w', 'l')}, {dot('n', 'l')}) + pi()) / (2 * pi())", 0)}, {bin_(f"({dot('v', 'l')} + 1) / 2", 1)}, {bin_('(a + 1) / 2', 2)} FROM w),
 h AS MATERIALIZED (SELECT point_id, {own} FROM b GROUP BY point_id), s AS (SELECT p.point_id, {sums} FROM b p JOIN h ON h.point_id = p.neighbor_id WHERE p.d > 0 GROUP BY p.point_id)
 SELECT e.point_id, {', '.join(f'round(coalesce(h.f{i} + coalesce(CASE WHEN {thirds[i // 11]} <> 0 THEN s.s{i} * 100 / {thirds[i // 11]} END, 0), 0), 6) AS f{i}' for i in range(33))} FROM e LEFT JOIN h USING (point_id) LEFT JOIN s USING (point_id)"""


SQL = {
    "fpfh": _fpfh_sql(),
    # Top lists instead of a window: every point of the larger cloud asks, more than are ever sent to all points.
    "knn_cells": f"""WITH cloud AS MATERIALIZED (SELECT * FROM {EVENTS_SQL}),
 near AS (SELECT q.point_id AS qid, min({{'d': sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)), 'pid': p.point_id}}, 4) AS best FROM cloud q, cloud p GROUP BY q.point_id)
 SELECT qid AS point_id, best[place].pid AS neighbor_id, round(best[place].d, 9) AS d, CAST(place AS INT) AS place FROM near, (SELECT unnest([1, 2, 3, 4]) AS place)""",
    "knn_self": f"{_CLOUD} SELECT {_SHOWN} FROM {_nearest('e', 'e', 8)}",
    "knn_two_sides": f"{_CLOUD} SELECT {_SHOWN} FROM {_nearest('(SELECT * FROM e WHERE label = 0)', '(SELECT * FROM e WHERE label <> 0)', 12)}",
    "radius_neighbors": f"{_CLOUD} SELECT {_SHOWN} FROM {_nearest('e', 'e', 10, f'{_D} <= 5')}",
    "exact_match": f"{_CLOUD} SELECT q.point_id, min(p.point_id) AS match_id FROM e q JOIN e p ON q.x = p.x AND q.y = p.y AND q.z = p.z AND p.label < 5 GROUP BY q.point_id",
    "remove_nearest": f"{_CLOUD} SELECT point_id FROM e WHERE point_id NOT IN (SELECT neighbor_id FROM {_nearest(f'(SELECT point_id, x + {SHIFT}::DOUBLE AS x, y + {SHIFT}::DOUBLE AS y, z + {SHIFT}::DOUBLE AS z FROM e WHERE label = 9)', 'e', 1)})",
    "majority_color_knn": f"{_CLOUD} SELECT point_id, {_MAJORITY} AS color FROM (SELECT point_id, {_VOTES} FROM {_nearest('e', f'(SELECT *, {_COLOR} AS color FROM e)', 8, columns=', p.color')} GROUP BY point_id)",
    "inconsistency_flags": _FLAGGED,
    "inconsistency_flags_intersect": _FLAGGED,
    "normal_correction": f"""{_CLOUD}, turned AS (SELECT DISTINCT t.point_id FROM {_nearest('(SELECT * FROM e WHERE label = 9)', 'e', 3)} k JOIN e m ON m.point_id = k.point_id JOIN e t ON t.point_id = k.neighbor_id
 WHERE k.point_id <> k.neighbor_id AND t.label <> 9 AND ({_SIGNS})), f AS (SELECT *, label = 9 OR point_id IN (SELECT point_id FROM turned) AS flipped FROM e)
 SELECT point_id, flipped, {', '.join(f'round(CASE WHEN flipped THEN -{c} ELSE {c} END, 9) AS {c}' for c in ('nx', 'ny', 'nz'))} FROM f""",
    "icp_normal_equations": f"""{_CLOUD}, s AS (SELECT point_id, x + {SHIFT}::DOUBLE AS x, y + {SHIFT}::DOUBLE AS y, z + {SHIFT}::DOUBLE AS z FROM e),
 pairs AS (SELECT s.x AS sx, s.y AS sy, s.z AS sz, t.x AS tx, t.y AS ty, t.z AS tz, t.nx, t.ny, t.nz FROM {_nearest('s', 'e', 1, f'{_D} <= 4')} k JOIN s ON s.point_id = k.point_id JOIN e t ON t.point_id = k.neighbor_id)
 SELECT count(*) AS n, round(sum({_E} * {_E}), 6) AS squares, {', '.join(f'round(sum({_J[i]} * {_J[k]}), 6) AS a{i}{k}' for i in range(6) for k in range(i, 6))}, {', '.join(f'round(sum({_J[i]} * {_E}), 6) AS b{i}' for i in range(6))} FROM pairs""",
    "height_masks_full": _masks_sql(),
}
