"""Queries of clusters, knees and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.geometry import cell, cylinders
from cloudloom.jobs.cloud_queries import rounded
from cloudloom.operators import clusters, curves, raster, workflows
from cloudloom.sources.clouds import EMBEDDINGS_SQL, EVENTS_SQL, PARTS_SQL, embeddings_cloud, events_cloud, part_curves
from cloudloom.sources.shared import saved

CENTERS = [(0.2, 0.3, 0.4), (0.7, 0.6, 0.5)]
COV = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def _edges(s, d):
    return curves.edges(part_curves(s, d))


def _axes(s, d):
    cloud = embeddings_cloud(s, d)
    return cloud, raster.principal_axes(cloud)


def _roundtrip(s, d):
    cloud, axes = _axes(s, d)
    back = raster.to_axes(raster.to_axes(cloud, axes), axes, back=True)
    return rounded(back.select("point_id", "x", "y", "z"), "x", "y", "z")


def _aligned(s, d):
    """The variances along the principal axes, largest first, and the mean, which is 0."""
    cloud, axes = _axes(s, d)
    out = clusters.covariance(raster.to_axes(cloud, axes))
    return out.select("segment_id", "n", *[F.round(c, 6).alias(c) for c in ("cxx", "cyy", "czz")], *[(F.abs(F.col(c)) < 1e-6).alias(c) for c in ("cxy", "cxz", "cyz")])


def _inconsistent(s, d):
    """Every point of the cloud is asked for: which lie in large, not too thin clusters."""
    cloud = embeddings_cloud(s, d)
    return workflows.inconsistent_clusters(cloud, cloud, start=300, least=5)


def _lines(s, d):
    return workflows.line_points(embeddings_cloud(s, d), "white", size=6.0)


def _parts(s, d):
    """The parts of each brand in their order, numbered from 0."""
    return saved(curves.numbered(part_curves(s, d), "segment", ["seq"]))


def _merged_lines(s, d):
    """The edges of all brands' lines as one line set, with the places of their ends."""
    own = _parts(s, d)
    vertices, edges = curves.merged(own, curves.path(own, "segment"), "segment")
    ends = [vertices.select(F.col("vertex").alias(c), *[F.col(a).alias(f"{a}_{c}") for a in "xyz"]) for c in "ab"]
    return rounded(edges.join(ends[0], "a").join(ends[1], "b").select("segment", "a", "b", *[f"{a}_{c}" for c in "ab" for a in "xyz"]), *[f"{a}_{c}" for c in "ab" for a in "xyz"])


def _curves(s, d):
    return curves.cluster_curves(embeddings_cloud(s, d)).select("label", "vertex", "point_id", *[F.round(a, 4).alias(a) for a in "xyz"])


QUERIES = {
    "merged_lines": _merged_lines,
    "cluster_curves": _curves,
    "cluster_aspects": lambda s, d: clusters.aspects(embeddings_cloud(s, d)).select("label", F.round("aspect", 6).alias("aspect")),
    "cluster_similarity_aspects": lambda s, d: clusters.similarity(embeddings_cloud(s, d), "label", clusters.aspects(embeddings_cloud(s, d))).select("a", "b", F.round("similarity", 6).alias("similarity")),
    "cluster_groups": lambda s, d: clusters.grouped(embeddings_cloud(s, d)).select("point_id", "label", "group_label"),
    "inconsistent_clusters": _inconsistent,
    "cloud_paint": lambda s, d: s.createDataFrame([(workflows.paint(events_cloud(s, d)),)], "paint string"),
    "split_by_color": lambda s, d: workflows.split_by_color(events_cloud(s, d)).select("point_id", "label"),
    "line_points": lambda s, d: _lines(s, d).select("point_id"),
    "line_clusters": lambda s, d: workflows.line_clusters(saved(_lines(s, d)), 300, 0.01).select("point_id", "label"),
    "k_distance_curve": lambda s, d: rounded(clusters.k_distance(embeddings_cloud(s, d)), "d"),
    "k_distance_gradient": lambda s, d: rounded(clusters.gradient(clusters.k_distance(embeddings_cloud(s, d))), "d", "slope"),
    "k_distance_smoothed": lambda s, d: rounded(clusters.smoothed(clusters.gradient(clusters.k_distance(embeddings_cloud(s, d)))).where("smooth IS NOT NULL").select("rank", "smooth"), "smooth"),
    "epsilon_knee": lambda s, d: rounded(clusters.epsilon(embeddings_cloud(s, d), 30, 0.01), "eps"),
    "dbscan": lambda s, d: clusters.dbscan(embeddings_cloud(s, d), 3.0).select("point_id", "label"),
    "dbscan_without_noise": lambda s, d: clusters.dbscan(embeddings_cloud(s, d), 3.0).where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "cluster_sizes": lambda s, d: clusters.cluster_sizes(embeddings_cloud(s, d)),
    "filter_clusters_by_size": lambda s, d: clusters.filter_by_size(embeddings_cloud(s, d), 50).select("point_id", "label"),
    "covariance_by_segment": lambda s, d: rounded(clusters.covariance(embeddings_cloud(s, d)), "mx", "my", "mz", *[f"c{a}{b}" for a, b in COV]),
    "cluster_similarity": lambda s, d: rounded(clusters.similarity(embeddings_cloud(s, d)), "similarity"),
    "kmeans_assign": lambda s, d: clusters.assign(events_cloud(s, d), CENTERS, ("r", "g", "b")).select("point_id", "label"),
    "kmeans_update": lambda s, d: rounded(clusters.update(clusters.assign(events_cloud(s, d), CENTERS, ("r", "g", "b")), ("r", "g", "b")), *"rgb"),
    "kmeans_full": lambda s, d: clusters.kmeans(embeddings_cloud(s, d), 4, ("nx", "ny", "nz")).select("point_id", "label"),
    "segment_cloud": lambda s, d: clusters.segment(embeddings_cloud(s, d).drop("segment_id", "label"), 3, least=4, start=30, threshold=0.01).select("point_id", "part", "segment_id"),
    "cluster_max_z": lambda s, d: clusters.extreme_clusters(embeddings_cloud(s, d)),
    "brightest_cluster": lambda s, d: clusters.brightest(embeddings_cloud(s, d)),
    "adaptive_threshold_voxel": lambda s, d: clusters.adaptive(events_cloud(s, d), [cell(F.col(a), 2.0) for a in "xyz"], -7).select("point_id"),
    "adaptive_threshold_cluster": lambda s, d: clusters.adaptive(embeddings_cloud(s, d), [F.col("label")], -3).select("point_id"),
    "curve_edges": lambda s, d: _edges(s, d).select("segment", "seq", "x", "y", "z", "x2", "y2", "z2"),
    "cylinder_params": lambda s, d: rounded(cylinders(_edges(s, d)).select("segment", "seq", "axis_x", "axis_y", "angle", "height", "radius"), "axis_x", "axis_y", "angle", "height"),
    "poly_curves": lambda s, d: curves.polynomials(part_curves(s, d), "segment", "x", "y", 3).select("segment", "n", F.transform("coefficients", lambda c: F.round(c, 4)).alias("coefficients")),
    "pca_align": _aligned,
    "pca_roundtrip": _roundtrip,
}

_CLOUD = f"WITH e AS MATERIALIZED (SELECT * FROM {EMBEDDINGS_SQL})"
_CURVE = f"""{_CLOUD}, near AS (SELECT q.point_id, (SELECT d FROM (SELECT sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS d FROM e p) ORDER BY d LIMIT 1 OFFSET 1) AS d FROM e q),
 curve AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d, point_id) - 1 AS rank, d FROM near)"""
_SLOPE = f"""{_CURVE}, slopes AS MATERIALIZED (SELECT rank, d, coalesce((lead(d) OVER w - lag(d) OVER w) / 2, CASE WHEN rank = 0 THEN (-3 * d + 4 * lead(d) OVER w - lead(d, 2) OVER w) / 2 END,
  (3 * d - 4 * lag(d) OVER w + lag(d, 2) OVER w) / 2) AS slope FROM curve WINDOW w AS (ORDER BY rank))"""
_SMOOTH = f"""{_SLOPE}, smooth AS MATERIALIZED (SELECT a.rank, a.d, sum(b.slope * (4307290 - 11050 * (b.rank - a.rank) * (b.rank - a.rank))::DOUBLE / (51 * 4307290 - 11050 * 11050)::DOUBLE) AS smooth
  FROM slopes a JOIN slopes b ON b.rank BETWEEN a.rank - 25 AND a.rank + 25 GROUP BY a.rank, a.d HAVING count(*) = 51)"""
_DBSCAN = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EMBEDDINGS_SQL}),
 near AS MATERIALIZED (SELECT q.point_id AS a, p.point_id AS b FROM e q, e p WHERE sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) <= 3),
 core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
 reach(id, root) AS (SELECT id, id FROM core UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.id JOIN core ON core.id = near.b),
 roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
 named AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
 border AS (SELECT near.b AS id, min(label) AS label FROM near JOIN named ON named.id = near.a GROUP BY near.b),
 labelled AS (SELECT e.point_id, CAST(coalesce(named.label, border.label, -1) AS INT) AS label FROM e LEFT JOIN named ON named.id = e.point_id LEFT JOIN border ON border.id = e.point_id)"""
_DIST = [" + ".join(f"({c} - {v}::DOUBLE) * ({c} - {v}::DOUBLE)" for c, v in zip("rgb", m, strict=True)) for m in CENTERS]
_ASSIGNED = f"(SELECT *, CASE WHEN {_DIST[1]} < {_DIST[0]} THEN 1 ELSE 0 END AS label FROM {EVENTS_SQL})"
_LEVEL = {c: f"round_even({c} * 255, 0)" for c in "rgb"}
_EDGES = f"(SELECT * FROM (SELECT *, {', '.join(f'lead({a}) OVER (PARTITION BY segment ORDER BY seq) AS {a}2' for a in 'xyz')} FROM {PARTS_SQL}) WHERE x2 IS NOT NULL)"
_FROBENIUS = " + ".join(f"{1 if a == b else 2} * (p.c{a}{b} - q.c{a}{b}) * (p.c{a}{b} - q.c{a}{b})" for a, b in COV)


def _adaptive(cloud: str, keys: str, c: int) -> str:
    return f"""SELECT point_id FROM (SELECT point_id, greatest({', '.join(_LEVEL.values())}) AS top, avg(({' + '.join(_LEVEL.values())}) / 3) OVER (PARTITION BY {keys}) - ({c}) AS cut FROM {cloud}) WHERE top >= round(cut, 9)"""


SQL = {
    "merged_lines": f"""WITH own AS (SELECT *, row_number() OVER (ORDER BY segment, seq) - 1 AS a FROM {PARTS_SQL})
 SELECT p.segment, p.a, q.a AS b, {", ".join(f"round({t}.{c}, 9) AS {c}_{n}" for t, n in (("p", "a"), ("q", "b")) for c in "xyz")} FROM own p JOIN own q ON q.segment = p.segment AND q.a = p.a + 1""",
    "k_distance_curve": f"{_CURVE} SELECT rank, round(d, 9) AS d FROM curve",
    "k_distance_gradient": f"{_SLOPE} SELECT rank, round(d, 9) AS d, round(slope, 9) AS slope FROM slopes",
    "k_distance_smoothed": f"{_SMOOTH} SELECT rank, round(smooth, 9) AS smooth FROM smooth",
    "epsilon_knee": f"{_SMOOTH} SELECT round(arg_min(d, rank), 9) AS eps FROM smooth WHERE rank >= 30 AND smooth > 0.01",
    "dbscan": f"{_DBSCAN} SELECT point_id, label FROM labelled",
    "dbscan_without_noise": f"{_DBSCAN} SELECT label, count(*) AS n FROM labelled WHERE label >= 0 GROUP BY label",
    "cluster_sizes": f"SELECT label, count(*) AS n FROM {EMBEDDINGS_SQL} WHERE label >= 0 GROUP BY label",
    "filter_clusters_by_size": f"SELECT point_id, label FROM {EMBEDDINGS_SQL} WHERE label IN (SELECT label FROM embeddings WHERE label >= 0 GROUP BY label HAVING count(*) >= 50)",
    "covariance_by_segment": f"SELECT segment_id, count(*) AS n, {', '.join(f'round(avg({a}), 9) AS m{a}' for a in 'xyz')}, {', '.join(f'round(covar_samp({a}, {b}), 9) AS c{a}{b}' for a, b in COV)} FROM {EMBEDDINGS_SQL} GROUP BY segment_id",
    "cluster_similarity": f"WITH c AS (SELECT label, {', '.join(f'covar_samp({a}, {b}) AS c{a}{b}' for a, b in COV)} FROM {EMBEDDINGS_SQL} GROUP BY label) SELECT p.label AS a, q.label AS b, round(1 / (sqrt({_FROBENIUS}) + 1e-5), 9) AS similarity FROM c p, c q WHERE p.label <> q.label",
    "kmeans_assign": f"SELECT point_id, label FROM {_ASSIGNED}",
    "kmeans_update": f"SELECT label, count(*) AS n, {', '.join(f'round(avg({c}), 9) AS {c}' for c in 'rgb')} FROM {_ASSIGNED} GROUP BY label",
    "cluster_max_z": f"SELECT arg_max(label, row(z, -point_id)) AS max_label, arg_min(label, row(z, point_id)) AS min_label FROM {EMBEDDINGS_SQL}",
    "brightest_cluster": f"SELECT arg_max(label, row(light, -label)) AS label, max(light) AS light FROM (SELECT label, round(avg(r) + avg(g) + avg(b), 9) AS light FROM {EMBEDDINGS_SQL} GROUP BY label)",
    "adaptive_threshold_voxel": _adaptive(EVENTS_SQL, "floor(x / 2), floor(y / 2), floor(z / 2)", -7),
    "adaptive_threshold_cluster": _adaptive(EMBEDDINGS_SQL, "label", -3),
    "curve_edges": f"SELECT segment, seq, x, y, z, x2, y2, z2 FROM {_EDGES}",
    "cylinder_params": f"""SELECT segment, seq, round(CASE WHEN flat = 0 THEN 0 ELSE -dy / flat END, 9) AS axis_x, round(CASE WHEN flat = 0 THEN 0 ELSE dx / flat END, 9) AS axis_y, round(CASE WHEN flat = 0 THEN 0 ELSE acos(dz / length) END, 9) AS angle,
 round(length * 2, 9) AS height, 0.2::DOUBLE AS radius FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS length, sqrt(dx * dx + dy * dy) AS flat FROM (SELECT *, x2 - x AS dx, y2 - y AS dy, z2 - z AS dz FROM {_EDGES})) WHERE length > 0""",
    "pca_roundtrip": f"SELECT point_id, {', '.join(f'round({a}, 9) AS {a}' for a in 'xyz')} FROM {EMBEDDINGS_SQL}",
}
