"""Queries of oriented normals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.jobs.cloud_queries import rounded
from cloudloom.operators import orient, workflows
from cloudloom.sources.clouds import EMBEDDINGS_SQL, embeddings_cloud, events_cloud

QUERIES = {
    "tangent_links": lambda s, d: rounded(orient.tangent_links(embeddings_cloud(s, d)), "weight"),
    "oriented_normals": lambda s, d: rounded(orient.oriented(embeddings_cloud(s, d)).select("point_id", "flipped", *orient.NORMAL), *orient.NORMAL),
    "prepared_cloud": lambda s, d: rounded(workflows.prepare(events_cloud(s, d)), *"xyz", *"rgb", *orient.NORMAL),
}

_LINKS = f"""cloud AS MATERIALIZED (SELECT * FROM {EMBEDDINGS_SQL}),
 near AS (SELECT q.point_id AS qid, p.point_id AS pid, row_number() OVER (PARTITION BY q.point_id ORDER BY sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)), p.point_id) AS place FROM cloud q, cloud p),
 pairs AS (SELECT DISTINCT least(qid, pid) AS a, greatest(qid, pid) AS b FROM near WHERE place <= 10 AND qid <> pid),
 links AS MATERIALIZED (SELECT pairs.a, pairs.b, 1 - abs(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz) AS weight, CASE WHEN p.nx * q.nx + p.ny * q.ny + p.nz * q.nz < 0 THEN -1 ELSE 1 END AS sign
  FROM pairs JOIN cloud p ON p.point_id = pairs.a JOIN cloud q ON q.point_id = pairs.b),
 numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight, a, b) AS n FROM links), ways AS MATERIALIZED (SELECT a, b, n, sign FROM numbered UNION ALL SELECT b, a, n, sign FROM numbered)"""

SQL = {
    "tangent_links": f"WITH {_LINKS} SELECT a, b, round(weight, 9) AS weight, sign FROM links",
    # A link belongs to the tree if no way of lighter links leads from one end to the other.
    "oriented_normals": f"""WITH RECURSIVE {_LINKS},
 reach(n, target, node) AS (SELECT n, b, a FROM numbered UNION SELECT r.n, r.target, w.b FROM reach r JOIN ways w ON w.a = r.node AND w.n < r.n WHERE r.node <> r.target),
 tree AS MATERIALIZED (SELECT w.* FROM ways w WHERE n NOT IN (SELECT n FROM reach WHERE node = target)),
 parts(node, other) AS (SELECT point_id, point_id FROM cloud UNION SELECT p.node, t.b FROM parts p JOIN tree t ON t.a = p.other),
 starts AS MATERIALIZED (SELECT root, arg_max(node, (z, -node)) AS start FROM (SELECT node, min(other) AS root FROM parts GROUP BY node) JOIN cloud ON point_id = node GROUP BY root),
 walk(node, before, side) AS (SELECT start, -1::BIGINT, CASE WHEN nz < 0 THEN -1 ELSE 1 END FROM starts JOIN cloud ON point_id = start UNION ALL SELECT t.b, t.a, w.side * t.sign FROM walk w JOIN tree t ON t.a = w.node AND t.b <> w.before)
 SELECT point_id, side < 0 AS flipped, round(nx * side, 9) AS nx, round(ny * side, 9) AS ny, round(nz * side, 9) AS nz FROM walk JOIN cloud ON point_id = node""",
}
