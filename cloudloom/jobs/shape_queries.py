"""Queries of contours, borders, local contrast, skeletons and filled polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.jobs.image_queries import _IMAGE, STEP, _image
from cloudloom.operators import alpha, contours, enhance, raster, shapes
from cloudloom.sources.clouds import EMBEDDINGS_SQL, PARTS_SQL, embeddings_cloud, events_cloud, part_curves
from cloudloom.sources.shared import saved

BRIGHT, SIZE, ROUNDS, STROKE = 120, 3, 2, 3
SCALE, HOLE = 12.0, 0.4
ALPHA = 0.1


def _bright(s, d):
    return saved(_image(s, d).withColumn("v", F.when(F.col("v") > BRIGHT, F.col("v")).otherwise(0)))


def _contours(s, d):
    return contours.contours(contours.regions(_bright(s, d)))


def _without_borders(s, d):
    image = _bright(s, d)
    return contours.without_borders(image, image, SIZE, ROUNDS, STROKE)


def _colors(s, d):
    """Dense pixels of the raster, black where nothing is."""
    cloud = events_cloud(s, d)
    found = raster.rasterize(cloud, STEP)
    cells = raster.dense(found, raster.grids(cloud, STEP), F.lit(0)).drop("v")
    return cells.join(found, ["segment_id", "row", "col"], "left").select("segment_id", "row", "col", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])


def _stars(s, d):
    """A ring around each brand's parts, in the order of their angles from the middle, and a smaller one in it as a hole; places to a thousandth."""
    own = part_curves(s, d)
    middle = own.groupBy("segment").agg(F.round(F.avg("x"), 3).alias("mx"), F.round(F.avg("y"), 3).alias("my"))
    placed = own.join(middle, "segment").withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    angle = F.round(F.atan2("dy", "dx"), 9)
    ring = lambda k, share: F.struct(F.lit(k).alias("ring"), *[F.round((F.col(f"m{a}") + F.col(f"d{a}") * share) * SCALE, 3).alias(a) for a in "xy"])
    both = placed.select(F.col("segment").alias("shape"), angle.alias("angle"), F.col("seq").alias("part"), F.explode(F.array(ring(0, 1.0), ring(1, HOLE))).alias("r"))
    return both.select("shape", "r.ring", F.struct("angle", "part").alias("seq"), "r.x", "r.y")


def _flat(s, d):
    return embeddings_cloud(s, d).select(F.col("label").alias("shape"), "point_id", "x", "y")


QUERIES = {
    "alpha_triangles": lambda s, d: alpha.triangles(_flat(s, d), ALPHA),
    "alpha_outline": lambda s, d: alpha.outline(saved(alpha.triangles(_flat(s, d), ALPHA))),
    "cluster_skeletons": lambda s, d: alpha.skeletons(embeddings_cloud(s, d), alpha=ALPHA, scale=4).select("label", *[F.round(a, 4).alias(a) for a in "xyz"]),
    "contour_areas": _contours,
    "largest_contour": lambda s, d: contours.largest(_contours(s, d)),
    "border_removed": _without_borders,
    "clahe_plane": lambda s, d: enhance.equalised(_image(s, d)),
    "clahe_gamma": lambda s, d: enhance.clahe_gamma(_colors(s, d)),
    "skeleton_pixels": lambda s, d: shapes.thinned(_bright(s, d).where("v > 0")),
    "polygon_fill": lambda s, d: shapes.filled(_stars(s, d)),
}

_NEXT = 'AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a.lit OR abs(a."row" - b."row") + abs(a.col - b.col) = 1)'
_REGIONS = f"""{_IMAGE}, sides AS (SELECT DISTINCT segment_id, height, width FROM image),
 cells AS MATERIALIZED (SELECT segment_id, "row", col, lit, (segment_id::BIGINT * 100000 + "row" + 1) * 100000 + col + 1 AS cell FROM (SELECT segment_id, "row", col, v > {BRIGHT} AS lit FROM image
  UNION ALL SELECT segment_id, "row", col, FALSE FROM (SELECT *, unnest(range(-1, width + 1)) AS col FROM (SELECT *, unnest(range(-1, height + 1)) AS "row" FROM sides)) WHERE "row" IN (-1, height) OR col IN (-1, width))),
 links AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM cells a JOIN cells b ON a.segment_id = b.segment_id AND a.lit = b.lit {_NEXT}),
 reach(cell, root) AS (SELECT cell, cell FROM cells UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.cell WHERE reach.root < links.b),
 px AS MATERIALIZED (SELECT segment_id, "row", col, lit, region FROM cells JOIN (SELECT cell, min(root) AS region FROM reach GROUP BY cell) USING (cell)),
 squares AS MATERIALIZED (SELECT a.segment_id, a."row" AS y, a.col AS x, a.lit AS la, b.lit AS lb, c.lit AS lc, d.lit AS ld, a.region AS ga, b.region AS gb, c.region AS gc, d.region AS gd
  FROM px a JOIN px b ON b.segment_id = a.segment_id AND b."row" = a."row" AND b.col = a.col + 1 JOIN px c ON c.segment_id = a.segment_id AND c."row" = a."row" + 1 AND c.col = a.col
  JOIN px d ON d.segment_id = a.segment_id AND d."row" = a."row" + 1 AND d.col = a.col + 1)"""
_AT = {"a": "x, y", "b": "x + 1, y", "c": "x, y + 1", "d": "x + 1, y + 1"}


def _stretch(off: str, start: str, end: str) -> str:
    x1, y1, x2, y2 = [f"({v})" for k in (start, end) for v in _AT[k].split(", ")]
    return f"SELECT segment_id, g{start} AS region, g{off[0]} AS around, {x1} * {y2} - {x2} * {y1} AS twice FROM squares WHERE l{start} AND l{end} AND {' AND '.join(f'NOT l{k}' for k in off)}"


_CONTOURS = f"""{_REGIONS}, found AS MATERIALIZED (SELECT segment_id, region, around, sum(twice) / 2 AS area FROM (
 {' UNION ALL '.join(_stretch(*s) for s in (('a', 'c', 'b'), ('b', 'a', 'd'), ('d', 'b', 'c'), ('c', 'd', 'a'), ('ab', 'c', 'd'), ('cd', 'b', 'a'), ('ac', 'd', 'b'), ('bd', 'a', 'c')))}
 UNION ALL SELECT a.segment_id, a.region, b.region, 0 FROM px a JOIN px b ON a.segment_id = b.segment_id AND a.lit AND NOT b.lit AND abs(a."row" - b."row") + abs(a.col - b.col) = 1) GROUP BY segment_id, region, around),
 top AS MATERIALIZED (SELECT segment_id, region, around, area FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY abs(area) DESC, region, around) AS place FROM found) WHERE place = 1)"""
_HALF = ROUNDS * (SIZE // 2)
_LEVELS = f"""tiled AS MATERIALIZED (SELECT segment_id, height AS h, width AS w, CASE WHEN height % 8 = 0 AND width % 8 = 0 THEN height // 8 ELSE height // 8 + 1 END AS th, CASE WHEN height % 8 = 0 AND width % 8 = 0 THEN width // 8 ELSE width // 8 + 1 END AS tw FROM (SELECT DISTINCT segment_id, height, width FROM image)),
 counts AS (SELECT segment_id, ty, tx, v, count(*) AS n FROM (SELECT segment_id, p // th AS ty, q // tw AS tx, CASE WHEN p < h THEN p ELSE 2 * (h - 1) - p END AS "row", CASE WHEN q < w THEN q ELSE 2 * (w - 1) - q END AS col
   FROM (SELECT *, unnest(range(8 * tw)) AS q FROM (SELECT *, unnest(range(8 * th)) AS p FROM tiled))) JOIN image USING (segment_id, "row", col) GROUP BY ALL),
 bins AS (SELECT segment_id, ty, tx, v, th * tw AS area, coalesce(n, 0) AS n, greatest(1, CAST(floor(1.2::DOUBLE * (th * tw) / 256) AS BIGINT)) AS most FROM (SELECT *, unnest(range(256)) AS v FROM (SELECT *, unnest(range(8)) AS tx FROM (SELECT *, unnest(range(8)) AS ty FROM tiled))) LEFT JOIN counts USING (segment_id, ty, tx, v)),
 spare AS (SELECT *, CAST(sum(greatest(n - most, 0)) OVER (PARTITION BY segment_id, ty, tx) AS BIGINT) AS over_ FROM bins),
 raised AS (SELECT *, least(n, most) + over_ // 256 + CASE WHEN over_ % 256 > 0 AND v % greatest(256 // greatest(over_ % 256, 1), 1) = 0 AND v // greatest(256 // greatest(over_ % 256, 1), 1) < over_ % 256 THEN 1 ELSE 0 END AS m FROM spare),
 maps AS MATERIALIZED (SELECT segment_id, ty, tx, v, CAST(least(255, round_even(sum(m) OVER (PARTITION BY segment_id, ty, tx ORDER BY v) * (255.0::DOUBLE / area), 0)) AS INT) AS level FROM raised)"""

_TRIANGLES = f"""WITH own AS MATERIALIZED (SELECT label AS shape, point_id, x, y FROM {EMBEDDINGS_SQL}),
 triples AS (SELECT a.shape, a.point_id AS a, b.point_id AS b, c.point_id AS c, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS by_, c.x - a.x AS cx, c.y - a.y AS cy FROM own a JOIN own b ON b.shape = a.shape AND b.point_id > a.point_id JOIN own c ON c.shape = b.shape AND c.point_id > b.point_id),
 round_ AS MATERIALIZED (SELECT shape, a, b, c, ax + (cy * (bx * bx + by_ * by_) - by_ * (cx * cx + cy * cy)) / (2 * (bx * cy - by_ * cx)) AS mx, ay + (bx * (cx * cx + cy * cy) - cx * (bx * bx + by_ * by_)) / (2 * (bx * cy - by_ * cx)) AS my, ax, ay FROM triples),
 small AS (SELECT *, sqrt((mx - ax) * (mx - ax) + (my - ay) * (my - ay)) AS r FROM round_),
 found AS MATERIALIZED (SELECT shape, a, b, c FROM small s WHERE r < 1 / {ALPHA}::DOUBLE AND NOT EXISTS (SELECT 1 FROM own p WHERE p.shape = s.shape AND p.point_id NOT IN (s.a, s.b, s.c) AND (p.x - s.mx) * (p.x - s.mx) + (p.y - s.my) * (p.y - s.my) < s.r * s.r))"""

SQL = {
    "alpha_triangles": f"{_TRIANGLES} SELECT * FROM found",
    "alpha_outline": f"{_TRIANGLES} SELECT shape, a, b FROM (SELECT shape, a, b FROM found UNION ALL SELECT shape, b, c FROM found UNION ALL SELECT shape, a, c FROM found) GROUP BY shape, a, b HAVING count(*) = 1",
    "contour_areas": f"WITH RECURSIVE {_CONTOURS} SELECT segment_id, region, around, CAST(area AS DOUBLE) AS area FROM found",
    "largest_contour": f"WITH RECURSIVE {_CONTOURS} SELECT segment_id, region, around, CAST(area AS DOUBLE) AS area FROM top",
    # What no way around the largest contour's region leads to lies inside.
    "border_removed": f"""WITH RECURSIVE {_CONTOURS},
 outside(segment_id, "row", col) AS (SELECT segment_id, "row", col FROM px WHERE "row" = -1 AND col = -1 UNION SELECT p.segment_id, p."row", p.col FROM outside o JOIN px p ON p.segment_id = o.segment_id AND abs(p."row" - o."row") + abs(p.col - o.col) = 1
  LEFT JOIN top t ON t.segment_id = p.segment_id AND t.region = p.region WHERE t.region IS NULL),
 inner_ AS MATERIALIZED (SELECT i.segment_id, i."row", i.col FROM image i ANTI JOIN outside o ON o.segment_id = i.segment_id AND o."row" = i."row" AND o.col = i.col),
 band AS (SELECT DISTINCT i.segment_id, i."row", i.col FROM inner_ i JOIN (SELECT * FROM image ANTI JOIN inner_ USING (segment_id, "row", col)) o ON o.segment_id = i.segment_id AND abs(o."row" - i."row") <= {_HALF} AND abs(o.col - i.col) <= {_HALF}),
 drawn AS (SELECT DISTINCT a.segment_id, a."row", a.col FROM px a JOIN px b ON a.segment_id = b.segment_id AND a.lit AND NOT b.lit AND abs(a."row" - b."row") + abs(a.col - b.col) = 1
  JOIN found f ON f.segment_id = a.segment_id AND f.region = a.region AND f.around = b.region JOIN top t ON t.segment_id = f.segment_id AND abs(f.area) <> abs(t.area)),
 stroke AS (SELECT DISTINCT i.segment_id, i."row", i.col FROM image i JOIN drawn d ON d.segment_id = i.segment_id AND (i."row" - d."row") * (i."row" - d."row") + (i.col - d.col) * (i.col - d.col) <= {STROKE * STROKE} / 4.0)
 SELECT segment_id, "row", col, CASE WHEN v <= {BRIGHT} OR (segment_id, "row", col) IN (SELECT (segment_id, "row", col) FROM band UNION ALL SELECT (segment_id, "row", col) FROM stroke) THEN 0 ELSE v END AS v FROM image""",
    "clahe_plane": f"""WITH {_IMAGE}, {_LEVELS},
 between_ AS (SELECT i.segment_id, "row", col, v, "row" / th - 0.5::DOUBLE AS fy, col / tw - 0.5::DOUBLE AS fx FROM image i JOIN tiled USING (segment_id)),
 shares AS (SELECT *, CAST(least(greatest(floor(fy) + dy, 0), 7) AS BIGINT) AS ty, CAST(least(greatest(floor(fx) + dx, 0), 7) AS BIGINT) AS tx, CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END * CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END AS share
  FROM between_, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))
 SELECT s.segment_id, s."row", s.col, CAST(round_even(round(sum(level * share), 6), 0) AS INT) AS v FROM shares s JOIN maps USING (segment_id, ty, tx, v) GROUP BY s.segment_id, s."row", s.col""",
    "polygon_fill": f"""WITH own AS (SELECT * FROM {PARTS_SQL}), middle AS (SELECT segment, round(avg(x), 3) AS mx, round(avg(y), 3) AS my FROM own GROUP BY segment),
 placed AS (SELECT segment AS shape, ring, round(atan2(y - my, x - mx), 9) AS angle, seq, round((mx + (x - mx) * share) * {SCALE}::DOUBLE, 3) AS x, round((my + (y - my) * share) * {SCALE}::DOUBLE, 3) AS y FROM own JOIN middle USING (segment), (VALUES (0, 1.0::DOUBLE), (1, {HOLE}::DOUBLE)) v(ring, share)),
 edges AS MATERIALIZED (SELECT shape, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM placed WINDOW w AS (PARTITION BY shape, ring ORDER BY angle, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 box AS (SELECT shape, CAST(floor(min(x)) AS BIGINT) AS x0, CAST(ceil(max(x)) AS BIGINT) AS x1, CAST(floor(min(y)) AS BIGINT) AS y0, CAST(ceil(max(y)) AS BIGINT) AS y1 FROM edges GROUP BY shape),
 pixels AS (SELECT shape, "row", unnest(range(x0, x1 + 1)) AS col FROM (SELECT *, unnest(range(y0, y1 + 1)) AS "row" FROM box)),
 crossed AS (SELECT e.shape, ring, p."row", x + (p."row" - y) * (x2 - x) / (y2 - y) AS at FROM edges e JOIN (SELECT DISTINCT shape, "row" FROM pixels) p ON p.shape = e.shape AND least(y, y2) <= p."row" AND p."row" < greatest(y, y2)),
 sides AS (SELECT p.shape, p."row", p.col, c.ring, count(*) FILTER (c.at < p.col) % 2 = 1 OR bool_or(abs(c.at - p.col) < 5e-10) AS inside FROM pixels p JOIN crossed c ON c.shape = p.shape AND c."row" = p."row" GROUP BY p.shape, p."row", p.col, c.ring),
 touched AS (SELECT e.shape, e.ring, p."row", p.col FROM edges e JOIN pixels p ON p.shape = e.shape AND ((e.y = p."row" AND e.x = p.col) OR (e.y = e.y2 AND e.y = p."row" AND p.col BETWEEN least(e.x, e.x2) AND greatest(e.x, e.x2)))),
 filled AS (SELECT shape, ring, "row", col FROM sides WHERE inside UNION SELECT * FROM touched)
 SELECT shape, "row", col FROM filled GROUP BY shape, "row", col HAVING max(ring) = 0""",
}
