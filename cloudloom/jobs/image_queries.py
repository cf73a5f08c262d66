"""Queries of rasters and image filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions.color import gamma, is_red
from cloudloom.jobs.cloud_queries import rounded
from cloudloom.operators import raster
from cloudloom.sources.clouds import EVENTS_SQL, events_cloud

STEP = 0.5


def _pixels(s, d):
    return raster.rasterize(events_cloud(s, d), STEP)


def _image(s, d):
    """The dense image of the mean of a pixel's channels."""
    return raster.dense(_pixels(s, d), raster.grids(events_cloud(s, d), STEP), F.floor((F.col("r") + F.col("g") + F.col("b")) / 3))


def _lift(s, d):
    cloud = events_cloud(s, d)
    return rounded(raster.lift(_pixels(s, d), cloud, raster.grids(cloud, STEP)).select("segment_id", "row", "col", "x", "y", "z"), "x", "y", "z")


def _sparse(s, d):
    return _pixels(s, d).where("r > 150").select("segment_id", "row", "col")


QUERIES = {
    "rasterize_mean": lambda s, d: _pixels(s, d),
    "rasterize_last": lambda s, d: raster.rasterize_last(events_cloud(s, d), STEP),
    "segment_grids": lambda s, d: raster.grids(events_cloud(s, d), STEP),
    "pixel_lift": _lift,
    "image_box_mean_threshold": lambda s, d: raster.box_mean_threshold(_image(s, d)),
    "image_median5": lambda s, d: raster.median(_image(s, d)),
    "image_erode": lambda s, d: raster.erode(_image(s, d), 5),
    "image_dilate": lambda s, d: raster.dilate(_image(s, d), 5),
    "component_filter8": lambda s, d: raster.drop_small(_sparse(s, d), 6).select("segment_id", "row", "col"),
    "component_label4": lambda s, d: raster.label_pixels(_sparse(s, d), 4).select("segment_id", "row", "col", "component"),
    "hsv_red_mask": lambda s, d: _pixels(s, d).select("segment_id", "row", "col", is_red(F.col("r"), F.col("g"), F.col("b")).alias("red")),
    "gamma_lookup": lambda s, d: _pixels(s, d).select("segment_id", "row", "col", *[gamma(F.col(c)).alias(c) for c in "rgb"]),
}

_GRID = f"grids AS MATERIALIZED (SELECT segment_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, CAST(ceil((max(x) - min(x)) / {STEP}) AS BIGINT) AS width, CAST(ceil((max(y) - min(y)) / {STEP}) AS BIGINT) AS height FROM cloud GROUP BY segment_id)"
_PIXELS = f"""cloud AS MATERIALIZED (SELECT * FROM {EVENTS_SQL}), {_GRID},
 placed AS (SELECT cloud.*, CAST(least(floor((x - min_x) / {STEP}), width - 1) AS BIGINT) AS col, CAST(least(floor((y - min_y) / {STEP}), height - 1) AS BIGINT) AS "row" FROM cloud JOIN grids USING (segment_id)),
 pixels AS MATERIALIZED (SELECT segment_id, "row", col, {', '.join(f'CAST(floor(round(avg({c} * 255), 6)) AS INT) AS {c}' for c in 'rgb')}, count(*) AS n FROM placed GROUP BY segment_id, "row", col)"""
_IMAGE = f"""{_PIXELS}, image AS MATERIALIZED (SELECT c.segment_id, c."row", c.col, CAST(coalesce(floor((r + g + b) / 3), 0) AS INT) AS v, height, width FROM (SELECT segment_id, "row", unnest(range(width)) AS col, height, width
  FROM (SELECT segment_id, unnest(range(height)) AS "row", height, width FROM grids)) c LEFT JOIN pixels p ON p.segment_id = c.segment_id AND p."row" = c."row" AND p.col = c.col)"""


def _around(half: int, what: str, clamp: bool = True, keep: str = "") -> str:
    """An aggregate over the square around each pixel; offsets over the border are clamped, or else left out."""
    steps = ", ".join(str(k) for k in range(-half, half + 1))
    row, col = ('least(greatest(i."row" + dr, 0), i.height - 1)', "least(greatest(i.col + dc, 0), i.width - 1)") if clamp else ('i."row" + dr', "i.col + dc")
    return f"""WITH {_IMAGE}, wide AS (SELECT i.*, {row} AS orow, {col} AS ocol FROM image i, (SELECT unnest([{steps}]) AS dr), (SELECT unnest([{steps}]) AS dc))
 SELECT w.segment_id, w."row", w.col, {what} AS v FROM wide w JOIN image o ON o.segment_id = w.segment_id AND o."row" = w.orow AND o.col = w.ocol GROUP BY w.segment_id, w."row", w.col, w.v"""


def _components(steps: str) -> str:
    return f"""WITH RECURSIVE {_PIXELS}, lit AS MATERIALIZED (SELECT segment_id, "row", col, (segment_id::BIGINT * 100000 + "row") * 100000 + col AS cell FROM pixels WHERE r > 150),
 links AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM lit a JOIN lit b ON a.segment_id = b.segment_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND {steps}),
 reach(cell, root) AS (SELECT cell, cell FROM lit UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.cell WHERE reach.root < links.b),
 named AS (SELECT segment_id, "row", col, component FROM lit JOIN (SELECT cell, min(root) AS component FROM reach GROUP BY cell) USING (cell))"""


_HSV = """SELECT segment_id, "row", col, top, span, CASE WHEN turn < 0 THEN turn + 180 ELSE turn END AS h, CASE WHEN top = 0 THEN 0 ELSE span * 255 / top END AS s FROM (
 SELECT *, CASE WHEN span = 0 THEN 0 WHEN top = r THEN (g - b) / span WHEN top = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END * 30 AS turn FROM (
 SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM pixels))"""

SQL = {
    "rasterize_mean": f"WITH {_PIXELS} SELECT * FROM pixels",
    "rasterize_last": f"""WITH {_PIXELS} SELECT segment_id, "row", col, {', '.join(f'CAST(floor(round(arg_max({c}, point_id) * 255, 6)) AS INT) AS {c}' for c in 'rgb')} FROM placed GROUP BY segment_id, "row", col""",
    "segment_grids": f"WITH cloud AS (SELECT * FROM {EVENTS_SQL}), {_GRID} SELECT *, {STEP}::DOUBLE AS step FROM grids",
    "pixel_lift": f"""WITH {_PIXELS}, lit AS (SELECT segment_id, "row", col, col * {STEP}::DOUBLE + min_x AS x, "row" * {STEP}::DOUBLE + min_y AS y FROM pixels JOIN grids USING (segment_id) WHERE r <> 0 OR g <> 0 OR b <> 0)
 SELECT segment_id, "row", col, round(x, 9) AS x, round(y, 9) AS y, round(avg(z), 9) AS z FROM (SELECT l.*, c.z, row_number() OVER (PARTITION BY l.segment_id, l."row", l.col ORDER BY sqrt((l.x - c.x) * (l.x - c.x) + (l.y - c.y) * (l.y - c.y)), c.point_id) AS place
  FROM lit l JOIN cloud c USING (segment_id)) WHERE place <= 3 GROUP BY segment_id, "row", col, x, y""",
    "image_box_mean_threshold": _around(5, "CAST(CASE WHEN w.v > floor(sum(o.v) / 121 + 0.5) + 3 THEN 255 ELSE 0 END AS INT)"),
    "image_median5": _around(2, "list_sort(list(o.v))[13]"),
    "image_erode": _around(2, "min(o.v)", clamp=False),
    "image_dilate": _around(2, "max(o.v)", clamp=False),
    "component_filter8": f"""{_components('TRUE')} SELECT segment_id, "row", col FROM named WHERE component IN (SELECT component FROM named GROUP BY component HAVING count(*) >= 6)""",
    "component_label4": f"""{_components('abs(a."row" - b."row") + abs(a.col - b.col) = 1')} SELECT * FROM named""",
    "hsv_red_mask": f"""WITH {_PIXELS} SELECT segment_id, "row", col, (h BETWEEN 0 AND 10 OR h BETWEEN 168 AND 180) AND s >= 70 AND top >= 50 AS red FROM ({_HSV})""",
    "gamma_lookup": f"""WITH {_PIXELS} SELECT segment_id, "row", col, {', '.join(f'CAST(floor(pow({c} / 255, 1.0::DOUBLE / 0.9::DOUBLE) * 255) AS INT) AS {c}' for c in 'rgb')} FROM pixels""",
}
