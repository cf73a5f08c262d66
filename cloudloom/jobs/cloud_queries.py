"""Queries over single clouds: metrics, colours, transforms, voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import color, geometry
from cloudloom.operators import voxel
from cloudloom.sources.clouds import EVENTS_SQL, embeddings_cloud, events_cloud

BOXES = [((0, 0, 0), (120, 140, 130)), ((200, 60, 0), (255, 255, 90))]
MATRIX = [[0.0, -1.0, 0.0, 5.0], [0.8, 0.0, -0.6, -2.0], [0.6, 0.0, 0.8, 0.5], [0.0, 0.0, 0.0, 1.0]]
SIZES = (1.0, 0.8, 1.0, 0.6, 1.0, 0.5)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def seed_region(cloud):
    """What the full cloud is recovered from: the highest and lowest point of each column, of every segment."""
    ends = voxel.column_extrema(cloud, 2.0)
    ids = ends.select(F.col("max_id").alias("point_id")).union(ends.select("min_id")).distinct()
    return cloud.join(ids, "point_id", "left_semi")


def _recovered(s, d):
    cloud = events_cloud(s, d)
    return voxel.recover(seed_region(cloud), cloud.select("point_id", "x", "y", "z"), SIZES)


def _ratio(s, d):
    return rounded(voxel.recovery_ratio(_recovered(s, d), events_cloud(s, d)), "ratio")


QUERIES = {
    "cloud_metrics": lambda s, d: rounded(voxel.metrics(events_cloud(s, d)), "dx", "dy", "dz", "density"),
    "voxel_size_for_density": lambda s, d: voxel.metrics(events_cloud(s, d)).select("n", voxel.voxel_size(2.0).alias("v")),
    "voxel_downsample": lambda s, d: voxel.downsample(events_cloud(s, d)),
    "color_range_keep": lambda s, d: color.filter_ranges(events_cloud(s, d), BOXES).select("point_id", "x", "y", "z"),
    "color_range_drop": lambda s, d: color.filter_ranges(events_cloud(s, d), BOXES, keep=False).select("point_id", "x", "y", "z"),
    "contrast": lambda s, d: rounded(color.contrast(events_cloud(s, d), 1.5).select("point_id", *"rgb"), *"rgb"),
    "grayscale": lambda s, d: rounded(color.grayscale(events_cloud(s, d)).select("point_id", *"rgb"), *"rgb"),
    "threshold_gray": lambda s, d: color.threshold(color.grayscale(events_cloud(s, d)), 100.5).select("point_id", *"rgb"),
    "paint_uniform": lambda s, d: color.paint(events_cloud(s, d), (0.7, 0.7, 0.7)).select("point_id", *"rgb"),
    "paint_detection": lambda s, d: color.detected_paint(events_cloud(s, d), "segment_id"),
    "not_all_black": lambda s, d: color.not_black(color.threshold(color.grayscale(events_cloud(s, d)), 100.5)).select("point_id"),
    "scale_cloud": lambda s, d: rounded(geometry.scale(events_cloud(s, d), 1 / 600).select("point_id", "x", "y", "z"), "x", "y", "z"),
    "affine_transform": lambda s, d: rounded(geometry.affine(embeddings_cloud(s, d), MATRIX, normals=True).select("point_id", "x", "y", "z", "nx", "ny", "nz"), "x", "y", "z", "nx", "ny", "nz"),
    "axis_permutation": lambda s, d: rounded(geometry.affine(events_cloud(s, d), geometry.PERMUTATION).select("point_id", "x", "y", "z"), "x", "y", "z"),
    "invert_normals": lambda s, d: rounded(geometry.inverted(embeddings_cloud(s, d), F.col("label") < 3).select("point_id", "nx", "ny", "nz"), "nx", "ny", "nz"),
    "column_extrema": lambda s, d: voxel.column_extrema(events_cloud(s, d)),
    "region_recovery_6rounds": lambda s, d: _recovered(s, d).select("segment_id", "point_id"),
    "recovery_ratio": _ratio,
    "region_recovery_in_order": lambda s, d: voxel.recover_in_order(seed_region(events_cloud(s, d)), events_cloud(s, d).select("point_id", "x", "y", "z"), SIZES).select("segment_id", "point_id"),
    "adaptive_parameters": lambda s, d: voxel.metrics(events_cloud(s, d)).select(voxel.threshold_cell(200).alias("size")),
    "select_by_index": lambda s, d: events_cloud(s, d).join(embeddings_cloud(s, d).where("label < 5").select("point_id"), "point_id", "left_semi").select("point_id", "x"),
    "antiselect_by_index": lambda s, d: events_cloud(s, d).join(embeddings_cloud(s, d).where("label < 5").select("point_id"), "point_id", "left_anti").select("point_id", "x"),
    "concatenate_clouds": lambda s, d: rounded(events_cloud(s, d).select("x", "y", "z").unionByName(embeddings_cloud(s, d).select("x", "y", "z")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.max("z").alias("mz")).withColumn("sx", F.round("sx", 6)), "mz"),
    "upsample_count": lambda s, d: voxel.upsample(embeddings_cloud(s, d), 5).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.when(F.col("copy") == 0, F.col("x"))), 9).alias("x0")),
}

_COLOR = lambda test: f"SELECT point_id, x, y, z FROM {EVENTS_SQL} WHERE {test}"
_BOX = " OR ".join("(" + " AND ".join(f"{c} * 255 >= {a} AND {c} * 255 <= {b}" for c, a, b in zip("rgb", low, high, strict=True)) + ")" for low, high in BOXES)
_GRAY = "(r * 0.2989::DOUBLE + g * 0.5870::DOUBLE + b * 0.1140::DOUBLE)"
_METRICS = f"(SELECT count(*) AS n, {', '.join(f'min({a}) AS min_{a}, max({a}) AS max_{a}, max({a}) - min({a}) AS d{a}' for a in 'xyz')} FROM {EVENTS_SQL})"
_SIZE = "CASE WHEN n / (dx * dy * dz) >= 0.01 AND floor(dx * dy * dz * 2) > 0 THEN round(pow(dx * dy * dz / floor(dx * dy * dz * 2), 1.0::DOUBLE / 3), 9) END"


def _embeddings(columns: str, tail: str = "") -> str:
    from cloudloom.sources.clouds import EMBEDDINGS_SQL

    return f"SELECT {columns} FROM {EMBEDDINGS_SQL} {tail}"


def _recover_sql() -> str:
    parts = [f"cloud AS MATERIALIZED (SELECT * FROM {EVENTS_SQL})", "ends AS (SELECT arg_max(point_id, row(z, -point_id)) AS high, arg_min(point_id, row(z, point_id)) AS low FROM cloud GROUP BY floor(x / 2), floor(y / 2))", "r0 AS (SELECT segment_id, x, y, z FROM cloud WHERE point_id IN (SELECT high FROM ends UNION SELECT low FROM ends))"]
    for k, v in enumerate(SIZES):
        cell = lambda a, t: f"floor(({t}.{a} - o.o{a}) / {v}::DOUBLE)"
        parts += [
            f"o{k} AS (SELECT segment_id, {', '.join(f'min({a}) - {v}::DOUBLE / 2 AS o{a}' for a in 'xyz')} FROM r{k} GROUP BY segment_id)",
            f"c{k} AS (SELECT DISTINCT o.segment_id, {', '.join(f'{cell(a, 'r')} AS c{a}' for a in 'xyz')} FROM r{k} r JOIN o{k} o USING (segment_id))",
            f"r{k + 1} AS MATERIALIZED (SELECT o.segment_id, p.point_id, p.x, p.y, p.z FROM cloud p, o{k} o WHERE EXISTS (SELECT 1 FROM c{k} c WHERE c.segment_id = o.segment_id AND {' AND '.join(f'c.c{a} = {cell(a, 'p')}' for a in 'xyz')}))",
        ]
    return "WITH " + ", ".join(parts)


def _in_order_sql() -> str:
    """One segment after the other, each in the cloud that is left."""
    parts = [_recover_sql().removeprefix("WITH ").split(", o0 AS")[0]]
    for seg in range(5):
        taken = " UNION ALL ".join(f"SELECT point_id FROM s{k}_{len(SIZES)}" for k in range(seg)) or "SELECT NULL WHERE FALSE"
        parts += [f"left{seg} AS MATERIALIZED (SELECT * FROM cloud WHERE point_id NOT IN ({taken}))", f"s{seg}_0 AS (SELECT x, y, z FROM r0 WHERE segment_id = {seg})"]
        for k, v in enumerate(SIZES):
            cells = lambda t: ", ".join(f"floor(({t}.{a} - o{a}) / {v}::DOUBLE)" for a in "xyz")
            parts += [
                f"so{seg}_{k} AS (SELECT {', '.join(f'min({a}) - {v}::DOUBLE / 2 AS o{a}' for a in 'xyz')} FROM s{seg}_{k})",
                f"s{seg}_{k + 1} AS MATERIALIZED (SELECT p.point_id, p.x, p.y, p.z FROM left{seg} p, so{seg}_{k} WHERE ({cells('p')}) IN (SELECT ({cells('r')}) FROM s{seg}_{k} r, so{seg}_{k}))",
            ]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {seg}::INT AS segment_id, point_id FROM s{seg}_{len(SIZES)}" for seg in range(5))


_MOVED = ", ".join(f"round(x * {m[0]}::DOUBLE + y * {m[1]}::DOUBLE + z * {m[2]}::DOUBLE + {m[3]}::DOUBLE, 9) AS {a}, round(nx * {m[0]}::DOUBLE + ny * {m[1]}::DOUBLE + nz * {m[2]}::DOUBLE, 9) AS n{a}" for a, m in zip("xyz", MATRIX, strict=False))

SQL = {
    "cloud_metrics": f"SELECT n, {', '.join(f'min_{a}, max_{a}, round(d{a}, 9) AS d{a}' for a in 'xyz')}, round(n / (dx * dy * dz), 9) AS density FROM {_METRICS}",
    "voxel_size_for_density": f"SELECT n, {_SIZE} AS v FROM {_METRICS}",
    "voxel_downsample": f"""SELECT i, j, k, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z,
 round(avg(r) * 0.2989::DOUBLE + avg(g) * 0.5870::DOUBLE + avg(b) * 0.1140::DOUBLE, 9) AS gray
 FROM (SELECT *, {', '.join(f'CAST(floor(({a} - (min_{a} - v / 2)) / v) AS BIGINT) AS {k}' for a, k in zip('xyz', 'ijk', strict=True))} FROM {EVENTS_SQL}, (SELECT *, {_SIZE} AS v FROM {_METRICS})) GROUP BY i, j, k""",
    "color_range_keep": _COLOR(_BOX),
    "color_range_drop": _COLOR(f"NOT ({_BOX})"),
    "contrast": f"SELECT point_id, {', '.join(f'round(least(greatest(({c} * 255 - 128) * 1.5::DOUBLE + 128, 0), 255) / 255, 9) AS {c}' for c in 'rgb')} FROM {EVENTS_SQL}",
    "grayscale": f"SELECT point_id, {', '.join(f'round({_GRAY}, 9) AS {c}' for c in 'rgb')} FROM {EVENTS_SQL}",
    "threshold_gray": f"SELECT point_id, {', '.join(f'CASE WHEN {_GRAY} * 255 < 100.5 THEN 0.0::DOUBLE ELSE 1.0 END AS {c}' for c in 'rgb')} FROM {EVENTS_SQL}",
    "paint_uniform": f"SELECT point_id, {', '.join(f'0.7::DOUBLE AS {c}' for c in 'rgb')} FROM {EVENTS_SQL}",
    "paint_detection": f"SELECT segment_id, CASE WHEN avg(r) / avg(g) < 0.65 AND avg(b) / avg(g) < 0.65 THEN 'green' ELSE 'white' END AS paint FROM {EVENTS_SQL} GROUP BY segment_id",
    "not_all_black": f"SELECT point_id FROM {EVENTS_SQL} WHERE NOT {_GRAY} * 255 < 100.5",
    "scale_cloud": f"SELECT point_id, {', '.join(f'round({a} * (1.0::DOUBLE / 600), 9) AS {a}' for a in 'xyz')} FROM {EVENTS_SQL}",
    "affine_transform": _embeddings(f"point_id, {_MOVED}"),
    "axis_permutation": f"SELECT point_id, round(z, 9) AS x, round(x, 9) AS y, round(y, 9) AS z FROM {EVENTS_SQL}",
    "invert_normals": _embeddings("point_id, " + ", ".join(f"round(CASE WHEN label < 3 THEN -{c} ELSE {c} END, 9) AS {c}" for c in ("nx", "ny", "nz"))),
    "column_extrema": f"""SELECT CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS i, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS j, arg_max(point_id, row(z, -point_id)) AS max_id, arg_min(point_id, row(z, point_id)) AS min_id
 FROM {EVENTS_SQL} GROUP BY 1, 2""",
    "region_recovery_6rounds": f"{_recover_sql()} SELECT segment_id, point_id FROM r6",
    "region_recovery_in_order": _in_order_sql(),
    "recovery_ratio": f"{_recover_sql()} SELECT (SELECT count(*) FROM r6) AS recovered, count(*) AS total, round(least(100.0::DOUBLE, (SELECT count(*) FROM r6) / count(*) * 100), 9) AS ratio FROM cloud",
    "adaptive_parameters": f"SELECT CASE WHEN greatest(dx, dy, dz) * 200 > 2500 THEN 12 WHEN greatest(dx, dy, dz) * 200 > 2000 THEN 10 WHEN greatest(dx, dy, dz) * 200 > 1500 THEN 8 ELSE 6 END AS size FROM {_METRICS}",
    "select_by_index": f"SELECT point_id, x FROM {EVENTS_SQL} WHERE point_id IN (SELECT vec_id FROM embeddings WHERE label < 5)",
    "antiselect_by_index": f"SELECT point_id, x FROM {EVENTS_SQL} WHERE point_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)",
    "concatenate_clouds": f"SELECT count(*) AS n, round(sum(x), 6) AS sx, round(max(z), 9) AS mz FROM (SELECT x, y, z FROM {EVENTS_SQL} UNION ALL {_embeddings('x, y, z')})",
    "upsample_count": _embeddings("point_id, 6::BIGINT AS n, round(x, 9) AS x0"),
}
