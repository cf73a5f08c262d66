"""Point clouds read off the driver's tables, one row for each point: point_id, x, y, z, r, g, b (0 to 1) and segment_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """A large scan: about 7.58 to 4.14 points for each cubic unit."""
    e = table(spark, folder, "events")
    segment = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return e.select(
        F.col("event_id").alias("point_id"), (F.col("user_id") / 10).alias("x"), (F.col("value") / 50).alias("y"),
        ((F.hour("ts") * 60 + F.minute("ts")) / 100).alias("z"), ((F.col("event_id") * 37) % 256 / 255).alias("r"), ((F.col("user_id") * 53) % 256 / 255).alias("g"),
        (F.get_json_object("props", "$.k").cast("int") / 99).alias("b"), segment.cast("int").alias("segment_id"),
    )


def embeddings_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """A small cloud with unit normals nx, ny, nz and a label."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    norm = F.sqrt(at(6) * at(6) + at(7) * at(7) + at(8) * at(8))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("point_id"), *[(at(i) * 100).alias(c) for i, c in enumerate("xyz")],
        *[F.least(F.lit(1.0), F.abs(at(3 + i)) * 4).alias(c) for i, c in enumerate("rgb")], *[(at(6 + i) / norm).alias(f"n{c}") for i, c in enumerate("xyz")],
        F.col("label").alias("segment_id"), "label",
    )


def part_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered curve points: segment, seq, x, y, z."""
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("segment"), F.col("p_partkey").alias("seq"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") / 100).alias("z")
    )


EVENTS_SQL = """(SELECT event_id AS point_id, user_id / 10 AS x, value / 50 AS y, (hour(ts) * 60 + minute(ts)) / 100 AS z,
 ((event_id * 37) % 256) / 255 AS r, ((user_id * 53) % 256) / 255 AS g, CAST(json_extract_string(props, '$.k') AS INT) / 99 AS b,
 CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INT) AS segment_id FROM events)"""
_norm = "sqrt(embedding[7]::DOUBLE * embedding[7]::DOUBLE + embedding[8]::DOUBLE * embedding[8]::DOUBLE + embedding[9]::DOUBLE * embedding[9]::DOUBLE)"
EMBEDDINGS_SQL = f"""(SELECT vec_id AS point_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z,
 least(1.0::DOUBLE, abs(embedding[4]::DOUBLE) * 4) AS r, least(1.0::DOUBLE, abs(embedding[5]::DOUBLE) * 4) AS g, least(1.0::DOUBLE, abs(embedding[6]::DOUBLE) * 4) AS b,
 embedding[7]::DOUBLE / {_norm} AS nx, embedding[8]::DOUBLE / {_norm} AS ny, embedding[9]::DOUBLE / {_norm} AS nz, label AS segment_id, label FROM embeddings)"""
PARTS_SQL = "(SELECT p_brand AS segment, p_partkey AS seq, p_size::DOUBLE AS x, p_retailprice / 100 AS y, p_partkey / 100 AS z FROM part)"
