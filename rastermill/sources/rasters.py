"""Rasters derived from the driver's tables: our own adapters, one row per pixel (image_id, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same raster as SQL, for checks.
EVENTS_SQL = """px AS (
  SELECT event_id // 256 AS image_id, (event_id % 16)::INT AS x, ((event_id % 256) // 16)::INT AS y, (user_id * 37 % 256)::INT AS r,
    (floor(value * 100)::BIGINT % 256)::INT AS g, (length(event_type) * 29 % 256)::INT AS b, CASE WHEN event_id % 17 = 0 THEN (event_id % 256)::INT ELSE 255 END AS a
  FROM events WHERE event_id // 256 < ((SELECT max(event_id) FROM events) + 1) // 256)"""


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 RGBA tiles from the events table; the last, incomplete tile is left out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", "event_type")
    tiles = events.agg(((F.max("event_id") + 1) / 256).cast("long").alias("tiles"))  # one row
    return events.crossJoin(F.broadcast(tiles)).where(F.expr("event_id div 256 < tiles")).select(
        F.expr("event_id div 256").alias("image_id"),
        F.expr("CAST(event_id % 16 AS INT)").alias("x"),
        F.expr("CAST((event_id % 256) div 16 AS INT)").alias("y"),
        F.expr("CAST(user_id * 37 % 256 AS INT)").alias("r"),
        F.expr("CAST(floor(value * 100) % 256 AS INT)").alias("g"),
        F.expr("CAST(length(event_type) * 29 % 256 AS INT)").alias("b"),
        F.expr("CAST(CASE WHEN event_id % 17 = 0 THEN event_id % 256 ELSE 255 END AS INT)").alias("a"),
    )
