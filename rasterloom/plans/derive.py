"""Rasters, byte streams, frames and tags derived from the driver's tables, which hold no images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster_l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): an 8-bit image for each label, a row for each embedding."""
    y = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), y, "embedding")
    v = F.floor((F.col("e").cast("double") + 1.0) * 127.5).cast("int")
    cells = rows.select("image_id", "y", F.posexplode("embedding").alias("x", "e"))
    return cells.select("image_id", "y", "x", F.least(F.greatest(v, F.lit(0)), F.lit(255)).alias("v"))


SQL_L8 = """l8 AS (
  SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, least(greatest(CAST(floor((CAST(e[x + 1] AS DOUBLE) + 1.0) * 127.5) AS INTEGER), 0), 255) AS v
  FROM (SELECT label AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding AS e FROM embeddings), range(0, 64) t(x))"""


def raster_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b): three elements of an embedding in turn make a pixel, 21 in a row."""
    y = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y")
    level = F.transform("embedding", lambda e: F.least(F.greatest(F.floor((e.cast("double") + 1.0) * 127.5).cast("int"), F.lit(0)), F.lit(255)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), y, level.alias("e"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.struct(p.alias("x"), *(F.get(F.col("e"), p * 3 + i).alias(c) for i, c in enumerate("rgb"))))
    return rows.select("image_id", "y", F.explode(pixels).alias("p")).select("image_id", "y", "p.*")


SQL_RGB = SQL_L8 + """,
rgb AS (
  SELECT image_id, y, CAST(x // 3 AS INTEGER) AS x, max(v) FILTER (WHERE x % 3 = 0) AS r, max(v) FILTER (WHERE x % 3 = 1) AS g, max(v) FILTER (WHERE x % 3 = 2) AS b
  FROM l8 WHERE x < 63 GROUP BY image_id, y, x // 3)"""


def text_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(blob_id, content): the UTF-8 bytes of each whole text that isn't empty."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.encode("text", "UTF-8").alias("content")).where(F.length("content") > 0)


SQL_BYTES = """bytes AS (
  SELECT blob_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, CAST('0x' || unnest(l) AS INTEGER) AS b
  FROM (SELECT doc_id AS blob_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each user: renders are event types, rectangles and durations come from event_id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("sequence_id"),
        (F.row_number().over(w) - 1).alias("frame_index"),
        F.col("event_type").alias("render"),
        F.expr("event_id % 7 + 1").alias("num"),
        F.expr("event_id % 5 + 1").alias("den"),
        F.expr("event_id % 11").alias("left"),
        F.expr("event_id % 13").alias("top"),
        F.expr("event_id % 17 + 1").alias("width"),
        F.expr("event_id % 19 + 1").alias("height"),
        F.expr("cast(event_id % 4 as int)").alias("disposal"),
        "event_id",
    )


SQL_FRAMES = """frames AS (
  SELECT user_id AS sequence_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_index, event_type AS render,
    event_id % 7 + 1 AS num, event_id % 5 + 1 AS den, event_id % 11 AS "left", event_id % 13 AS top, event_id % 17 + 1 AS width, event_id % 19 + 1 AS height,
    CAST(event_id % 4 AS INTEGER) AS disposal, event_id FROM events)"""
