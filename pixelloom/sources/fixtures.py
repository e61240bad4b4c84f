"""Synthetic images from the driver tables, by integer formulas.

A packed image is a row with one array a channel, row-major; exploding it gives a row a pixel. Operators that look at other pixels of the
same image read them from the arrays, so they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(images: DataFrame, formulas: dict[str, object]) -> DataFrame:
    """image_id, width, height and an array a channel, from a function of x and y a channel."""

    def channel(f) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: f((i % F.col("width")).cast("int"), F.floor(i / F.col("width")).cast("int")).cast("int"))

    return images.select("image_id", "width", "height", *[channel(formulas[c]).alias(c) for c in CHANNELS])


def part_images(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One small image with a flat band and varied alpha for each part. dealt: keys are shuffled by image_id before the arrays are made, so that images of one small file
    spread over all tasks and what joins or groups them by image_id later needs no shuffle of arrays."""
    k, s = F.col("key"), F.col("size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key") if dealt else rows
    rows = rows.select(k.alias("image_id"), (3 + s % 6).cast("int").alias("width"), (2 + s % 4).cast("int").alias("height"), k, s)
    band = lambda flat, value: lambda x, y: F.when(x < 2, flat).otherwise(value(x, y))
    formulas = {
        "r": band(90, lambda x, y: (k * 31 + 7 * x + 3 * y) % 256),
        "g": band(160, lambda x, y: (k * 11 + x + y) % 256),
        "b": band(35, lambda x, y: (x * y + s) % 256),
        "a": band(255, lambda x, y: 255 - (5 * x * y + 3 * k) % 160),
    }
    return packed(rows, formulas)


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opaque 8 by 8 gray image for each embedding."""
    gray = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), gray.alias("r"))
    return rows.select("image_id", "width", "height", "r", F.col("r").alias("g"), F.col("r").alias("b"), F.transform("r", lambda _: F.lit(255)).alias("a"))


def exploded(images: DataFrame) -> DataFrame:
    """A row a pixel: image_id, width, height, y, x, r, g, b, a."""
    row = images.select("image_id", "width", "height", F.posexplode(F.arrays_zip(*CHANNELS)).alias("i", "p"))
    return row.select("image_id", "width", "height", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), *[F.col(f"p.{c}").alias(c) for c in CHANNELS])


def assembled(pixels: DataFrame) -> DataFrame:
    """Packed images from pixel rows, one shuffle by image; images whose pixels don't fill width times height are left out."""
    order = F.array_sort(F.collect_list(F.struct("y", "x", *CHANNELS)))
    rows = pixels.groupBy("image_id", "width", "height").agg(order.alias("p")).filter(F.size("p") == F.col("width") * F.col("height"))
    return rows.select("image_id", "width", "height", *[F.col(f"p.{c}").alias(c) for c in CHANNELS])


#: The same pixels in DuckDB.
PART_PIXELS = """
part_images AS (SELECT p_partkey AS image_id, 3 + p_size % 6 AS width, 2 + p_size % 4 AS height, p_partkey AS k, p_size AS s FROM part),
part_places AS (SELECT *, unnest(range(0, width * height)) AS i FROM part_images),
px AS (SELECT image_id, width, height, CAST(i // width AS INTEGER) AS y, CAST(i % width AS INTEGER) AS x,
  CAST(CASE WHEN i % width < 2 THEN 90 ELSE (k * 31 + 7 * (i % width) + 3 * (i // width)) % 256 END AS INTEGER) AS r,
  CAST(CASE WHEN i % width < 2 THEN 160 ELSE (k * 11 + (i % width) + (i // width)) % 256 END AS INTEGER) AS g,
  CAST(CASE WHEN i % width < 2 THEN 35 ELSE ((i % width) * (i // width) + s) % 256 END AS INTEGER) AS b,
  CAST(CASE WHEN i % width < 2 THEN 255 ELSE 255 - (5 * (i % width) * (i // width) + 3 * k) % 160 END AS INTEGER) AS a
  FROM part_places)"""
VECTOR_PIXELS = """
vec_places AS (SELECT vec_id AS image_id, unnest(range(0, 64)) AS i, embedding FROM embeddings),
vx AS (SELECT image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
  CAST(greatest(0, least(255, floor((CAST(embedding[CAST(i + 1 AS INTEGER)] AS DOUBLE) + 1) * 127.5))) AS INTEGER) AS v FROM vec_places)"""
