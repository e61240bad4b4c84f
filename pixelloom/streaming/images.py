"""Images that arrive as files: the batch functions over a stream, and counts by format and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, udfs

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, path: str, files_at_a_time: int = 100, most: int = codecs.MOST_PIXELS) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_at_a_time).load(path)
    return udfs.decoded(files.select("path", "modificationTime", "length", "content"), most=most)


def counts_by_time(images: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files, bytes and errors by format and time of arrival; a window closes when files are `late` past it."""
    by = images.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), "format")
    return by.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count("error").alias("errors"))
