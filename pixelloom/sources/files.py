"""Image files as tables, in batch and as a stream, and tables as image files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, udfs

#: File name endings that aren't the format's name.
EXTENSIONS = {"jpeg": "jpg", "netpbm": "ppm"}


def read_images(spark: SparkSession, path: str, pattern: str = "*", most: int = codecs.MOST_PIXELS) -> DataFrame:
    """A row a file: path, length, format, pixels, and an error where a file can't be decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return udfs.decoded(files.select("path", "length", "content"), most=most)


def encoded(images: DataFrame, name: str, quality: int = 90) -> DataFrame:
    """image_id, content and error of packed images."""
    return images.select("image_id", udfs.encode_image(name, quality).alias("e")).select("image_id", "e.content", "e.error")


def write_images(images: DataFrame, path: str, name: str, quality: int = 90, metadata: str | None = None) -> DataFrame:
    """Writes <path>/<image_id>.<format> for each packed image as the rows it returns are computed: image_id, path, length, error. path is a folder that all executors
    reach; metadata: a column with an EXIF block. A file appears whole or not at all, and a task that runs again writes the same."""
    block = F.col(metadata) if metadata else None
    content = images.select("image_id", udfs.encode_image(name, quality, block).alias("e")).select("image_id", "e.content", "e.error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            files, sizes = [], []
            for key, data in zip(b.column("image_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                target = f"{folder}/{key}.{EXTENSIONS.get(name, name)}"
                if data is not None:
                    part = f"{folder}/_{key}-{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        out.write(data)
                    store.move(part, target)
                files.append(target if data is not None else None)
                sizes.append(len(data) if data is not None else None)
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(files, pa.string()), pa.array(sizes, pa.int64()), b.column("error")], ["image_id", "path", "length", "error"])

    return content.mapInArrow(run, "image_id long, path string, length long, error struct<code: string, reason: string>")
