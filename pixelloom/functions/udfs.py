"""Codecs as Arrow-batched functions over columns. Errors are values, so bad input costs a row and not a job."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import INVALID_DATA, ImageError, unsupported
from . import codecs, exif
from .codecs import gif, info, svg

ERROR = "error struct<code: string, reason: string>"
ARRAYS = ", ".join(f"{c} array<int>" for c in "rgba")
#: Pixels whose four arrays of integers fit in a Spark row of under 2 GB, and pixels that go to the JVM at a time unless one image has more.
ROW_PIXELS, BATCH_PIXELS = 2**27 - 2**10, 2**22
DECODED = f"struct<format: string, width: int, height: int, {ARRAYS}, {ERROR}>"


def guarded(f, *args) -> tuple[object, dict | None]:
    """The value, or the error as a row; unforeseen faults of hostile input count as invalid data."""
    try:
        return f(*args), None
    except ImageError as e:
        return None, {"code": e.code, "reason": e.reason}
    except (ValueError, IndexError, KeyError, OverflowError, MemoryError) as e:
        return None, {"code": INVALID_DATA, "reason": str(e)[:200]}


def encode_image(name: str, quality: int = 90, metadata: str | Column | None = None) -> Column:
    """struct<content, error> of the packed image in columns width, height, r, g, b, a; metadata: an EXIF block to put into formats that can hold one."""

    @F.pandas_udf(f"struct<content: binary, {ERROR}>")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for width, height, blocks, *channels in parts:
            rows = []
            for w, h, block, *cells in zip(width, height, blocks, *channels, strict=True):
                pixels = np.stack([np.asarray(c, np.uint8) for c in cells], axis=1).reshape(h, w, 4)
                rows.append(guarded(codecs.encode, pixels, name, quality, bytes(block) if block is not None else None))
            yield pd.DataFrame({"content": [v for v, _ in rows], "error": [e for _, e in rows]})

    return run("width", "height", F.lit(None).cast("binary") if metadata is None else metadata, "r", "g", "b", "a")


def decode_image(content: str | Column, name: str | None = None, most: int = codecs.MOST_PIXELS) -> Column:
    """struct<format, width, height, r, g, b, a, error> of file bytes; the format is detected unless it's given. Images over `most` pixels are errors."""

    def one(data: bytes) -> tuple[str, np.ndarray]:
        found, pixels = codecs.decode(data, name, most)
        if pixels.shape[0] * pixels.shape[1] > ROW_PIXELS:
            raise unsupported(f"a row of over {ROW_PIXELS} pixels")
        return found, pixels

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["format", "width", "height", *"rgba", "error"])
        return out.astype({"width": "Int32", "height": "Int32"})

    @F.pandas_udf(DECODED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for data in parts:
            rows, held = [], 0
            for d in data:
                value, error = guarded(one, bytes(d or b""))
                found, pixels = value if value else (None, None)
                size = pixels.shape[0] * pixels.shape[1] if value else 0
                if rows and held + size > BATCH_PIXELS:
                    yield frame(rows)
                    rows, held = [], 0
                cells = [pixels[..., k].reshape(-1).astype(np.int32) if value else None for k in range(4)]
                rows.append((found, pixels.shape[1] if value else None, pixels.shape[0] if value else None, *cells, error))
                held += size
            yield frame(rows)

    return run(content)


def decoded(files: DataFrame, content: str = "content", most: int = codecs.MOST_PIXELS) -> DataFrame:
    """files with format, width, height, r, g, b, a and error in place of the content; images over `most` pixels are errors."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, decode_image(content, most=most).alias("d")).select(*rest, "d.*")


def detect_format(content: Column) -> Column:
    """The first format whose signature the bytes have, as an expression; files of boxes are told apart by their brands."""
    head = F.hex(F.substring(content, 1, 64))
    at = lambda first, n: F.substring(head, 2 * first + 1, 2 * n)
    compatible = F.transform(F.sequence(F.lit(4), F.lit(15)), lambda k: F.when(k * 4 + 4 <= F.conv(at(0, 4), 16, 10).cast("int"), F.substr(head, k * 8 + 1, F.lit(8))))
    brands = F.array_append(compatible, at(8, 4))
    named = lambda marks: F.arrays_overlap(F.filter(brands, lambda b: b.isNotNull()), F.array(*[F.lit(m.hex().upper()) for m in sorted(marks)]))
    boxes = at(4, 4) == "66747970"
    tests = [
        ("png", at(0, 8) == "89504E470D0A1A0A"),
        ("jpeg", at(0, 3) == "FFD8FF"),
        ("gif", at(0, 4) == "47494638"),
        ("tiff", at(0, 4).isin("49492A00", "4D4D002A")),
        ("webp", (at(0, 4) == "52494646") & (at(8, 4) == "57454250")),
        ("heic", boxes & named(codecs.HEIC_BRANDS) & ~named(codecs.AVIF_BRANDS)),
        ("avif", boxes & named(codecs.AVIF_BRANDS)),
        ("bmp", at(0, 2) == "424D"),
        ("qoi", at(0, 4) == "716F6966"),
        ("netpbm", at(0, 2).isin("5035", "5036")),
        ("svg", F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "<svg") > 0),
    ]
    found = F.lit(None).cast("string")
    for name, test in reversed(tests):
        found = F.when(test, name).otherwise(found)
    return found


def rasterize_svg(content: str | Column, width: int | None = None, height: int | None = None, most: int = codecs.MOST_PIXELS) -> Column:
    """struct<format, width, height, r, g, b, a, error> of SVG documents at a size of one's own; one side alone keeps the aspect."""

    @F.pandas_udf(DECODED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for data in parts:
            rows = []
            for d in data:
                pixels, error = guarded(svg.rasterize, bytes(d or b""), width, height, min(most, ROW_PIXELS))
                cells = [pixels[..., k].reshape(-1).astype(np.int32) if error is None else None for k in range(4)]
                rows.append(("svg", *((pixels.shape[1], pixels.shape[0]) if error is None else (None, None)), *cells, error))
            yield pd.DataFrame(rows, columns=["format", "width", "height", *"rgba", "error"]).astype({"width": "Int32", "height": "Int32"})

    return run(content)


ELEMENT = "struct<even_odd: boolean, r: int, g: int, b: int, a: int, opacity: double, subpaths: array<struct<points: array<struct<x: double, y: double>>, is_closed: boolean>>>"


def svg_elements(content: str | Column, precision: float = 4.0) -> Column:
    """struct<width, height, elements, error> of SVG documents: filled outlines in painting order; posexplode gives a row an element."""

    @F.pandas_udf(f"struct<width: double, height: double, elements: array<{ELEMENT}>, {ERROR}>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            value, error = guarded(svg.elements, bytes(d or b""), precision)
            rows.append((*(value or (None, None, None)), error))
        return pd.DataFrame(rows, columns=["width", "height", "elements", "error"])

    return run(content)


def image_info(content: str | Column) -> Column:
    """struct of format and size from headers, and for HEIF containers item type, turns, mirror, grid, tiles and alpha item; no pixels are decoded."""
    whole = ("width", "height", "turns", "mirror", "columns", "rows")

    @F.pandas_udf(f"struct<format: string, {', '.join(f'{k}: int' for k in whole)}, item_type: string, alpha: long, tiles: array<long>, {ERROR}>")
    def run(data: pd.Series) -> pd.DataFrame:
        names, rows = ["format", *whole, "item_type", "alpha", "tiles"], []
        for d in data:
            value, error = guarded(info.describe, bytes(d or b""))
            rows.append([*((value or {}).get(k) for k in names), error])
        return pd.DataFrame(rows, columns=[*names, "error"]).astype(dict.fromkeys(whole, "Int32") | {"alpha": "Int64"})

    return run(content)


def median_cut(colors: int) -> Column:
    """array<struct<r, g, b>> of at most `colors` colours for the packed image in columns r, g, b, a, from its pixels that are at least half opaque."""

    @F.pandas_udf("array<struct<r: int, g: int, b: int>>")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for channels in parts:
            out = []
            for cells in zip(*channels, strict=True):
                p = np.stack([np.asarray(c, np.uint8) for c in cells], axis=1)
                distinct, counts = np.unique(p[p[:, 3] >= 128][:, :3], axis=0, return_counts=True)
                found = gif.median_cut(distinct, counts, colors)[0] if len(distinct) > colors else distinct
                out.append([dict(zip("rgb", map(int, c), strict=True)) for c in found])
            yield pd.Series(out)

    return run(*"rgba")


def compress(content: str | Column) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: zlib.compress(bytes(d)), na_action="ignore")

    return run(content)


def decompress(content: str | Column, most: int = 2**28) -> Column:
    """struct<content, error>; output over `most` bytes, a wrong checksum or a preset dictionary is an error."""

    def one(data: bytes) -> bytes:
        if len(data) < 6 or data[0] & 15 != 8 or int.from_bytes(data[:2], "big") % 31:
            raise ImageError(INVALID_DATA, "zlib header")
        if data[1] & 32:
            raise ImageError("unsupportedFeature", "preset dictionary")
        inflater = zlib.decompressobj()
        try:
            out = inflater.decompress(data, most + 1)
        except zlib.error as e:
            raise ImageError(INVALID_DATA, str(e)) from None
        if len(out) > most or not inflater.eof:
            raise ImageError(INVALID_DATA, "length of zlib output")
        return out

    @F.pandas_udf(f"struct<content: binary, {ERROR}>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [guarded(one, bytes(d or b"")) for d in data]
        return pd.DataFrame({"content": [v for v, _ in rows], "error": [e for _, e in rows]})

    return run(content)


def adler32(content: str | Column) -> Column:
    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: zlib.adler32(bytes(d)), na_action="ignore")

    return run(content)


def exif_of(content: str | Column) -> Column:
    """struct of the fields that people look for, from a file's or a bare block's EXIF; nulls where there is none."""
    kinds = "make: string, model: string, software: string, date_time: string, orientation: int, f_number: double, iso: int, exposure_time: double, focal_length: double, lens_model: string, date_time_original: string, latitude: double, longitude: double, altitude: double"

    def number(v):
        if v is None or not v[1] or v[0] in (2, 7):
            return None
        first = v[1][0]
        return (first[0] / first[1] if first[1] else None) if isinstance(first, tuple) else first

    @F.pandas_udf(f"struct<{kinds}>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            e = exif.read(bytes(d or b"")) or exif.Exif()
            text = lambda v: v[1] if v and v[0] == 2 else None
            row = {k: text(e.tags.get(tag)) for k, tag in exif.NAMES.items()} | {k: e.photo.get(tag) for k, tag in exif.PHOTO_NAMES.items()}
            row = {k: (text(v) if k in ("lens_model", "date_time_original") else number(v)) if isinstance(v, tuple) else v for k, v in row.items()}
            row["orientation"] = number(e.tags.get(exif.ORIENTATION))
            row["latitude"] = exif.degrees(e.gps.get(exif.LATITUDE), e.gps.get(exif.LATITUDE_REF))
            row["longitude"] = exif.degrees(e.gps.get(exif.LONGITUDE), e.gps.get(exif.LONGITUDE_REF))
            row["altitude"] = exif.altitude(e.gps.get(exif.ALTITUDE), e.gps.get(exif.ALTITUDE_REF))
            rows.append(row)
        names = [k.split(":")[0] for k in kinds.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"orientation": "Int32", "iso": "Int32"})

    return run(content)
