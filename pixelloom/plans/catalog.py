"""Queries over the driver tables, one or more for each operator, and the same in DuckDB SQL where that is possible."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exif, udfs
from ..operators import colors, geometry
from ..sources import files
from ..sources.fixtures import PART_PIXELS, VECTOR_PIXELS, assembled, exploded, part_images, table, vector_images

PIXEL = "image_id, y, x, r, g, b, a"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def on_pixels(name: str, f, sql: str, dealt: bool = False) -> None:
    query(name, f"WITH {PART_PIXELS} {sql}")(lambda spark, d: f(exploded(part_images(spark, d, dealt))))


def on_images(name: str, f, sql: str | None, dealt: bool = False) -> None:
    query(name, sql and f"WITH {PART_PIXELS} {sql}")(lambda spark, d: f(part_images(spark, d, dealt)))


SIZED = "image_id, {} AS width, {} AS height, CAST({} AS INTEGER) AS y, CAST({} AS INTEGER) AS x, r, g, b, a"
on_pixels("synth_pixels", lambda p: p, "SELECT * FROM px")
on_pixels("assemble", lambda p: exploded(assembled(p)), "SELECT * FROM px")
on_images("write_point", lambda i: exploded(geometry.write_point(i, F.lit(3), F.lit(2), (9, 8, 7, 6))), "SELECT * REPLACE (CASE WHEN x = 3 AND y = 2 THEN 9 ELSE r END AS r, CASE WHEN x = 3 AND y = 2 THEN 8 ELSE g END AS g, CASE WHEN x = 3 AND y = 2 THEN 7 ELSE b END AS b, CASE WHEN x = 3 AND y = 2 THEN 6 ELSE a END AS a) FROM px WHERE width > 3 AND height > 2")
on_images("has_edits", lambda i: geometry.has_edits(geometry.write_point(i, F.lit(0), F.lit(0), (90, 160, 35, 255)).unionByName(geometry.write_point(i, F.lit(4), F.lit(0), (1, 1, 1, 1))), i), "SELECT image_id, unnest(CASE WHEN width > 4 THEN [false, true] ELSE [false] END) AS edited FROM part_images", dealt=True)
on_images("fill", lambda i: geometry.fill(i, (1, 2, 3, 4)), "SELECT image_id, width, height, y, x, 1 AS r, 2 AS g, 3 AS b, 4 AS a FROM px")
TURNED = {90: ("height", "width", "x", "height - 1 - y"), 180: ("width", "height", "height - 1 - y", "width - 1 - x"), 270: ("height", "width", "width - 1 - x", "y")}
for turn, way in TURNED.items():
    on_pixels(f"rotate_{turn}", lambda p, turn=turn: geometry.rotate(p, turn), f"SELECT {SIZED.format(*way)} FROM px")
on_pixels("mirror_h", lambda p: geometry.mirror(p, "horizontal"), f"SELECT {SIZED.format('width', 'height', 'y', 'width - 1 - x')} FROM px")
on_pixels("mirror_v", lambda p: geometry.mirror(p, "vertical"), f"SELECT {SIZED.format('width', 'height', 'height - 1 - y', 'x')} FROM px")
#: Width, height, y and x after each EXIF orientation.
ORIENTED = {1: ("width", "height", "y", "x"), 2: ("width", "height", "y", "width - 1 - x"), 3: TURNED[180], 4: ("width", "height", "height - 1 - y", "x"), 5: ("height", "width", "x", "y"), 6: TURNED[90], 7: ("height", "width", "width - 1 - x", "height - 1 - y"), 8: TURNED[270]}


@query("orient_all8", f"WITH {PART_PIXELS} " + " UNION ALL ".join(f"SELECT {o} AS orientation, {SIZED.format(*way)} FROM px" for o, way in ORIENTED.items()))
def orient_all8(spark: SparkSession, d: str) -> DataFrame:
    """All orientations of every pixel."""
    pixels = exploded(part_images(spark, d))
    turned = [geometry.orient(pixels, o).withColumn("orientation", F.lit(o)) for o in ORIENTED]
    return reduce(DataFrame.unionByName, turned)


HEIF_TURNS = {0: ORIENTED[1], 1: TURNED[270], 2: TURNED[180], 3: TURNED[90]}
on_pixels("heif_orient", lambda p: reduce(DataFrame.unionByName, [geometry.heif_orient(p, t, 1).withColumn("turns", F.lit(t)) for t in HEIF_TURNS]), " UNION ALL ".join(f"SELECT {t} AS turns, {SIZED.format(way[0], way[1], way[1] + ' - 1 - (' + way[2] + ')', way[3])} FROM px" for t, way in HEIF_TURNS.items()))
APERTURE = ", ap AS (SELECT *, (2 * width - 3) // 2 AS aw, height - 1 AS ah FROM px), sat AS (SELECT *, greatest(0, least(width - aw, CAST(trunc(((width - aw) * 2 + 2 * -1) / 4.0) AS INTEGER))) AS ax, greatest(0, least(height - ah, CAST(trunc(((height - ah) * 3 + 2 * 4) / 6.0) AS INTEGER))) AS ay FROM ap)"
on_pixels("clean_aperture", lambda p: geometry.clean_aperture(p, (F.col("width") * 2 - 3, 2), (F.col("height") - 1, 1), (-1, 2), (4, 3)), f"{APERTURE} SELECT {SIZED.format('aw', 'ah', 'y - ay', 'x - ax')} FROM sat WHERE x BETWEEN ax AND ax + aw - 1 AND y BETWEEN ay AND ay + ah - 1")


on_pixels("crop", lambda p: geometry.crop(p, 1, 1, 3, 2), f"SELECT {SIZED.format('3', '2', 'y - 1', 'x - 1')} FROM px WHERE 4 <= width AND 3 <= height AND x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2")
on_images("crop_errors", lambda i: geometry.crop_errors(i, 1, 1, 3, 2), "SELECT image_id, CASE WHEN 1 > width - 3 OR 1 > height - 2 THEN 'regionOutOfBounds' END AS error FROM part_images")
HALF = "greatest(1, {0} // 2)"
on_pixels(
    "crop_center_half", geometry.crop_center_half,
    "SELECT image_id, CAST(hw AS INTEGER) AS width, CAST(hh AS INTEGER) AS height, CAST(y - (height - hh) // 2 AS INTEGER) AS y, CAST(x - (width - hw) // 2 AS INTEGER) AS x, r, g, b, a "
    f"FROM (SELECT *, {HALF.format('width')} AS hw, {HALF.format('height')} AS hh FROM px) WHERE x BETWEEN (width - hw) // 2 AND (width - hw) // 2 + hw - 1 AND y BETWEEN (height - hh) // 2 AND (height - hh) // 2 + hh - 1",
)
on_images("scale_dims", lambda i: geometry.scaled_dims(i, 0.5), "SELECT image_id, CAST(greatest(1, floor(width * 0.5 + 0.5)) AS INTEGER) AS width, CAST(greatest(1, floor(height * 0.5 + 0.5)) AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS error FROM part_images")
on_images(
    "resize_nearest", lambda i: geometry.resize_nearest(i, 7, 5),
    ", t AS (SELECT i.image_id, i.width AS w, i.height AS h, CAST(j // 7 AS INTEGER) AS ty, CAST(j % 7 AS INTEGER) AS tx FROM part_images i, range(0, 35) AS u(j)) "
    "SELECT t.image_id, 7 AS width, 5 AS height, ty AS y, tx AS x, r, g, b, a FROM t JOIN px ON px.image_id = t.image_id AND px.x = least(w - 1, CAST(floor((tx + 0.5) * w / 7) AS INTEGER)) AND px.y = least(h - 1, CAST(floor((ty + 0.5) * h / 5) AS INTEGER))",
)
TAPS = """, t AS (SELECT i.image_id, i.width AS w, i.height AS h, CAST(j // 8 AS INTEGER) AS ty, CAST(j % 8 AS INTEGER) AS tx FROM part_images i, range(0, 64) AS u(j)),
c AS (SELECT *, greatest(0.0::DOUBLE, least(CAST(w - 1 AS DOUBLE), (tx + 0.5::DOUBLE) * (CAST(w AS DOUBLE) / 8) - 0.5::DOUBLE)) AS cx, greatest(0.0::DOUBLE, least(CAST(h - 1 AS DOUBLE), (ty + 0.5::DOUBLE) * (CAST(h AS DOUBLE) / 8) - 0.5::DOUBLE)) AS cy FROM t),
q AS (SELECT *, CAST(floor(cx) AS INTEGER) AS x0, CAST(least(floor(cx) + 1, w - 1) AS INTEGER) AS x1, cx - floor(cx) AS fx, CAST(floor(cy) AS INTEGER) AS y0, CAST(least(floor(cy) + 1, h - 1) AS INTEGER) AS y1, cy - floor(cy) AS fy FROM c)"""
BLEND = "CAST(floor((p00.{0}::DOUBLE + (p01.{0}::DOUBLE - p00.{0}::DOUBLE) * fx) + ((p10.{0}::DOUBLE + (p11.{0}::DOUBLE - p10.{0}::DOUBLE) * fx) - (p00.{0}::DOUBLE + (p01.{0}::DOUBLE - p00.{0}::DOUBLE) * fx)) * fy + 0.5::DOUBLE) AS INTEGER) AS {0}"
BILINEAR = f"{TAPS}, bl AS (SELECT q.image_id, 8 AS width, 8 AS height, ty AS y, tx AS x, {', '.join(BLEND.format(c) for c in 'rgba')} FROM q " + " ".join(f"JOIN px p{j}{i} ON p{j}{i}.image_id = q.image_id AND p{j}{i}.x = x{i} AND p{j}{i}.y = y{j}" for j in (0, 1) for i in (0, 1)) + ")"
on_images("resize_bilinear", lambda i: geometry.resize_bilinear(i, 8, 8), f"{BILINEAR} SELECT * FROM bl")


@query("grid_stitch", f"WITH {VECTOR_PIXELS}, s AS (SELECT image_id // 4 AS grid, y + (image_id % 4) // 2 * 8 AS gy, x + image_id % 2 * 8 AS gx, v FROM vx) SELECT grid AS image_id, 15 AS width, 13 AS height, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, v AS r, v AS g, v AS b, 255 AS a FROM s WHERE gx < 15 AND gy < 13")
def grid_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Every four images as one, cropped as grids of tiles are."""
    return geometry.grid_stitch(exploded(vector_images(spark, d)), 2, 2, F.lit(15), F.lit(13))


@query("pixel_probe", f"WITH {PART_PIXELS}, pts AS (SELECT p_partkey AS image_id, CAST(p_size % 7 AS INTEGER) AS x, CAST(p_size % 5 AS INTEGER) AS y FROM part) SELECT pts.image_id, pts.x, pts.y, r, g, b, a FROM pts LEFT JOIN px USING (image_id, x, y)")
def pixel_probe(spark: SparkSession, d: str) -> DataFrame:
    """One point in each image, null outside; read from the packed arrays."""
    points = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 7).cast("int").alias("x"), (F.col("p_size") % 5).cast("int").alias("y"))
    return geometry.probe(part_images(spark, d), points)


on_pixels("color_histogram", colors.histogram, "SELECT image_id, r, g, b, count(*) AS n FROM px WHERE a >= 128 GROUP BY ALL")
PALETTE = ", pal AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT image_id, r, g, b FROM px WHERE a >= 128))"
on_pixels("palette_rank", colors.palette, f"{PALETTE} SELECT * FROM pal")
on_pixels("palette_join", colors.indexed, f"{PALETTE} SELECT image_id, y, x, idx FROM px JOIN pal USING (image_id, r, g, b) WHERE a >= 128", dealt=True)
on_pixels("palette_out_of_range", lambda p: p.filter("a >= 128").join(colors.palette(p).filter("idx < 4"), ["image_id", "r", "g", "b"], "left_anti").select("image_id", "y", "x"), f"{PALETTE} SELECT image_id, y, x FROM px JOIN pal USING (image_id, r, g, b) WHERE a >= 128 AND idx >= 4")
on_pixels("alpha_flags", colors.alpha_flags, "SELECT image_id, bool_and(a = 0) AS all_clear, bool_or(a < 128) AS any_clear, bool_and(a = 255) AS opaque FROM px GROUP BY 1")
on_pixels("over_composite", lambda p: colors.source_over(p, {"r": F.lit(10), "g": F.lit(200), "b": F.lit(90), "a": (F.col("x") * 40 + F.col("y")) % 256}), """, o AS (SELECT *, ((x * 40 + y) % 256) / 255.0::DOUBLE AS t, a / 255.0::DOUBLE AS u FROM px), s AS (SELECT *, t + u * (1 - t) AS o FROM o)
SELECT image_id, y, x, """ + ", ".join(f"CASE WHEN o <= 0 THEN 0 ELSE CAST(floor(({v} * t + {c} * u * (1 - t)) / o + 0.5::DOUBLE) AS INTEGER) END AS {c}" for c, v in (("r", 10), ("g", 200), ("b", 90))) + ", CAST(floor(o * 255 + 0.5::DOUBLE) AS INTEGER) AS a FROM s")
on_images("alpha_merge", lambda i: exploded(colors.merge_alpha(i, i.filter(F.col("width") * F.col("height") % 2 == 0))), "SELECT image_id, width, height, y, x, r, g, b, CASE WHEN width * height % 2 = 0 THEN r ELSE a END AS a FROM px")
on_pixels("subtract_green", lambda p: p.select("image_id", "y", "x", F.pmod(F.col("r") + F.col("g"), F.lit(256)).alias("r"), "g", F.pmod(F.col("b") + F.col("g"), F.lit(256)).alias("b"), "a"), "SELECT image_id, y, x, (r + g) % 256 AS r, g, (b + g) % 256 AS b, a FROM px")
on_pixels("delta_decode", lambda p: colors.delta_decode(p, "r"), "SELECT image_id, y, x, CAST(sum(r) OVER (PARTITION BY image_id, y ORDER BY x) % 256 AS INTEGER) AS value FROM px")
on_pixels("rle_runs", colors.runs, ", n AS (SELECT *, row_number() OVER w AS k, CASE WHEN (r, g, b, a) IS NOT DISTINCT FROM lag((r, g, b, a)) OVER w THEN 0 ELSE 1 END AS new FROM px WINDOW w AS (PARTITION BY image_id ORDER BY y, x)), m AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY y, x) AS run FROM n) SELECT image_id, CAST(min(y * width + x) AS INTEGER) AS start, count(*) AS length FROM m GROUP BY image_id, run")


def ycbcr_roundtrip(pixels: DataFrame) -> DataFrame:
    y, cb, cr = colors.to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    there = pixels.select("image_id", "y", "x", y.alias("luma"), cb.alias("cb"), cr.alias("cr"))
    r, g, b = colors.from_ycbcr(F.col("luma"), F.col("cb"), F.col("cr"))
    return there.select("*", r.alias("r"), g.alias("g"), b.alias("b"))


CLAMP = "CAST(greatest(0, least(255, {0})) AS INTEGER)"
on_pixels("ycbcr_roundtrip", ycbcr_roundtrip, f""", t AS (SELECT image_id, y, x, {CLAMP.format('floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)')} AS luma,
{CLAMP.format('floor(-0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b + 128 + 0.5::DOUBLE)')} AS cb, {CLAMP.format('floor(0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b + 128 + 0.5::DOUBLE)')} AS cr FROM px)
SELECT *, {CLAMP.format('luma + (((cr - 128) * 91881 + 32768) >> 16)')} AS r, {CLAMP.format('luma - (((cb - 128) * 22554 + (cr - 128) * 46802 + 32768) >> 16)')} AS g, {CLAMP.format('luma + (((cb - 128) * 116131 + 32768) >> 16)')} AS b FROM t""")
NEAR = ", ".join(f"coalesce(l.{c}, 0) AS l{c}, coalesce(u.{c}, 0) AS u{c}, coalesce(d.{c}, 0) AS d{c}, p.{c} AS p{c}" for c in "rgba")
PAETH = "CASE WHEN abs(u{0} - d{0}) <= abs(l{0} - d{0}) AND abs(u{0} - d{0}) <= abs(l{0} + u{0} - 2 * d{0}) THEN l{0} WHEN abs(l{0} - d{0}) <= abs(l{0} + u{0} - 2 * d{0}) THEN u{0} ELSE d{0} END"
GUESSES = ["0", "l{0}", "u{0}", "(l{0} + u{0}) // 2", PAETH]
FOLDED = "least((p{0} - ({1}) + 512) % 256, 256 - (p{0} - ({1}) + 512) % 256)"
on_images("png_filter_choice", colors.filter_choice, f""", nb AS (SELECT p.image_id, p.y, p.x, {NEAR} FROM px p LEFT JOIN px l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN px u ON u.image_id = p.image_id AND u.y = p.y - 1 AND u.x = p.x LEFT JOIN px d ON d.image_id = p.image_id AND d.y = p.y - 1 AND d.x = p.x - 1),
sc AS (""" + " UNION ALL ".join(f"SELECT image_id, y, {k} AS filter, CAST(sum({' + '.join(FOLDED.format(c, guess.format(c)) for c in 'rgba')}) AS BIGINT) AS score FROM nb GROUP BY image_id, y" for k, guess in enumerate(GUESSES)) + ") SELECT image_id, y, arg_min(filter, score * 8 + filter) AS filter, min(score) AS score FROM sc GROUP BY image_id, y")


@query("vector_pixels", f"WITH {VECTOR_PIXELS} SELECT image_id, 8 AS width, 8 AS height, y, x, v AS r, v AS g, v AS b, 255 AS a FROM vx")
def vector_pixels(spark: SparkSession, d: str) -> DataFrame:
    return exploded(vector_images(spark, d))


@query("flagship", f"WITH {PART_PIXELS}{BILINEAR} SELECT image_id, avg(CAST(r AS DOUBLE)) AS mean_r, avg(CAST(g AS DOUBLE)) AS mean_g, avg(CAST(b AS DOUBLE)) AS mean_b FROM bl GROUP BY 1")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Images to QOI files and back, resized, and the mean of each channel."""
    back = udfs.decoded(files.encoded(part_images(spark, d), "qoi").select("image_id", "content"))
    pixels = geometry.resize_bilinear(back.select("image_id", "width", "height", "r", "g", "b", "a"), 8, 8)
    return pixels.groupBy("image_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in "rgb"])


def roundtrip(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        back = udfs.decoded(files.encoded(part_images(spark, d, dealt=True), name).select("image_id", "content"))
        return exploded(back).select("image_id", "width", "height", "y", "x", "r", "g", "b", "a")

    return run


for name in ("qoi", "png", "tiff", "webp"):
    query(f"roundtrip_{name}", f"WITH {PART_PIXELS} SELECT * FROM px")(roundtrip(name))
for name in ("bmp", "netpbm"):
    query(f"roundtrip_{name}", f"WITH {PART_PIXELS} SELECT * REPLACE (255 AS a) FROM px")(roundtrip(name))


@query("roundtrip_gif", f"WITH {PART_PIXELS} SELECT image_id, y, x, CASE WHEN a < 128 THEN 0 ELSE r END AS r, CASE WHEN a < 128 THEN 0 ELSE g END AS g, CASE WHEN a < 128 THEN 0 ELSE b END AS b, CASE WHEN a < 128 THEN 0 ELSE 255 END AS a FROM px")
def roundtrip_gif(spark: SparkSession, d: str) -> DataFrame:
    return roundtrip("gif")(spark, d).select("image_id", "y", "x", "r", "g", "b", "a")


@query("jpeg_error_bound", "SELECT vec_id AS image_id, true AS close FROM embeddings")
def jpeg_error_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether every pixel of gray images comes back within 16 at quality 100."""
    images = vector_images(spark, d)
    back = udfs.decoded(images.select("image_id", F.col("r").alias("was"), udfs.encode_image("jpeg", 100).getField("content").alias("content")))
    worst = F.array_max(F.zip_with("r", "was", lambda x, y: F.abs(x - y)))
    return back.select("image_id", (worst <= 16).alias("close"))


@query("max_channel_error", f"WITH {PART_PIXELS} SELECT image_id, CAST(max(255 - a) AS INTEGER) AS error FROM px GROUP BY 1")
def max_channel_error(spark: SparkSession, d: str) -> DataFrame:
    """Largest difference of images and what a format without alpha gives back, from the packed arrays."""
    images = part_images(spark, d, dealt=True)
    return colors.channel_error(images, udfs.decoded(files.encoded(images, "bmp").select("image_id", "content")))


@query("detect_format", "SELECT page_id, CASE WHEN regexp_matches(substr(hex(encode(html)), 1, 2048), '^(..)*3C737667') THEN 'svg' END AS format FROM pages")
def detect_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", udfs.detect_format(F.col("html").cast("binary")).alias("format"))


@query("detect_encoded", "SELECT p_partkey AS image_id, unnest(['png', 'jpeg', 'gif', 'tiff', 'bmp', 'qoi', 'netpbm']) AS name, unnest(['png', 'jpeg', 'gif', 'tiff', 'bmp', 'qoi', 'netpbm']) AS format FROM part")
def detect_encoded(spark: SparkSession, d: str) -> DataFrame:
    images = part_images(spark, d)
    contents = images.select("image_id", *[udfs.encode_image(n).getField("content").alias(n) for n in ("png", "jpeg", "gif", "tiff", "bmp", "qoi", "netpbm")])
    long = contents.unpivot(["image_id"], [c for c in contents.columns if c != "image_id"], "name", "content")
    return long.select("image_id", "name", udfs.detect_format(F.col("content")).alias("format"))


@query("decode_errors", "SELECT doc_id, 'unknownFormat' AS code FROM documents")
def decode_errors(spark: SparkSession, d: str) -> DataFrame:
    """Texts aren't images: each is an error value and the job goes on."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return udfs.decoded(rows).select("doc_id", F.col("error.code").alias("code"))


BYTES = ", bytes AS (SELECT doc_id, n, k, CAST(('0x' || substr(h, CAST(2 * k + 1 AS INTEGER), 2)) AS BIGINT) AS v FROM (SELECT doc_id, h, n, unnest(range(0, n)) AS k FROM texts))"
TEXTS = "texts AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents)"


@query("adler32", f"WITH {TEXTS}{BYTES} SELECT doc_id, CAST(((n + sum((n - k) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521 AS BIGINT) AS checksum FROM bytes GROUP BY doc_id, n")
def adler32(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of whole texts."""
    return table(spark, d, "documents").select("doc_id", udfs.adler32(F.col("text").cast("binary")).alias("checksum"))


def crc_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


CRC_TABLE = f"{[crc_step(n) for n in range(256)]}::BIGINT[]"
CRC_SQL = f"SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list(v ORDER BY k)), lambda c, v: xor(c >> 8, list_extract({CRC_TABLE}, 1 + (xor(c, v) & 255)))), 4294967295) AS checksum FROM bytes GROUP BY doc_id"


@query("crc32", f"WITH {TEXTS}{BYTES} {CRC_SQL}")
def crc32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("checksum"))


@query("zlib_roundtrip", "SELECT doc_id, md5(text) AS digest, CAST(strlen(text) AS INTEGER) AS n FROM documents")
def zlib_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", udfs.decompress(udfs.compress(F.col("text").cast("binary"))).getField("content").alias("content"))
    return rows.select("doc_id", F.md5("content").alias("digest"), F.octet_length("content").alias("n"))


GPS = "SELECT c_custkey AS image_id, {0} FROM customer"
EXIF_SQL = GPS.format("'Maker ' || (c_custkey % 7) AS make, CAST(100 * (1 + c_custkey % 8) AS INTEGER) AS iso, CAST(14 + c_custkey % 10 AS DOUBLE) / 10 AS f_number, CASE WHEN c_custkey % 2 = 1 THEN -1 ELSE 1 END * (CAST(c_custkey % 90 AS DOUBLE) + CAST(c_custkey % 60 AS DOUBLE) / 60 + CAST((c_custkey * 7) % 60 AS DOUBLE) / 3600) AS latitude, CASE WHEN c_custkey % 2 = 1 THEN -1 ELSE 1 END * (CAST(c_custkey % 180 AS DOUBLE) + CAST(c_custkey % 60 AS DOUBLE) / 60 + CAST((c_custkey * 7) % 60 AS DOUBLE) / 3600) AS longitude")


@query("exif_roundtrip", EXIF_SQL)
def exif_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written from customer keys, and what is read from them."""
    @F.pandas_udf("binary")
    def write(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            place = lambda whole: (5, [(k % whole, 1), (k % 60, 1), (k * 7 % 60, 1)])
            tags = {271: (2, f"Maker {k % 7}"), exif.ORIENTATION: (3, [1 + k % 8])}
            photo = {34855: (3, [100 * (1 + k % 8)]), 33437: (5, [(14 + k % 10, 10)])}
            return exif.serialize(exif.Exif(tags, photo, {1: (2, "S" if k % 2 else "N"), 2: place(90), 3: (2, "W" if k % 2 else "E"), 4: place(180)}))

        return key.map(one)

    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), udfs.exif_of(write("c_custkey")).alias("e"))
    return rows.select("image_id", "e.make", "e.iso", "e.f_number", "e.latitude", "e.longitude")


@query("exif_gps", GPS.format("CASE WHEN c_custkey % 2 = 1 THEN -1 ELSE 1 END * (CAST(c_custkey % 90 AS DOUBLE) + CAST(c_custkey % 60 AS DOUBLE) / 60 + CAST((c_custkey * 7) % 60 AS DOUBLE) / 3600) AS latitude"))
def exif_gps(spark: SparkSession, d: str) -> DataFrame:
    """Degrees from rationals that are already columns, without Python."""
    k = F.col("c_custkey")
    parts = F.array(*[F.struct(n.alias("num"), F.lit(1).alias("den")) for n in (k % 90, k % 60, k * 7 % 60)])
    rows = table(spark, d, "customer").select(k.alias("image_id"), parts.alias("p"), F.when(k % 2 == 1, "S").otherwise("N").alias("ref"))
    ratio = lambda i: F.col("p")[i].num.cast("double") / F.nullif(F.col("p")[i].den, F.lit(0))
    total = ratio(0) + ratio(1) / 60 + ratio(2) / 3600
    return rows.select("image_id", F.when(F.col("ref").isin("S", "W"), -total).otherwise(total).alias("latitude"))


@query("exif_fields", """SELECT o_orderkey AS image_id, 'Lens ' || (o_orderkey % 9) AS lens_model, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS date_time, strftime(o_orderdate, '%Y:%m:%d 00:00:00') AS date_time_original,
CAST(1 AS DOUBLE) / (1 + o_orderkey % 500) AS exposure_time, CAST(o_orderkey % 300 AS DOUBLE) / 10 AS focal_length, CASE WHEN o_orderkey % 2 = 1 THEN -1 ELSE 1 END * CAST(o_orderkey % 4000 AS DOUBLE) / 4 AS altitude FROM orders""")
def exif_fields(spark: SparkSession, d: str) -> DataFrame:
    """Dates, lens, exposure, focal length and altitude from blocks written from orders."""

    @F.pandas_udf("binary")
    def write(key: pd.Series, at: pd.Series, day: pd.Series) -> pd.Series:
        def one(k: int, t: str, t0: str) -> bytes:
            photo = {33434: (5, [(1, 1 + k % 500)]), 36867: (2, t0), 37386: (5, [(k % 300, 10)]), 42036: (2, f"Lens {k % 9}")}
            return exif.serialize(exif.Exif({306: (2, t)}, photo, {exif.ALTITUDE_REF: (1, [k % 2]), exif.ALTITUDE: (5, [(k % 4000, 4)])}))

        return pd.Series([one(*x) for x in zip(key, at, day, strict=True)])

    rows = table(spark, d, "orders")
    block = write("o_orderkey", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.date_format("o_orderdate", "yyyy:MM:dd 00:00:00"))
    fields = rows.select(F.col("o_orderkey").alias("image_id"), udfs.exif_of(block).alias("e"))
    return fields.select("image_id", *[f"e.{k}" for k in ("lens_model", "date_time", "date_time_original", "exposure_time", "focal_length", "altitude")])


@query("orient_on_decode", f"WITH {PART_PIXELS} " + " UNION ALL ".join(f"SELECT {SIZED.format(*way)} FROM px WHERE image_id % 8 = {o - 1}" for o, way in ORIENTED.items()))
def orient_on_decode(spark: SparkSession, d: str) -> DataFrame:
    """PNG files with an orientation each, which decoding applies."""

    @F.pandas_udf("binary")
    def write(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            block = bytearray(exif.serialize(exif.Exif({exif.ORIENTATION: (3, [1])}, {}, {})))
            block[block.index(struct.pack("<HHI", exif.ORIENTATION, 3, 1)) + 8] = 1 + k % 8
            return bytes(block)

        return key.map(one)

    images = part_images(spark, d).withColumn("exif", write("image_id"))
    back = udfs.decoded(images.select("image_id", udfs.encode_image("png", metadata="exif").getField("content").alias("content")))
    return exploded(back)


@query("jpeg_quality_size", "SELECT vec_id AS image_id, true AS smaller FROM embeddings")
def jpeg_quality_size(spark: SparkSession, d: str) -> DataFrame:
    """Whether a lower quality takes no more bytes."""
    sizes = vector_images(spark, d).select("image_id", *[F.octet_length(udfs.encode_image("jpeg", q).getField("content")).alias(f"q{q}") for q in (20, 60, 95)])
    return sizes.select("image_id", ((F.col("q20") <= F.col("q60")) & (F.col("q60") <= F.col("q95"))).alias("smaller"))


@query("median_cut", f"WITH {VECTOR_PIXELS}, d AS (SELECT image_id, v, count(*) AS n FROM vx GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) AS i, count(*) OVER (PARTITION BY image_id) AS m FROM d), s AS (SELECT *, CASE WHEN m > 2 AND i > m // 2 OR m <= 2 AND i = 2 THEN 1 ELSE 0 END AS box FROM k) SELECT image_id, CAST(box AS INTEGER) AS at, CAST(sum(v * n) // sum(n) AS INTEGER) AS r FROM s GROUP BY image_id, box")
def median_cut(spark: SparkSession, d: str) -> DataFrame:
    """Two colours of gray images: the mean of the lower half of the distinct grays, and of the upper half."""
    rows = vector_images(spark, d).select("image_id", F.posexplode(udfs.median_cut(2)).alias("at", "c"))
    return rows.select("image_id", "at", "c.r")


DOCUMENT = "concat('<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"6\" height=\"5\"><rect x=\"', p_size % 4, '\" y=\"', p_size % 3, '\" width=\"', 1 + p_partkey % 5, '\" height=\"', 1 + p_partkey % 4, '\" fill=\"rgb(', p_partkey % 256, ',', p_size, ',7)\"/></svg>')"
RECT = "x >= p_size % 4 AND x < p_size % 4 + 1 + p_partkey % 5 AND y >= p_size % 3 AND y < p_size % 3 + 1 + p_partkey % 4"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.expr(DOCUMENT).cast("binary").alias("content"))


@query("svg_rects", f"SELECT image_id, 6 AS width, 5 AS height, y, x, CASE WHEN inside THEN image_id % 256 ELSE 0 END AS r, CASE WHEN inside THEN p_size ELSE 0 END AS g, CASE WHEN inside THEN 7 ELSE 0 END AS b, CASE WHEN inside THEN 255 ELSE 0 END AS a FROM (SELECT p_partkey AS image_id, p_size, CAST(i // 6 AS INTEGER) AS y, CAST(i % 6 AS INTEGER) AS x, {RECT} AS inside FROM (SELECT *, i // 6 AS y, i % 6 AS x FROM part, range(0, 30) AS u(i)))")
def svg_rects(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of documents with a rectangle on whole coordinates."""
    return exploded(udfs.decoded(documents(spark, d)))


@query("svg_scaled", f"SELECT image_id, 12 AS width, 10 AS height, y, x, CASE WHEN inside THEN 255 ELSE 0 END AS a FROM (SELECT p_partkey AS image_id, CAST(i // 12 AS INTEGER) AS y, CAST(i % 12 AS INTEGER) AS x, {RECT} AS inside FROM (SELECT * EXCLUDE (y, x), y, x FROM (SELECT *, i // 12 // 2 AS y, i % 12 // 2 AS x FROM part, range(0, 120) AS u(i))))")
def svg_scaled(spark: SparkSession, d: str) -> DataFrame:
    """The same at twice the size, asked for by the width."""
    rows = documents(spark, d).select("image_id", udfs.rasterize_svg("content", width=12).alias("d")).select("image_id", "d.*")
    return exploded(rows).select("image_id", "width", "height", "y", "x", "a")


@query("svg_elements", "SELECT p_partkey AS image_id, 0 AS at, CAST(p_partkey % 256 AS INTEGER) AS r, 1.0::DOUBLE AS opacity, 4 AS points, CAST(p_size % 4 AS DOUBLE) AS left_edge, CAST(p_size % 4 + 1 + p_partkey % 5 AS DOUBLE) AS right_edge FROM part")
def svg_elements(spark: SparkSession, d: str) -> DataFrame:
    """Vector outlines of the same documents, a row an element."""
    rows = documents(spark, d).select("image_id", F.posexplode(udfs.svg_elements("content").getField("elements")).alias("at", "e"))
    points = F.flatten(F.transform("e.subpaths", lambda s: s.points))
    x = F.transform(points, lambda p: p.x)
    return rows.select("image_id", "at", F.col("e.r").alias("r"), F.col("e.opacity").alias("opacity"), F.size(points).alias("points"), F.array_min(x).alias("left_edge"), F.array_max(x).alias("right_edge"))


SIZES = "CASE p_size % 5 WHEN 0 THEN concat('<svg width=\"', w, '\" height=\"', h, 'px\"/>') WHEN 1 THEN concat('<svg viewBox=\"0 0 ', w, ' ', h, '\"/>') WHEN 2 THEN concat('<svg width=\"', w, '\" viewBox=\"1,1,10,20\"/>') WHEN 3 THEN concat('<svg width=\"', w, 'in\" height=\"', h, 'pc\"/>') ELSE '<svg/>' END"
SIDES = "SELECT p_partkey AS image_id, p_size, 1 + p_partkey % 90 AS w, 2 + p_size AS h FROM part"


@query("svg_intrinsic_size", f"SELECT image_id, CAST(CASE p_size % 5 WHEN 3 THEN w * 96 WHEN 4 THEN 300 ELSE w END AS INTEGER) AS width, CAST(CASE p_size % 5 WHEN 2 THEN 2 * w WHEN 3 THEN h * 16 WHEN 4 THEN 150 ELSE h END AS INTEGER) AS height FROM ({SIDES})")
def svg_intrinsic_size(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of documents from their attributes, without pixels."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), "p_size", (1 + F.col("p_partkey") % 90).alias("w"), (2 + F.col("p_size")).alias("h"))
    return rows.select("image_id", udfs.image_info(F.expr(SIZES).cast("binary")).alias("i")).select("image_id", "i.width", "i.height")


INFO_FORMATS = ("png", "jpeg", "gif", "tiff", "webp", "bmp", "qoi", "netpbm")


@query("image_info", f"SELECT p_partkey AS image_id, unnest({list(INFO_FORMATS)}) AS format, CAST(3 + p_size % 6 AS INTEGER) AS width, CAST(2 + p_size % 4 AS INTEGER) AS height FROM part")
def image_info(spark: SparkSession, d: str) -> DataFrame:
    """Format and size of files in every format that is written, from their headers."""
    contents = part_images(spark, d).select("image_id", *[udfs.encode_image(n).getField("content").alias(n) for n in INFO_FORMATS])
    long = contents.unpivot(["image_id"], list(INFO_FORMATS), "name", "content")
    return long.select("image_id", udfs.image_info("content").alias("i")).select("image_id", "i.format", "i.width", "i.height")


def boxed(kind: str, *parts) -> Column:
    """A box as a binary column; parts are hexadecimal text, or columns of it."""
    body = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.concat(F.lpad(F.hex(F.length(body) / 2 + 8), 8, "0"), F.lit(kind.encode().hex().upper()), body)


@query("heif_info", "SELECT p_partkey AS image_id, 'heic' AS format, CAST(CASE WHEN p_size % 2 = 1 THEN 2 + p_size % 7 ELSE 5 + p_partkey % 900 END AS INTEGER) AS width, CAST(CASE WHEN p_size % 2 = 1 THEN 5 + p_partkey % 900 ELSE 2 + p_size % 7 END AS INTEGER) AS height, CAST(p_size % 4 AS INTEGER) AS turns, CAST(p_size % 2 AS INTEGER) AS mirror, 'hvc1' AS item_type, 2::BIGINT AS alpha FROM part")
def heif_info(spark: SparkSession, d: str) -> DataFrame:
    """Containers made box by box, and what is read from their items, properties, associations and references."""
    number = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    k, s = F.col("p_partkey"), F.col("p_size")
    item = lambda n: boxed("infe", f"02000000{n:04X}0000", b"hvc1".hex(), "00")
    ipco = boxed("ipco", boxed("ispe", "00000000", number(5 + k % 900, 8), number(2 + s % 7, 8)), boxed("irot", number(s % 4, 2)), boxed("imir", number(s % 2, 2)), boxed("auxC", "00000000", b"urn:x:alpha\0".hex()))
    ipma = boxed("ipma", "0000000000000002", "0001" + "03" + "818203", "0002" + "01" + "84")
    meta = boxed("meta", "00000000", boxed("pitm", "000000000001"), boxed("iinf", "000000000002", item(1), item(2)), boxed("iref", "00000000", boxed("auxl", "000200010001")), boxed("iprp", ipco, ipma))
    content = F.unhex(F.concat(boxed("ftyp", b"heic".hex(), "00000000", b"mif1".hex()), meta))
    rows = table(spark, d, "part").select(k.alias("image_id"), udfs.image_info(content).alias("i"))
    return rows.select("image_id", *[f"i.{c}" for c in ("format", "width", "height", "turns", "mirror", "item_type", "alpha")])
