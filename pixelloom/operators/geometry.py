"""Geometry of images.

On the exploded view a rotation or a mirror is a projection and a crop is a filter. Resizing reads taps from the packed
arrays, so each target pixel is a row made where its image is, without a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import CHANNELS


def here() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("width", "height", "x", "y"))


#: EXIF orientations as a turn, then a mirror axis.
ORIENTATIONS = {1: (0, None), 2: (0, "horizontal"), 3: (180, None), 4: (0, "vertical"), 5: (90, "horizontal"), 6: (90, None), 7: (90, "vertical"), 8: (270, None)}


def fill(images: DataFrame, color: tuple[int, int, int, int]) -> DataFrame:
    """Pixel rows of one colour for image_id, width, height."""
    W, H, _, _ = here()
    row = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), W * H - 1)).alias("i"))
    return row.select("image_id", "width", "height", F.floor(F.col("i") / W).cast("int").alias("y"), (F.col("i") % W).cast("int").alias("x"), *[F.lit(v).alias(c) for c, v in zip(CHANNELS, color, strict=True)])


def placed(pixels: DataFrame, x: Column, y: Column, swapped: bool = False, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """pixels at new places, all of them computed from the old ones."""
    W, H, _, _ = here()
    size = ((H, W) if swapped else (W, H)) if width is None else (width, height)
    return pixels.select("image_id", size[0].cast("int").alias("width"), size[1].cast("int").alias("height"), y.cast("int").alias("y"), x.cast("int").alias("x"), *CHANNELS)


def rotate(pixels: DataFrame, degrees: int) -> DataFrame:
    if degrees % 360 == 0:
        return pixels
    W, H, X, Y = here()
    way = {90: (H - 1 - Y, X, True), 180: (W - 1 - X, H - 1 - Y, False), 270: (Y, W - 1 - X, True)}
    return placed(pixels, *way[degrees % 360])


def mirror(pixels: DataFrame, axis: str) -> DataFrame:
    W, H, X, Y = here()
    return placed(pixels, W - 1 - X, Y) if axis == "horizontal" else placed(pixels, X, H - 1 - Y)


def orient(pixels: DataFrame, orientation: int) -> DataFrame:
    degrees, axis = ORIENTATIONS.get(orientation, (0, None))
    turned = rotate(pixels, degrees)
    return mirror(turned, axis) if axis else turned


def heif_orient(pixels: DataFrame, quarter_turns: int, axis: int | None) -> DataFrame:
    """Turns against the clock, then a mirror: 0 swaps left and right, 1 top and bottom."""
    turned = rotate(pixels, -90 * quarter_turns)
    return turned if axis is None else mirror(turned, "vertical" if axis else "horizontal")


def clean_aperture(pixels: DataFrame, width: tuple[Column, int], height: tuple[Column, int], right: tuple[int, int], down: tuple[int, int]) -> DataFrame:
    """The middle part of each image, of width and height as fractions (numerator, denominator), moved right and down by fractions and kept inside; all of an image that isn't larger than it."""
    W, H, _, _ = here()
    w, h = (F.floor(n / d).cast("int") for n, d in (width, height))
    fits = (w > 0) & (h > 0) & (w <= W) & (h <= H)
    w, h = F.when(fits, w).otherwise(W), F.when(fits, h).otherwise(H)

    def start(free: Column, shift: tuple[int, int]) -> Column:
        n, d = shift[0], max(shift[1], 1)
        doubled = (free * d + 2 * n) / (2 * d)
        at = F.greatest(F.lit(0), F.least(free, F.when(doubled < 0, F.ceil(doubled)).otherwise(F.floor(doubled)).cast("int")))
        return F.when(fits, at).otherwise(0)

    return crop(pixels, start(W - w, right), start(H - h, down), w, h)


def crop(pixels: DataFrame, x: Column | int, y: Column | int, width: Column | int, height: Column | int) -> DataFrame:
    """The region's pixels; images that don't hold the whole region have no rows (crop_errors says why)."""
    W, H, X, Y = here()
    x, y, width, height = (F.lit(v) if isinstance(v, int) else v for v in (x, y, width, height))
    inside = (width > 0) & (height > 0) & (x >= 0) & (y >= 0) & (x + width <= W) & (y + height <= H) & X.between(x, x + width - 1) & Y.between(y, y + height - 1)
    return placed(pixels.filter(inside), X - x, Y - y, width=width, height=height)


def crop_errors(images: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """image_id and the error code, or null, of cropping each image."""
    W, H, _, _ = here()
    bad = F.when((F.lit(width) <= 0) | (F.lit(height) <= 0), "invalidDimensions").when((F.lit(x) < 0) | (F.lit(y) < 0) | (F.lit(x) > W - width) | (F.lit(y) > H - height), "regionOutOfBounds")
    return images.select("image_id", bad.alias("error"))


def crop_center_half(pixels: DataFrame) -> DataFrame:
    W, H, _, _ = here()
    half = lambda d: F.greatest(F.lit(1), F.floor(d / 2)).cast("int")
    start = lambda d: F.floor((d - half(d)) / 2).cast("int")
    return crop(pixels, start(W), start(H), half(W), half(H))


def scaled_dims(images: DataFrame, factor: float) -> DataFrame:
    """image_id and the dimensions scaled, at least 1; an error for a factor that isn't positive and finite."""
    W, H, _, _ = here()
    if not 0 < factor < float("inf"):
        return images.select("image_id", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit("invalidDimensions").alias("error"))
    new = lambda d: F.greatest(F.lit(1), F.floor(d * F.lit(float(factor)) + 0.5)).cast("int")
    return images.select("image_id", new(W).alias("width"), new(H).alias("height"), F.lit(None).cast("string").alias("error"))


def targets(images: DataFrame, width: int, height: int) -> DataFrame:
    """A row a target pixel (ty, tx), with the packed source."""
    row = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))))
    return row.withColumn("ty", F.floor(F.col("i") / width).cast("int")).withColumn("tx", (F.col("i") % width).cast("int"))


def resized(images: DataFrame, width: int, height: int, value: Callable[[str], Column], taps: dict[str, Column]) -> DataFrame:
    row = targets(images, width, height).select("*", *[c.alias(k) for k, c in taps.items()])
    return row.select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.col("ty").alias("y"), F.col("tx").alias("x"), *[value(c).cast("int").alias(c) for c in CHANNELS])


def resize_nearest(images: DataFrame, width: int, height: int) -> DataFrame:
    W, H, _, _ = here()
    source = lambda t, n, d: F.least(d - 1, F.floor((F.col(t) + 0.5) * d / n)).cast("int")
    at = source("ty", height, H) * W + source("tx", width, W)
    return resized(images, width, height, lambda c: F.get(c, F.col("at")), {"at": at})


def resize_bilinear(images: DataFrame, width: int, height: int) -> DataFrame:
    """Centres are mapped and clamped, rows are blended before columns, and each channel is rounded half up on its own."""
    W, H, _, _ = here()

    def axis(t: str, n: int, d: Column) -> tuple[Column, Column, Column]:
        center = F.greatest(F.lit(0.0), F.least((d - 1).cast("double"), (F.col(t) + 0.5) * (d.cast("double") / n) - 0.5))
        low = F.floor(center).cast("int")
        return low, F.least(low + 1, d - 1).cast("int"), center - low

    x0, x1, fx = axis("tx", width, W)
    y0, y1, fy = axis("ty", height, H)

    def value(c: str) -> Column:
        tap = lambda y, x: F.get(c, F.col(y) * W + F.col(x)).cast("double")
        row = lambda y: tap(y, "x0") + (tap(y, "x1") - tap(y, "x0")) * F.col("fx")
        return F.floor(row("y0") + (row("y1") - row("y0")) * F.col("fy") + 0.5)

    return resized(images, width, height, value, {"x0": x0, "x1": x1, "fx": fx, "y0": y0, "y1": y1, "fy": fy})


def grid_stitch(pixels: DataFrame, columns: int, rows: int, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Groups of columns * rows images of one size, by image_id, as one image each: tiles are placed row by row, all in one projection, and cropped to the output size if one is given."""
    W, H, X, Y = here()
    tiles = columns * rows
    grid, tile = F.floor(F.col("image_id") / tiles), F.col("image_id") % tiles
    out_w, out_h = W * columns if width is None else width, H * rows if height is None else height
    y, x = Y + F.floor(tile / columns) * H, X + (tile % columns) * W
    return pixels.filter((x < out_w) & (y < out_h)).select(grid.cast("long").alias("image_id"), out_w.cast("int").alias("width"), out_h.cast("int").alias("height"), y.cast("int").alias("y"), x.cast("int").alias("x"), *CHANNELS)


def probe(images: DataFrame, points: DataFrame) -> DataFrame:
    """points (image_id, x, y) with the pixel there, or nulls outside; read from the packed arrays."""
    X, Y = F.col("x"), F.col("y")
    inside = (X >= 0) & (Y >= 0) & (X < F.col("width")) & (Y < F.col("height"))
    return images.join(points, "image_id").select("image_id", "x", "y", *[F.when(inside, F.get(c, Y * F.col("width") + X)).alias(c) for c in CHANNELS])


def write_point(images: DataFrame, x: Column, y: Column, color: tuple[int, int, int, int]) -> DataFrame:
    """Packed images with one pixel of a new colour; images that the point is outside of have no row."""
    at = (y * F.col("width") + x).cast("int")
    inside = images.filter((x >= 0) & (y >= 0) & (x < F.col("width")) & (y < F.col("height")))

    def changed(channel: str, new: int) -> Column:
        return F.transform(channel, lambda v, i: F.when(i == at, F.lit(new)).otherwise(v))

    return inside.withColumns({c: changed(c, new) for c, new in zip(CHANNELS, color, strict=True)})


def has_edits(images: DataFrame, originals: DataFrame) -> DataFrame:
    """image_id and whether the packed image differs from the original of its id. Both sides are sorted, as Spark takes packed images for smaller than they are and would broadcast them."""
    parts = ("width", "height", *CHANNELS)
    joined = images.join(originals.select("image_id", *[F.col(c).alias(f"was_{c}") for c in parts]).hint("merge"), "image_id")
    same = F.lit(True)
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return joined.select("image_id", (~same).alias("edited"))
