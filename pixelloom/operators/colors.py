"""Colours and aggregates over pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import png

#: 16.16 factors of the inverse colour transform of JPEG.
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB, HALF = 91881, 22554, 46802, 116131, 32768


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")


def histogram(pixels: DataFrame) -> DataFrame:
    """Count of every colour of pixels that are at least half opaque; summed before the shuffle."""
    return pixels.filter("a >= 128").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def palette(pixels: DataFrame) -> DataFrame:
    """Index of each colour in the image's sorted palette."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("r", "g", "b")) - 1
    return histogram(pixels).select("image_id", "r", "g", "b", rank.cast("int").alias("idx"))


def indexed(pixels: DataFrame) -> DataFrame:
    """Index of each pixel's colour in the image's palette, for pixels that are at least half opaque: colours are numbered where the image's pixels are sorted, without a join.
    Pixels without an image_id or a colour have no row."""
    rank = F.dense_rank().over(Window.partitionBy("image_id").orderBy("r", "g", "b")) - 1
    return pixels.filter("a >= 128").withColumn("idx", rank.cast("int")).dropna(subset=["image_id", "r", "g", "b"]).select("image_id", "y", "x", "idx")


def alpha_flags(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.bool_and(F.col("a") == 0).alias("all_clear"), F.bool_or(F.col("a") < 128).alias("any_clear"), F.bool_and(F.col("a") == 255).alias("opaque"))


def source_over(pixels: DataFrame, top: dict[str, Column]) -> DataFrame:
    """pixels under a layer whose channels are computed per pixel; straight alpha."""
    alpha, under = top["a"] / F.lit(255.0), F.col("a") / F.lit(255.0)
    out = alpha + under * (1 - alpha)
    blend = lambda c: F.when(out <= 0, 0).otherwise(F.floor((top[c] * alpha + F.col(c) * under * (1 - alpha)) / out + 0.5)).cast("int")
    return pixels.select("image_id", "y", "x", *[blend(c).alias(c) for c in "rgb"], F.floor(out * 255 + 0.5).cast("int").alias("a"))


def to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)
    cb = F.floor(-0.168736 * r - 0.331264 * g + 0.5 * b + 128 + 0.5)
    cr = F.floor(0.5 * r - 0.418688 * g - 0.081312 * b + 128 + 0.5)
    return tuple(clamped(c) for c in (y, cb, cr))


def from_ycbcr(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    u, v = (cb - 128).cast("int"), (cr - 128).cast("int")
    r = y + F.shiftright(v * RED_CR + HALF, 16)
    g = y - F.shiftright(u * GREEN_CB + v * GREEN_CR + HALF, 16)
    b = y + F.shiftright(u * BLUE_CB + HALF, 16)
    return clamped(r), clamped(g), clamped(b)


def delta_decode(pixels: DataFrame, channel: str) -> DataFrame:
    """Running sums modulo 256 along each row: the inverse of a horizontal predictor."""
    total = F.sum(channel).over(Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return pixels.select("image_id", "y", "x", (total % 256).cast("int").alias("value"))


def runs(pixels: DataFrame) -> DataFrame:
    """Runs of equal pixels in scan order: start place and length."""
    scan = Window.partitionBy("image_id").orderBy("y", "x")
    color = F.struct("r", "g", "b", "a")
    marked = pixels.withColumn("new", (~F.lag(color).over(scan).eqNullSafe(color)).cast("int")).withColumn("run", F.sum("new").over(scan))
    return marked.groupBy("image_id", "run").agg(F.count("*").alias("length"), F.min(F.col("y") * F.col("width") + F.col("x")).alias("start")).select("image_id", F.col("start").cast("int").alias("start"), "length")


def filter_choice(images: DataFrame) -> DataFrame:
    """The PNG filter type of each row of packed images, and its score; images are handled whole, without a shuffle."""

    @F.pandas_udf("array<struct<filter: int, score: long>>")
    def choose(width: pd.Series, height: pd.Series, r: pd.Series, g: pd.Series, b: pd.Series, a: pd.Series) -> pd.Series:
        out = []
        for w, h, *cells in zip(width, height, r, g, b, a, strict=True):
            best, score = png.row_filters(np.stack([np.asarray(c, np.uint8) for c in cells], axis=1).reshape(h, w, 4))[1:]
            out.append([{"filter": int(k), "score": int(s)} for k, s in zip(best, score, strict=True)])
        return pd.Series(out)

    rows = images.select("image_id", F.posexplode(choose("width", "height", "r", "g", "b", "a")).alias("y", "f"))
    return rows.select("image_id", "y", "f.filter", "f.score")


def channel_error(left: DataFrame, right: DataFrame) -> DataFrame:
    """Largest difference of any channel of packed images of the same id and size. Both sides are sorted, as Spark takes packed images for smaller than they are and would broadcast them."""
    other = right.select("image_id", *[F.col(c).alias(f"{c}2") for c in "rgba"]).hint("merge")
    worst = F.greatest(*[F.array_max(F.zip_with(c, f"{c}2", lambda x, y: F.abs(x - y))) for c in "rgba"])
    return left.join(other, "image_id").select("image_id", worst.cast("int").alias("error"))


def merge_alpha(images: DataFrame, alphas: DataFrame) -> DataFrame:
    """Packed images whose alpha is the red of the alpha image of their id, if there is one of equal size."""
    other = alphas.select("image_id", F.col("width").alias("aw"), F.col("height").alias("ah"), F.col("r").alias("alpha"))
    fits = (F.col("aw") == F.col("width")) & (F.col("ah") == F.col("height"))
    return images.join(other, "image_id", "left").withColumn("a", F.when(fits, F.col("alpha")).otherwise(F.col("a"))).drop("aw", "ah", "alpha")
