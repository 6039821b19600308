"""Equality of images: sizes, pixels, first difference, headers, bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.sources.raster import CHANNELS, dimensions


def pixel_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that differ or that one side lacks: img, y, x, left and right channels."""
    left = a.select("img", "y", "x", *[F.col(c).alias(f"a_{c}") for c in CHANNELS])
    right = b.select("img", "y", "x", *[F.col(c).alias(f"b_{c}") for c in CHANNELS])
    same = F.lit(True)
    for c in CHANNELS:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return left.join(right, ["img", "y", "x"], "full_outer").where(~same)


def first_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first difference of each image in row-major order: img, y, x, diffs."""
    found = pixel_diff(a, b).groupBy("img").agg(F.min(F.struct("y", "x")).alias("at"), F.count("*").alias("diffs"))
    return found.select("img", F.col("at.y").alias("y"), F.col("at.x").alias("x"), "diffs")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """img, status: 0 equal, 1 pixels differ, -1 sizes differ or one side lacks the image."""
    da = dimensions(a).select("img", F.col("height").alias("ha"), F.col("width").alias("wa"))
    db = dimensions(b).select("img", F.col("height").alias("hb"), F.col("width").alias("wb"))
    sized = da.join(db, "img", "full_outer").withColumn("fits", F.col("ha").eqNullSafe(F.col("hb")) & F.col("wa").eqNullSafe(F.col("wb")))
    diffs = pixel_diff(a, b).groupBy("img").agg(F.count("*").alias("diffs"))
    status = F.when(~F.col("fits"), -1).when(F.coalesce("diffs", F.lit(0)) > 0, 1).otherwise(0)
    return sized.join(diffs, "img", "left").select("img", status.cast("int").alias("status"))


def header_diff(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Images (rows of the image layout) whose header or pixels are not the same."""
    left = a.select(key, F.col("header").alias("ha"), F.sha2("data", 256).alias("da"))
    right = b.select(key, F.col("header").alias("hb"), F.sha2("data", 256).alias("db"))
    both = left.join(right, key, "full_outer")
    return both.select(key, F.col("ha").eqNullSafe(F.col("hb")).alias("same_header"), F.col("da").eqNullSafe(F.col("db")).alias("same_pixels"))


def same_bytes(a: DataFrame, b: DataFrame, key: str = "img") -> DataFrame:
    """File equality by digest, so bytes are not shuffled."""
    left = a.select(key, F.sha2("content", 256).alias("a"))
    right = b.select(key, F.sha2("content", 256).alias("b"))
    return left.join(right, key, "full_outer").select(key, F.col("a").eqNullSafe(F.col("b")).alias("same"))
