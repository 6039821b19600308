"""Rasters as DataFrames, and the changes between their layouts.

pixels: ``img, y, x, b, g, r`` (one row a pixel, ints 0-255);
bands:  ``img, band, y0, n, width, height, halo_top, data`` (n rows and their halo, BGR bytes);
rows:   ``img, y, b, g, r`` (arrays along x).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("b", "g", "r")
PIXEL_SCHEMA = "img string, y int, x int, b int, g int, r int"


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """Every (y, x) of a raster, made on the executors."""
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def synthetic(spark: SparkSession, name: str, height: int, width: int, value: Column) -> DataFrame:
    """An image whose three channels are an expression of ``y`` and ``x``."""
    v = F.pmod(value.cast("int"), F.lit(256))
    return grid(spark, height, width).select(F.lit(name).alias("img"), "y", "x", *[v.alias(c) for c in CHANNELS])


def black(spark: SparkSession, side: int) -> DataFrame:
    return synthetic(spark, "black", side, side, F.lit(0))


def checkerboard(spark: SparkSession, side: int, cell: int = 15) -> DataFrame:
    return synthetic(spark, "checker", side, side, F.pmod(F.floor(F.col("y") / cell) + F.floor(F.col("x") / cell), F.lit(2)) * 255)


def lineitem_raster(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """Three ``side`` x ``side`` images (one a return flag) out of the lineitem table; empty cells are 0."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = items.groupBy(
        F.col("l_returnflag").alias("img"),
        (F.col("l_orderkey") % side).cast("int").alias("y"),
        (F.col("l_partkey") % side).cast("int").alias("x"),
    ).agg(
        (F.sum("l_linenumber") % 256).cast("int").alias("b"),
        (F.sum(F.col("l_quantity").cast("bigint")) % 256).cast("int").alias("g"),
        (F.sum("l_suppkey") % 256).cast("int").alias("r"),
    )
    images = cells.select("img").distinct()
    every = images.select("img", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))
    return every.join(cells, ["img", "y", "x"], "left").select("img", "y", "x", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in CHANNELS])


def dimensions(pixels: DataFrame) -> DataFrame:
    """img, height, width."""
    return pixels.groupBy("img").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def with_dimensions(pixels: DataFrame, height: int | None, width: int | None) -> DataFrame:
    """Adds height and width: constants if the caller knows them, else a small join by image."""
    if height and width:
        return pixels.withColumns({"height": F.lit(height), "width": F.lit(width)})
    return pixels.join(dimensions(pixels), "img")


def to_rows(pixels: DataFrame) -> DataFrame:
    """Row arrays; one image row is one value, so a width must fit in memory."""
    gathered = pixels.groupBy("img", "y").agg(F.array_sort(F.collect_list(F.struct("x", *CHANNELS))).alias("p"))
    return gathered.select("img", "y", *[F.col(f"p.{c}").alias(c) for c in CHANNELS])


def from_rows(rows: DataFrame) -> DataFrame:
    zipped = rows.select("img", "y", F.posexplode(F.arrays_zip(*CHANNELS)).alias("x", "p"))
    return zipped.select("img", "y", "x", *[F.col(f"p.{c}").alias(c) for c in CHANNELS])


def transpose(pixels: DataFrame) -> DataFrame:
    """Rows become columns: a projection, no exchange."""
    return pixels.select("img", F.col("x").alias("y"), F.col("y").alias("x"), *CHANNELS)


def region(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """The pixels of a half-open region; the predicate reaches the scan."""
    return pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
