"""How work is split: tiles by mode and block, even bands with remainder, halos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.scalars import COMPUTE_MODES


def tiles(spark: SparkSession, height: int, width: int, mode: str = "by_row", block: int = 1) -> DataFrame:
    """Half-open regions that cover the image once: mode, tile, y0, y1, x0, x1."""
    if mode not in COMPUTE_MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(COMPUTE_MODES)}")
    if block < 1 or height < 1 or width < 1:
        raise ValueError("sizes and blocks are positive")
    block = 1 if mode == "by_pixel" else block
    tall = height if mode == "by_column" else block
    wide = width if mode == "by_row" else block
    across = -(-width // wide)
    down = -(-height // tall)
    t = F.col("id").cast("int")
    y0 = (F.floor(t / across) * tall).cast("int")
    x0 = ((t % across) * wide).cast("int")
    return spark.range(down * across).select(F.lit(mode).alias("mode"), t.alias("tile"), y0.alias("y0"), F.least(y0 + tall, F.lit(height)).cast("int").alias("y1"), x0.alias("x0"), F.least(x0 + wide, F.lit(width)).cast("int").alias("x1"))


def band_plan(spark: SparkSession, extent: int, ranks: int, halo: int) -> DataFrame:
    """rank, start, num, send_start, send_num: equal shares, the first ones take the remainder; halos are cut at the edges."""
    share, rest = divmod(extent, ranks)
    rank = F.col("id").cast("int")
    start = rank * share + F.least(rank, F.lit(rest))
    num = F.lit(share) + F.when(rank < rest, 1).otherwise(0)
    lo = F.greatest(F.lit(0), start - halo)
    hi = F.least(F.lit(extent), start + num + halo)
    empty: Column = num == 0
    return spark.range(ranks).select(rank.alias("rank"), start.cast("int").alias("start"), num.cast("int").alias("num"), F.when(empty, start).otherwise(lo).cast("int").alias("send_start"), F.when(empty, 0).otherwise(hi - lo).cast("int").alias("send_num"))


def round_up(extent: Column, block: int) -> Column:
    """The next multiple of a block, as device work sizes need."""
    return (F.ceil(extent / block) * block).cast("int")


def tile_of(pixels: DataFrame, mode: str, block: int, width: int) -> DataFrame:
    """Adds the tile of each pixel; a projection, so a shuffle by tile is the caller's choice."""
    y, x = F.floor(F.col("y") / block), F.floor(F.col("x") / block)
    tile = {"by_row": y, "by_column": x, "by_grid": y * (-(-width // block)) + x, "by_pixel": F.col("y") * width + F.col("x")}[mode]
    return pixels.withColumn("tile", tile.cast("int"))
