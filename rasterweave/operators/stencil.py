"""Neighbourhood filters on rasters, in four physical forms with one result.

``relational``: every source pixel is scattered to the outputs it takes part in and summed by output
pixel: one shuffle with map-side combining, no self join.  ``separable``: rank-one kernels as a
horizontal and a vertical window pass.  ``rowarray``: vertical taps by window, horizontal taps inside
arrays.  ``tile``: row bands with halos in numpy, for production images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions.catalog import MEDIAN_SIZE, Filter, get_filter
from rasterweave.functions.scalars import to_byte, to_byte_truncated
from rasterweave.operators.kernels import filter_band
from rasterweave.sources.raster import CHANNELS, PIXEL_SCHEMA, from_rows, to_rows, with_dimensions

ENGINES = ("auto", "relational", "separable", "rowarray", "tile")
#: How a scaled sum becomes a byte: halves away from zero, or cut off as device kernels do.
FINISH = {"half_away": to_byte, "truncate": to_byte_truncated}


def _resolve(kernel: str | Filter) -> Filter:
    return get_filter(kernel) if isinstance(kernel, str) else kernel


def apply_filter(pixels: DataFrame, kernel: str | Filter, engine: str = "auto", height: int | None = None, width: int | None = None, rounding: str = "half_away") -> DataFrame:
    """Filters a pixel DataFrame; see :mod:`rasterweave.plans.rewrite` for how ``auto`` chooses."""
    from rasterweave.plans.rewrite import choose_engine

    kernel = _resolve(kernel)
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}; there are {', '.join(ENGINES)}")
    if rounding not in FINISH:
        raise ValueError(f"unknown rounding {rounding!r}; there are {', '.join(FINISH)}")
    if kernel.taps is not None and kernel.is_identity():
        return pixels.select("img", "y", "x", *CHANNELS)
    engine = choose_engine(kernel, height, width) if engine == "auto" else engine
    if engine == "tile":
        return filter_tiles(pixels, kernel, height, width, rounding=rounding)
    if kernel.taps is None:
        return median_relational(pixels, kernel.size, height, width)
    if engine == "separable":
        return convolve_separable(pixels, kernel, rounding)
    if engine == "rowarray":
        return convolve_rowarray(pixels, kernel, rounding)
    return convolve_relational(pixels, kernel, height, width, rounding)


def _replicas(at: str, size: str, pad: int, wrap: bool) -> Column:
    """Coordinates in [-pad, size + pad) at which the padded raster shows the value of coordinate ``at``."""
    c, n = F.col(at), F.col(size)
    if wrap:
        turns = F.ceil(F.lit(pad) / n).cast("int")
        every = F.transform(F.sequence(-turns, turns), lambda k: c + k * n)
        return F.filter(every, lambda v: (v >= -pad) & (v < n + pad))
    first = F.when(c == 0, F.lit(-pad)).otherwise(c)
    last = F.when(c == n - 1, n - 1 + pad).otherwise(c)
    return F.sequence(first, last)


def _padded(pixels: DataFrame, pad: int, wrap: bool, height: int | None, width: int | None) -> DataFrame:
    sized = with_dimensions(pixels.select("img", "y", "x", *CHANNELS), height, width)
    tall = sized.withColumn("py", F.explode(_replicas("y", "height", pad, wrap)))
    return tall.withColumn("px", F.explode(_replicas("x", "width", pad, wrap)))


def convolve_relational(pixels: DataFrame, kernel: Filter, height: int | None = None, width: int | None = None, rounding: str = "half_away") -> DataFrame:
    taps = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx"), F.lit(w).alias("w")) for y, x, w in kernel.nonzero()])
    spread = _padded(pixels, kernel.halo, False, height, width).withColumn("t", F.explode(taps))
    aimed = spread.select("img", "height", "width", (F.col("py") - F.col("t.dy")).alias("oy"), (F.col("px") - F.col("t.dx")).alias("ox"), *[(F.col(c) * F.col("t.w")).alias(c) for c in CHANNELS])
    inside = aimed.where((F.col("oy") >= 0) & (F.col("oy") < F.col("height")) & (F.col("ox") >= 0) & (F.col("ox") < F.col("width")))
    summed = inside.groupBy("img", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(*[F.sum(c).alias(c) for c in CHANNELS])
    finish = FINISH[rounding]
    return summed.select("img", "y", "x", *[finish(F.col(c), kernel.factor, kernel.bias).alias(c) for c in CHANNELS])


def median_relational(pixels: DataFrame, size: int = MEDIAN_SIZE, height: int | None = None, width: int | None = None) -> DataFrame:
    """Middle value of the size x size neighbourhood with wrapped edges, by channel.

    Values are bytes, so each window is a histogram: counts by (pixel, offset) never leave a group of
    size**2 rows, and ``percentile_disc`` of an odd count is the middle element.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("a median needs an odd size of one at least")
    p = size // 2
    shifts = F.sequence(F.lit(-p), F.lit(p))
    spread = _padded(pixels, p, True, height, width).withColumn("dy", F.explode(shifts)).withColumn("dx", F.explode(shifts))
    aimed = spread.select("img", "height", "width", (F.col("py") - F.col("dy")).alias("oy"), (F.col("px") - F.col("dx")).alias("ox"), *CHANNELS)
    inside = aimed.where((F.col("oy") >= 0) & (F.col("oy") < F.col("height")) & (F.col("ox") >= 0) & (F.col("ox") < F.col("width")))
    middle = [F.expr(f"percentile_disc(0.5) within group (order by {c})").cast("int").alias(c) for c in CHANNELS]
    return inside.groupBy("img", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(*middle)


def _window_pass(pixels: DataFrame, weights: np.ndarray, group: str, along: str) -> DataFrame:
    """Weighted sum along one axis with clamped edges."""
    order = Window.partitionBy("img", group).orderBy(along)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = len(weights) // 2
    exprs = []
    for c in CHANNELS:
        if p > 2 and len(set(weights.tolist())) == 1:
            frame = order.rowsBetween(-p, p)
            missing_left = F.greatest(F.lit(0), F.lit(p) - F.col(along))
            missing_right = F.lit(2 * p + 1) - F.count(c).over(frame) - missing_left
            total = (F.sum(c).over(frame) + missing_left * F.first(c).over(whole) + missing_right * F.last(c).over(whole)) * int(weights[0])
        else:
            total = F.lit(0)
            for k, w in enumerate(weights.tolist()):
                if not w:
                    continue
                d = k - p
                v = F.col(c) if d == 0 else F.coalesce(F.lag(c, -d).over(order), F.first(c).over(whole)) if d < 0 else F.coalesce(F.lead(c, d).over(order), F.last(c).over(whole))
                total = total + v * w
        exprs.append(total.cast("long").alias(c))
    return pixels.select("img", "y", "x", *exprs)


def convolve_separable(pixels: DataFrame, kernel: Filter, rounding: str = "half_away") -> DataFrame:
    """Two one-dimensional passes and a single rounding; only for kernels of rank one."""
    parts = kernel.separated()
    if parts is None:
        raise ValueError(f"{kernel.code} is not separable")
    across = _window_pass(pixels, parts[1], "y", "x")
    both = _window_pass(across, parts[0], "x", "y")
    return both.select("img", "y", "x", *[FINISH[rounding](F.col(c), kernel.factor, kernel.bias).alias(c) for c in CHANNELS])


def convolve_rowarray(pixels: DataFrame, kernel: Filter, rounding: str = "half_away") -> DataFrame:
    """Neighbour rows by lag/lead, horizontal taps by array functions; no Python worker."""
    rows = to_rows(pixels)
    order = Window.partitionBy("img").orderBy("y")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = kernel.halo
    near = {}
    for d in range(-p, p + 1):
        for c in CHANNELS:
            near[f"{c}_{d + p}"] = F.col(c) if d == 0 else F.coalesce(F.lag(c, -d).over(order), F.first(c).over(whole)) if d < 0 else F.coalesce(F.lead(c, d).over(order), F.last(c).over(whole))
    wide = rows.select("img", "y", F.size("b").alias("width"), *[e.alias(k) for k, e in near.items()])

    def channel(c: str) -> Column:
        def at(x: Column) -> Column:
            total = F.lit(0)
            for dy, dx, w in kernel.nonzero():
                where = F.greatest(F.lit(0), F.least(F.col("width") - 1, x + dx))
                total = total + F.get(F.col(f"{c}_{dy + p}"), where) * w
            return FINISH[rounding](total, kernel.factor, kernel.bias)

        return F.transform(F.sequence(F.lit(0), F.col("width") - 1), at)

    return from_rows(wide.select("img", "y", *[channel(c).alias(c) for c in CHANNELS]))


def to_bands(pixels: DataFrame, rows: int, halo: int, wrap: bool, height: int | None = None, width: int | None = None) -> DataFrame:
    """Sends each pixel to its band and to the bands whose halo shows it; ``py`` is its row there."""
    sized = with_dimensions(pixels.select("img", "y", "x", *CHANNELS), height, width)
    shown = sized.withColumn("py", F.explode(_replicas("y", "height", halo, wrap)))
    last = F.floor((F.col("height") - 1) / rows)
    lowest = F.greatest(F.lit(0), F.floor((F.col("py") - halo) / rows))
    highest = F.least(last, F.floor((F.col("py") + halo) / rows))
    return shown.withColumn("band", F.explode(F.sequence(lowest.cast("int"), highest.cast("int"))))


def filter_tiles(pixels: DataFrame, kernel: str | Filter, height: int | None = None, width: int | None = None, band_rows: int = 64, rounding: str = "half_away") -> DataFrame:
    """The tile engine on pixel rows: one group a band, so a task holds ``band_rows`` rows and halos."""
    kernel = _resolve(kernel)
    bands = to_bands(pixels, band_rows, kernel.halo, kernel.taps is None, height, width)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        img, band = key
        total, wide = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        y0 = int(band) * band_rows
        n = min(band_rows, total - y0)
        block = np.zeros((n + 2 * kernel.halo, wide, 3), dtype=np.uint8)
        block[pdf["py"].to_numpy() - y0 + kernel.halo, pdf["x"].to_numpy()] = pdf[list(CHANNELS)].to_numpy(dtype=np.uint8)
        out = filter_band(block, kernel, n, rounding)
        y, x = np.divmod(np.arange(n * wide), wide)
        flat = out.reshape(-1, 3).astype(np.int32)
        return pd.DataFrame({"img": img, "y": (y + y0).astype(np.int32), "x": x.astype(np.int32), "b": flat[:, 0], "g": flat[:, 1], "r": flat[:, 2]})

    return bands.groupBy("img", "band").applyInPandas(one, PIXEL_SCHEMA)


def filter_bands(bands: DataFrame, kernel: str | Filter, rounding: str = "half_away") -> DataFrame:
    """The tile engine on binary bands (as the ``bmp`` source reads them): no shuffle at all."""
    kernel = _resolve(kernel)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for n, width, halo, data in zip(pdf["n"], pdf["width"], pdf["halo_top"], pdf["data"], strict=True):
                if halo != kernel.halo:
                    raise ValueError(f"{kernel.code} needs a halo of {kernel.halo} rows; the band has {halo}")
                block = np.frombuffer(data, dtype=np.uint8).reshape(n + 2 * halo, width, 3)
                done.append(filter_band(block, kernel, int(n), rounding).tobytes())
            yield pdf.assign(data=done, halo_top=np.int32(0))

    return bands.mapInPandas(each, bands.schema)


def compose(pixels: DataFrame, codes: list[str], engine: str = "auto", height: int | None = None, width: int | None = None) -> DataFrame:
    """Filters one after the other; each pass rounds and clamps, so kernels are never fused."""
    for code in codes:
        pixels = apply_filter(pixels, code, engine, height, width)
    return pixels
