"""Many images: a batch, or a rate-limited stream that ends when all files are written."""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterweave.operators.stencil import apply_filter, filter_bands
from rasterweave.plans.config import RunConfig
from rasterweave.functions.catalog import get_filter
from rasterweave.sources import bmp

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def filter_images(images: DataFrame, codes: list[str], folder: str = "") -> DataFrame:
    """img (path below the folder), content: whole images (small ones) through one or more filters, each in its own task."""
    kernels = [get_filter(c) for c in codes]
    bands = images.where("data is not null").select(bmp.below(F.col("path"), folder).alias("img"), F.lit(0).alias("band"), F.lit(0).alias("y0"), F.col("height").alias("n"), "width", "height", F.lit(0).alias("halo_top"), "data")
    for kernel in kernels:
        bands = filter_bands(_with_halo(bands, kernel.halo, kernel.taps is None), kernel)
    return bmp.bands_to_image(bands)


def _with_halo(bands: DataFrame, halo: int, wrap: bool) -> DataFrame:
    """Adds halo rows to bands that are whole images, with binary functions only."""
    line = F.col("width") * 3

    def row(index: F.Column) -> F.Column:
        at = F.pmod(index, F.col("height")) if wrap else F.greatest(F.lit(0), F.least(F.col("height") - 1, index))
        return F.substr("data", at * line + 1, line)

    above = [row(F.lit(k)) for k in range(-halo, 0)]
    below = [row(F.col("height") + k) for k in range(halo)]
    return bands.withColumns({"data": F.concat(*above, F.col("data"), *below), "halo_top": F.lit(halo)})


def run_stream(spark: SparkSession, folder: str, codes: list[str], out: str, checkpoint: str, max_files: int | None = None, max_bytes: str | None = None, output: str | None = None) -> StreamingQuery:
    """Reads what the folder holds in micro-batches bounded by count or bytes, filters, writes, ends.

    A batch that is run again writes the same files again under the same names.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.bmp").option("recursiveFileLookup", "true")
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        stream = stream.option("maxBytesPerTrigger", max_bytes)
    bmp.register(spark)

    def sink(batch: DataFrame, epoch: int) -> None:
        done = filter_images(bmp.decode_files(batch, "DROPMALFORMED"), codes, folder)
        named = done.withColumn("img", bmp.prefixed(F.col("img"), bmp.output_name("", "queue", output)))
        bmp.write_images(named, out)

    return stream.load(folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark: SparkSession, config: RunConfig, folder: str, out: str, log_path: str | None = None) -> float:
    """One run of a configuration; seconds taken, also appended to the log if it asks for one."""
    from rasterweave.sources import runlog

    began = time.monotonic()
    codes = list(config.passes) or [config.filter]
    if config.exec_mode == "queue":
        images = bmp.read_images(spark, [os.path.join(folder, f) for f in config.files], "FAILFAST")
        named = filter_images(images, codes, folder).withColumn("img", bmp.prefixed(F.col("img"), bmp.output_name("", "queue", config.output)))
    else:
        path = os.path.join(folder, config.files[0])
        for k, code in enumerate(codes):  # between passes an image is a file again, so that the next one reads bands with halos
            kernel = get_filter(code)
            bands = bmp.read_bands(spark, path, config.block, kernel.halo, kernel.taps is None)
            image = bmp.bands_to_image(filter_bands(bands, kernel, "truncate" if config.backend == "GPU" else "half_away"))
            if k + 1 < len(codes):
                bmp.register(spark)
                bmp.write_images(image.withColumn("img", F.lit(f"pass_{k}.bmp")), os.path.join(out, ".passes"))
                path = os.path.join(out, ".passes", f"pass_{k}.bmp")
        how = "mpi" if config.exec_mode == "mpi" else "gpu" if config.backend == "GPU" else "threads" if config.threads > 1 else "sequential"
        named = image.withColumn("img", bmp.prefixed(F.lit(config.files[0]), bmp.output_name("", how)) if not config.output else F.lit(config.output))
    bmp.register(spark)
    bmp.write_images(named, out)
    shutil.rmtree(os.path.join(out, ".passes"), ignore_errors=True)
    took = time.monotonic() - began
    if config.log and log_path:
        row = [(0, 1, config.backend, config.exec_mode, config.filter, config.threads, config.compute_mode, config.block, took)]
        runlog.append_timings(spark.createDataFrame(row, ", ".join(f"{n} {k}" for n, k in runlog.TIMINGS)), log_path)
    return took


def filter_pixel_batches(pixels: DataFrame, code: str, engine: str = "auto") -> DataFrame:
    """The same filter for rasters that are already tables."""
    return apply_filter(pixels, code, engine)
