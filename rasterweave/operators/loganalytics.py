"""Grouped statistics of timing logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions.catalog import FILTERS
from rasterweave.functions.scalars import ci95_half_width


def clean(timings: DataFrame, numeric: list[str], required: list[str] | None = None) -> DataFrame:
    """Numbers that do not parse become null; rows without the required columns go."""
    cast = timings.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numeric})
    return cast.dropna("any", subset=required or numeric)


def label_single_thread(timings: DataFrame) -> DataFrame:
    """Runs of one thread have neither mode nor block."""
    single = F.col("ThreadNum") == 1
    return timings.withColumns({"ComputeMode": F.when(single, "single_thread").otherwise(F.col("ComputeMode")), "BlockSize": F.when(single, 0).otherwise(F.col("BlockSize"))})


def mean_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))


def mean_std_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation; the deviation of one value is 0."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def ci95_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), ci95_half_width(F.col(value)).alias("ci95"))


def summary_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, max, mean, population deviation, nearest-rank 95th percentile."""
    p95 = F.expr(f"percentile_disc(0.95) within group (order by `{value}`)")
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p95.alias("p95"))


def reindex(df: DataFrame, domain: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """Every key of the domain, missing values filled."""
    values = [c for c in df.columns if c not in keys]
    return domain.join(df, keys, "left").select(*keys, *[F.coalesce(c, F.lit(fill)).alias(c) for c in values])


def label_map(code: Column, labels: dict[str, str] | None = None) -> Column:
    """Code to display name by a literal map; unknown codes stay as they are."""
    labels = labels or {k: f.name for k, f in FILTERS.items()}
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def consecutive_pairs(df: DataFrame, partition: list[str], order: str, code: str, value: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Neighbouring rows whose codes form an allowed pair, with the sum of both values."""
    w = Window.partitionBy(*partition).orderBy(order)
    paired = df.select(*partition, order, F.col(code).alias("first"), F.lead(code).over(w).alias("second"), (F.col(value) + F.lead(value).over(w)).alias("total"))
    wanted = F.lit(False)
    for a, b in allowed:
        wanted = wanted | ((F.col("first") == a) & (F.col("second") == b))
    return paired.where(wanted)


def first_appearance(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Groups in the order in which they first appear."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_at")).orderBy("first_at")


def first_value(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))
