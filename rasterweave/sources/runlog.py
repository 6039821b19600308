"""Timing logs: text scans, schemas and appenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMINGS = (("RunID", "int"), ("ProcessNum", "int"), ("Backend", "string"), ("Mode", "string"), ("Filter", "string"), ("ThreadNum", "int"), ("ComputeMode", "string"), ("BlockSize", "int"), ("Result", "double"))
QUEUE_TIMINGS = (("COMPUTE_MODE", "string"), ("LOG_TAG", "string"), ("TIME", "double"))
SUMMARY_SCHEMA = "MIX string, COMPUTE_MODE string, LOG_TAG string, mean double, std double"


def _fields(schema: tuple[tuple[str, str], ...]) -> list[F.Column]:
    """Columns out of the array ``parts``; a number that does not parse is null."""
    return [F.expr(f"try_cast(get(parts, {k}) as {kind})").alias(name) for k, (name, kind) in enumerate(schema)]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a number that grows along each file."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))


def parse_timings(lines: DataFrame) -> DataFrame:
    """Whitespace separated run timings; values that are no numbers become null."""
    split = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("RunID")).withColumn("parts", F.split(F.trim("value"), r"\s+"))
    return split.select("line_no", *_fields(TIMINGS))


def parse_queue_timings(lines: DataFrame) -> DataFrame:
    split = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).withColumn("parts", F.split(F.trim("value"), r"\s+"))
    return split.select("line_no", *_fields(QUEUE_TIMINGS))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return parse_timings(_numbered(spark, path))


def read_queue_timings(spark: SparkSession, path: str) -> DataFrame:
    return parse_queue_timings(_numbered(spark, path))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).csv(path, sep="\t", header=True, comment="#")


def append_timings(timings: DataFrame, path: str) -> None:
    """One text line a run, six decimals, in the scan's format."""
    line = F.concat_ws(" ", *[F.format_string("%.6f", F.col(c)) if kind == "double" else F.col(c).cast("string") for c, kind in TIMINGS])
    timings.select(line.alias("value")).write.mode("append").text(path)


def append_queue_timings(timings: DataFrame, path: str) -> None:
    timings.select(F.concat_ws(" ", "COMPUTE_MODE", "LOG_TAG", F.format_string("%.6f", F.col("TIME"))).alias("value")).write.mode("append").text(path)


def append_summary(summary: DataFrame, path: str) -> None:
    rounded = summary.select("MIX", "COMPUTE_MODE", "LOG_TAG", *[F.format_string("%.6f", F.col(c)).alias(c) for c in ("mean", "std")])
    rounded.write.mode("append").csv(path, sep="\t", header=True)
