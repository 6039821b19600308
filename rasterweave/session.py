"""Session defaults for local use; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(cores: int | None = None, **conf: str) -> SparkSession:
    """A session on ``local[cores]`` unless one is active or a master is configured."""
    builder = SparkSession.builder.appName("rasterweave")
    if "SPARK_MASTER_URL" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cores or os.cpu_count()}]")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
