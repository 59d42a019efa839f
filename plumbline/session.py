"""Session defaults. Values the cluster already sets are left alone."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# AQE re-plans joins and splits skewed partitions at run time; the timezone is
# pinned so that date buckets do not depend on the machine.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cores: str | int = 8, **overrides: str) -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own."""
    conf = {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(cores),
        **overrides,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
