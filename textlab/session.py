"""Session settings the operators are written for.

On a cluster the caller brings the session; these settings are for tests, the
benchmark and local runs. Everything here is a plain Spark setting.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

RECOMMENDED = {
    # AQE sizes reducers, turns joins into broadcasts from measured sizes and
    # splits skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast or hash join only where the measured size of the side allows it.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(name: str = "textlab", cores: int | str = "*", partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """Single-JVM session for tests and the benchmark (no UI, so no extra port)."""
    if partitions is None:
        partitions = os.cpu_count() or 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    builder = builder.config("textlab.partitions", str(partitions))
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
