"""A Spark session with the settings that the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "chromalith", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC, adaptive plans and few shuffle partitions; on a cluster the submitted settings win."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.appName(name)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
