"""Session settings, and a local session for tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def settings(spark: SparkSession) -> SparkSession:
    """Runtime settings that the operators count on, for any session.

    Times are read in UTC; timestamps are written so that scans can skip row groups by time,
    and lists of terms or grams are pushed into scans value by value; adaptive execution
    splits partitions that a join finds too large.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "100")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("engram")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return settings(spark)
