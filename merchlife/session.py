"""Session settings the jobs rely on, for sessions that are made here."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

UTC_NAMES = ("UTC", "Etc/UTC", "Etc/UCT", "UCT", "Etc/Universal", "Universal", "Zulu", "Etc/Zulu", "GMT", "Etc/GMT", "Z", "+00:00")


def builder(app: str = "merchlife") -> SparkSession.Builder:
    """Adaptive execution sizes the shuffles, splits skewed join partitions and turns
    joins with a small measured side into broadcasts."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )


def check_session(spark: SparkSession) -> None:
    """Months of timestamps follow the session's zone, and overflow raises in ANSI mode only."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")
    if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise ValueError("spark.sql.ansi.enabled must be true")


def local_session(cpus: int | None = None) -> SparkSession:
    """For tests and the bench; a cluster brings its own master and partition count."""
    cpus = cpus or min(8, os.cpu_count() or 1)
    spark = (
        builder()
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
