"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "marketrisk", cpus: str | None = None) -> SparkSession:
    """Local session; on a cluster the caller's own session is used instead."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Longer methods are never compiled by the JVM: operators of long plans are then generated in pieces.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call-site capture costs a Python stack walk per column expression.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
