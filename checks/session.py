"""Spark session for tests, checks and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("leadfit")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        # no call-site capture for each column built: plans here are made of thousands of columns
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
