"""Spark sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(
    app: str = "quayside",
    master: str | None = None,
    shuffle_partitions: int = 64,
    driver_memory: str = "6g",
    max_result_size: str = "2g",
    time_zone: str = "America/Sao_Paulo",
) -> SparkSession:
    """A session with adaptive execution, skew joins split, and a fixed time zone; the partition count is only where coalescing starts."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": time_zone,
        "spark.driver.memory": driver_memory,
        "spark.driver.maxResultSize": max_result_size,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
