"""A session with the settings this engine is tuned for. On a cluster pass its own master and memory."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    """``partitions``: about two per core of the cluster, so that one fits an executor's memory; AQE merges small ones."""
    builder = SparkSession.builder.master(master).appName("stacklore")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
