"""Spark sessions with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "flowframe", **settings: str) -> SparkSession:
    """A session; ``master`` defaults to the environment's, else to all local cores.

    Locally shuffles get twice as many partitions as cores; adaptive execution merges small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master or "MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    cores = os.cpu_count() or 4
    for key, value in {"spark.sql.shuffle.partitions": str(2 * cores), **SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
