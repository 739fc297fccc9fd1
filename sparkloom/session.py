"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for reproducible timestamps, adaptive plans for partition counts and skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str = "local[*]", name: str = "sparkloom", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
