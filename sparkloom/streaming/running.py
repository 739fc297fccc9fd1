"""Structured Streaming: counts and means that run along with what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: rating_count and mean_rating so far. State is one row for each key."""
    return stream.groupBy(key).agg(F.count("*").alias("rating_count"), F.avg(F.col(value).cast("double")).alias("mean_rating"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per key and window of time its rows; state is dropped once rows would be too late."""
    timely = stream.withWatermark(time, late)
    return timely.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
