"""Aggregates of a stream that are kept in a table and carried on after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions


def merged(state: DataFrame | None, batch: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: n, n_values and total of the state and the batch together."""
    number = F.col(value).cast("double")
    own = batch.groupBy(key).agg(F.count("*").alias("n"), F.count(number).alias("n_values"), F.sum(number).alias("total"))
    if state is None:
        return own
    sums = [F.sum(c).alias(c) for c in ("n", "n_values", "total")]
    return state.unionByName(own).groupBy(key).agg(*sums)


def merge_into(base: str, key: str, value: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge a batch into the table at base.

    The number of the batch is in the pointer that switches to the new table, so table and
    number change together, and a batch that comes again after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = versions.current_version(spark, base)
        if last is not None and last.notes.get("batch", -1) >= number:
            return
        state = None if last is None else versions.current(spark, base)
        versions.replace(merged(state, batch, key, value), base, keep=2, notes={"batch": number})

    return merge


def carry_on(stream: DataFrame, base: str, key: str, value: str, checkpoint: str) -> StreamingQuery:
    """Work through all that has arrived since the last run, then stop."""
    writer = stream.writeStream.foreachBatch(merge_into(base, key, value)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def means(table: DataFrame, key: str) -> DataFrame:
    """Per key: rating_count and mean_rating of a carried table."""
    return table.select(key, F.col("n").alias("rating_count"), (F.col("total") / F.nullif(F.col("n_values"), F.lit(0))).alias("mean_rating"))
