"""Two tables of weights are compared in parts of a bounded number of entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import tfidf
from sparkloom.operators.ordering import LEAST_ROWS

SHAPE = "id long, term string, weight double"


def compared(spark, a, b) -> tuple[int, float]:
    row = tfidf.largest_difference(spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE), "id").first()
    return row["entries"], row["largest"]


def test_entries_of_either_table_are_compared(spark):
    rows = [(1, "a", 0.6), (1, "b", 0.8), (2, "a", 1.0)]
    assert compared(spark, rows, rows) == (3, 0.0)
    assert compared(spark, rows, [(1, "a", 0.5), (1, "b", 0.8), (3, "c", 0.25)]) == (4, 1.0)  # 2 is in one table only
    assert compared(spark, rows, rows[:2] + [(2, "a", 0.75)]) == (3, 0.25)
    assert compared(spark, rows + rows[:1], rows) == (4, 0.6)  # what a table repeats is seen
    assert compared(spark, [], []) == (0, 0.0)


def test_null_keys_are_equal(spark):
    rows = [(None, "a", 0.6), (None, "b", 0.8), (2, "a", 1.0)]
    assert compared(spark, rows, rows) == (3, 0.0)


def test_parts_hold_a_bounded_number_of_entries(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "KEY_ROWS", LEAST_ROWS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a = spark.range(8 * LEAST_ROWS).select("id", F.lit("x").alias("term"), F.lit(1.0).alias("weight"))
        met = tfidf.largest_difference(a, a, "id")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert met.first()["entries"] == 8 * LEAST_ROWS
        assert ", 8), REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
