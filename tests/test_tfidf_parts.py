"""TF-IDF makes n-grams in tasks of a bounded number of documents, however large a file is."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import tfidf
from sparkloom.operators.ordering import PART_ROWS


def test_documents_of_one_file_are_dealt_out_before_they_become_terms(spark):
    n = 6 * PART_ROWS
    rows = spark.range(n).coalesce(1)
    where = F.array(F.concat(F.lit("task"), F.spark_partition_id().cast("string")))  # the task that makes the terms
    counts = [r["count"] for r in tfidf.terms(rows, "id", where, (1,)).groupBy("term").count().collect()]
    assert sum(counts) == n and len(counts) == 6 and max(counts) < 1.1 * PART_ROWS


def test_documents_are_counted_in_tasks_of_bounded_size(spark):
    docs = spark.range(10).select("id", F.split(F.concat(F.lit("x y z"), F.col("id").cast("string")), " ").alias("words"))
    known = tfidf.vocabulary(docs, "id", F.col("words"), (1,), 2, 1.0)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2  # the terms, and the keys that are counted
    assert {r["term"] for r in known.collect()} == {"x", "y"}
