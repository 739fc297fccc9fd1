"""Settings of TF-IDF side by side: documents are never broadcast, rare terms beyond the common ones are kept."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import tfidf
from sparkloom.plans import QUERIES


def test_documents_of_configs_are_not_broadcast(spark, tmp_path):
    """Parquet of very few words is small, and so seems every table that is made of it."""
    rows = spark.range(200_000).selectExpr("id as p_partkey", "'large ring' as p_name", "'Brand#7' as p_brand", "'LARGE' as p_type", "1 as p_size", "1.5d as p_retailprice")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = QUERIES["tfidf_configs"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner, (term" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)  # else the planner takes documents
    assert {(r["config"], r["entries"], r["terms"]) for r in found.collect()} == {("plain", 800_000, 4), ("sublinear", 800_000, 4), ("common", 0, 0), ("rare_off", 0, 0)}


@pytest.mark.parametrize("most", [100, 5])
def test_terms_beyond_the_common_ones_are_joined(spark, tmp_path, most):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(6))) for i in range(50)], "id long, text string")
    tf = tfidf.terms(docs, "id", F.split("text", " "), (1,))
    tf.groupBy("term").agg(F.count("*").alias("df")).write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known")).filter("df > 1")
    want = sorted(map(tuple, tf.join(known, "term").select("id", "term", "tf", "df").collect()))
    assert sorted(map(tuple, tfidf.with_known(tf, known, most).select("id", "term", "tf", "df").collect())) == want
