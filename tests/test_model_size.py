"""What a task of the models reads stays bounded; texts are read once."""

from __future__ import annotations

from sparkloom.operators import models as ML
from sparkloom.operators.ordering import dealt_in_order
from sparkloom.plans.models import _part_features
from sparkloom.plans.registry import QUERIES, Tables


def test_parts_for_a_forest_lie_in_bounded_tasks_in_order(spark):
    rows = spark.range(2_000).coalesce(1)
    parts = dealt_in_order(rows, "id", rows=100).rdd.glom().map(lambda p: [r["id"] for r in p]).collect()
    assert len(parts) == 20 and max(map(len, parts)) < 200 and all(p == sorted(p) for p in parts)


def test_a_small_file_of_parts_is_more_than_one_task(spark, tmp_path):
    spark.range(5_000).selectExpr("id as p_partkey", "'a b' as p_name", "'c' as p_brand", "'d' as p_type", "1 as p_size", "id * 1.5d as p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert _part_features(Tables(spark, str(tmp_path))).rdd.getNumPartitions() == 4


def test_cross_validation_reads_texts_once(spark, monkeypatch):
    seen = []
    plain = ML.cross_validate
    monkeypatch.setattr(ML, "cross_validate", lambda df, *a: (seen.append(df), plain(df, *a))[1])
    QUERIES["ml_cv"](spark, "/root/testdata/sf0.001")
    assert "text" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
