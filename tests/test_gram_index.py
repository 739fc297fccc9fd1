"""The index of grams is made and searched part by part; its lists hold what a row of each posting held."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import substrings


def test_a_gram_has_a_list_in_each_part(spark, tmp_path):
    folder, n = str(tmp_path / "i"), 8_000
    rows = spark.range(n).select("id", F.concat(F.lit("Name "), F.col("id")).alias("t")).coalesce(1)
    substrings.write_gram_index(rows, "id", "t", folder)
    index = spark.read.parquet(folder).filter("gram = 'nam'")
    assert 2 <= index.count() <= 4 * substrings.TASK_PARTS
    assert index.select(F.explode("keys")).distinct().count() == n
    assert substrings.search(rows, "id", "t", folder, "name 79").count() == 111


def test_rows_that_share_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red ring"), (1, "small ring"), (2, "bolt")], "id long, t string")
    substrings.write_gram_index(rows, "id", "t", str(tmp_path / "i"))
    got = [r["t"] for r in substrings.search(rows, "id", "t", str(tmp_path / "i"), "ring").collect()]
    assert sorted(got) == ["red ring", "small ring"]


@pytest.mark.parametrize("few", [0, 10_000])
def test_few_and_many_needles(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(substrings, "FEW", few)
    texts = [(f"k{i}", f"{'ab' * (i % 4)}{'cd' * (i % 3)}") for i in range(300)]
    rows = spark.createDataFrame(texts, "id string, t string")
    substrings.write_gram_index(rows, "id", "t", str(tmp_path / "i"))
    needles = ["abab", "bcd", "a", "dcd", "cb", "bab"]
    got = substrings.search_all(rows, "id", "t", str(tmp_path / "i"), spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert sorted((r["needle"], r["id"]) for r in got) == sorted((n, i) for n in needles for i, t in texts if n in t)
