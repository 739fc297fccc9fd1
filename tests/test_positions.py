"""Rows of a table by their place: found in one range, changed where they stand, judged before."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import crud, ordering


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, rng.choice([None, "a", "b", "c"]), rng.random()) for i in range(300)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, v double").repartition(5).cache()


def placed(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))


@pytest.mark.parametrize("position", [1, 2, 150, 300, 0, 301])
def test_row_at(table, rows, position):
    got = [tuple(r) for r in ordering.row_at(table, ["k", "id"], position).collect()]
    want = placed(rows)[position - 1 : position] if position > 0 else []
    assert got == [(r[1], r[0]) for r in want]


@pytest.mark.parametrize("position", [1, 77, 300, 301])
def test_delete_and_update(table, rows, position):
    order = placed(rows)
    gone = order[position - 1 : position]
    assert {tuple(r) for r in crud.delete_by_position(table, ["k", "id"], position).collect()} == set(rows) - set(gone)
    got = {tuple(r) for r in crud.update_by_position(table, ["k", "id"], position, {"k": F.lit("new"), "v": F.lit(2), "x": F.lit(0)}).collect()}
    assert got == (set(rows) - set(gone)) | {(r[0], "new", 2.0) for r in gone}


def test_changes_are_judged_as_a_whole(table, rows):
    errors = F.filter(F.array(F.when(F.col("v") > 1, "v too large"), F.when(F.col("k") == "", "no k")), lambda e: e.isNotNull())
    hit = placed(rows)[9]
    table_, refused = crud.update_validated(table, ["k", "id"], 10, {"v": F.lit(5.0), "k": F.lit("")}, errors)
    assert {tuple(r) for r in table_.collect()} == set(rows)
    assert [(r["id"], r["k"], r["v"], r["errors"]) for r in refused.collect()] == [(hit[0], "", 5.0, ["v too large", "no k"])]
    table_, refused = crud.update_validated(table, ["k", "id"], 10, {"v": F.lit(0.5)}, errors)
    assert {tuple(r) for r in table_.collect()} == (set(rows) - {hit}) | {(hit[0], hit[1], 0.5)} and refused.count() == 0


def test_the_table_is_not_moved(spark, tmp_path):
    spark.range(1000).withColumn("t", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    df = crud.delete_by_position(spark.read.parquet(str(tmp_path / "t")), ["t", "id"], 4)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan.split("FileScan")[0]  # the table's own branch has no exchange
