"""Positions, running sums and quantiles in ranges, against lists."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import crud, inference, metrics
from sparkloom.operators.ordering import quantiles, running_sums, with_position


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.0, 1.0, 2.5, rng.random()])) for i in range(400)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(5).cache()


def order(r):
    return (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0.0, r[0])


@pytest.mark.parametrize("side", [2, 4, 32])
def test_positions_and_sums(table, rows, side):
    got = running_sums(table, ["k", "v", "id"], {"place": F.lit(1).cast("long"), "total": "id"}, side).collect()
    want, total = {}, 0
    for n, r in enumerate(sorted(rows, key=order), 1):
        total += r[0]
        want[r[0]] = (n, total)
    assert {r["id"]: (r["place"], r["total"]) for r in got} == want


def test_no_rows_and_one(table):
    assert with_position(table.limit(0), ["id"], "n").count() == 0
    assert [r["n"] for r in with_position(table.filter("id = 3"), ["id"], "n").collect()] == [1]


def test_quantiles(table, rows):
    def want(values, p):
        values = sorted(values)
        at = p * (len(values) - 1)
        low, high = values[int(at)], values[min(len(values) - 1, int(at) + 1)]
        return low + (at - int(at)) * (high - low)

    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    one = quantiles(table, F.col("v"), at).first()
    values = [r[2] for r in rows if r[2] is not None]
    assert [one[n] for n in at] == pytest.approx([want(values, p) for p in at.values()])
    by = {r["k"]: [r[n] for n in at] for r in quantiles(table, F.col("v"), at, ["k"]).collect()}
    assert set(by) == {None, "a", "b", "c"}
    for k, got in by.items():
        assert got == pytest.approx([want([r[2] for r in rows if r[1] == k and r[2] is not None], p) for p in at.values()])
    assert quantiles(table.limit(0), F.col("v"), at).first()["c"] is None
    assert quantiles(table.limit(0), F.col("v"), at, ["k"]).count() == 0


def windows_over_everything(df) -> list[str]:
    """Windows without a partition that read more than the sums of ranges."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [w for w in re.findall(r"Window \[[^\n]*", text) if re.search(r"\], \[[^\]]*ASC[^\]]*\]$", w) and w.count("], [") == 1 and "_range" not in w.rsplit("], [", 1)[1]]


@pytest.mark.parametrize(
    "plan",
    [
        lambda t: crud.delete_by_position(t, ["id"], 3), lambda t: crud.update_by_position(t, ["id"], 3, {"v": F.lit(0.0)}),
        lambda t: metrics.roc_auc(t, (F.col("id") % 2), F.col("v")), lambda t: inference.roc_points(t, (F.col("id") % 2), F.col("v")),
        lambda t: metrics.stratified_fold(t, "k", "id", 5), lambda t: crud.append_with_id(t, t.drop("id"), "id"),
    ],
)
def test_no_task_sorts_everything(table, plan):
    df = plan(table)
    assert windows_over_everything(df) == [] and df.count() > 0


def test_the_check_sees_a_window_over_everything(table):
    from pyspark.sql import Window

    assert windows_over_everything(table.withColumn("n", F.row_number().over(Window.orderBy("id"))))


def test_new_ids_are_stable_and_apart(spark):
    df = spark.createDataFrame([("aaaaaaaa", "x")], "id string, t string")
    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "t string")
    found, _ = crud.insert_validated(df, rows, "id", F.array().cast("array<string>"))
    first, second = ({r["id"] for r in found.collect()} for _ in range(2))
    assert first == second and len(first) == 4
