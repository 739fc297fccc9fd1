"""Ranking metrics and the temporal split on hand-computed cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.ranking import eligible_users, ranking_metrics, shared_list_metrics, temporal_split

#: recommendations, relevant items, K, expected by metric
CASES = [
    ([1, 2, 3, 4], [2, 4], 4, {"precision": 0.5, "recall": 1.0}),
    ([2, 9], [2], 1, {"precision": 1.0, "hit": 1.0}),
    ([2, 2], [2], 1, {"precision": 1.0}),
    ([1, 2, 3, 4], [2, 4, 5], 4, {"recall": round(2 / 3, 6)}),
    ([1, 2], [], 2, {"recall": 0.0, "ap": 0.0, "ndcg": 0.0}),
    ([7, 3, 5], [3], 2, {"hit": 1.0}),
    ([7, 3, 5], [5], 2, {"hit": 0.0}),
    ([1, 2, 3], [1, 2], 3, {"ap": 1.0}),
    ([2, 3, 1], [2, 3], 3, {"ndcg": 1.0}),
    ([5, 6, 7], [2, 3], 3, {"ndcg": 0.0}),
]


@pytest.mark.parametrize("recs,relevant,k,expected", CASES)
def test_metrics(spark, recs, relevant, k, expected):
    r = spark.createDataFrame([(1, x, i) for i, x in enumerate(recs, 1)], "user int, item int, rank int")
    g = spark.createDataFrame([(1, x) for x in relevant], "user int, item int")
    got = ranking_metrics(r, g, "user", "item", [k]).first()
    for name, value in expected.items():
        assert got[name] == pytest.approx(value)


def test_no_recommendations(spark):
    r = spark.createDataFrame([], "user int, item int, rank int")
    g = spark.createDataFrame([(1, 2)], "user int, item int")
    got = ranking_metrics(r, g, "user", "item", [3]).first()
    assert (got["users"], got["precision"], got["recall"]) == (1, 0.0, 0.0)


def test_shared_list_is_the_same_as_a_list_for_each_user(spark):
    listed = spark.createDataFrame([(5, 1), (2, 2), (5, 3), (9, 4), (7, 5)], "item int, rank int")
    rows = [(1, 2, True), (1, 9, True), (1, 4, True), (1, 5, None), (2, 8, True), (2, 2, False), (3, 7, True), (4, 5, False)]
    judged = spark.createDataFrame(rows, "user int, item int, good boolean")
    shown = judged.select("user").distinct().crossJoin(listed)
    want = ranking_metrics(shown, judged.filter("good"), "user", "item", [1, 2, 3]).orderBy("k").collect()
    assert shared_list_metrics(listed, judged, F.col("good"), "user", "item", [1, 2, 3]).orderBy("k").collect() == want
    assert [(r["users"], r["hit"]) for r in want] == [(4, 0.0), (4, 0.25), (4, 0.25)]


HISTORY = {
    10: ([4, 5, 9, 1, 2, 3], range(1000, 1006)), 11: ([7, 8, 9, 4, 5, 6], range(2000, 2006)), 12: ([1, 8], range(3000, 3002)),
    13: ([1, 4, 7, 8, 9, 6], range(4000, 4006)), 14: ([2, 3, 5], range(5000, 5003)), 15: ([7], [6000]),
}


def _history(spark):
    rows = [(u, i, t) for u, (items, times) in HISTORY.items() for i, t in zip(items, times, strict=True)]
    return spark.createDataFrame(rows, "user int, item int, ts int")


def test_split_takes_the_newest(spark):
    split = temporal_split(_history(spark), "user", "ts", "item")
    test = {(r["user"], r["item"]) for r in split.filter("is_test").collect()}
    assert test == {(10, 3), (11, 6), (12, 8), (13, 6), (14, 5)}
    last = split.groupBy("user").agg(F.max(F.when(~F.col("is_test"), F.col("ts"))).alias("a"), F.min(F.when(F.col("is_test"), F.col("ts"))).alias("b"))
    assert last.filter("a >= b").count() == 0


def test_split_rounds_half_to_even_and_breaks_ties_by_item(spark):
    rows = spark.createDataFrame([(1, i, 7) for i in range(5)], "user int, item int, ts int")
    chosen = temporal_split(rows, "user", "ts", "item", share=0.5).filter("is_test")
    assert sorted(r["item"] for r in chosen.collect()) == [3, 4]  # round(2.5) is 2


def test_eligible_users(spark):
    found = eligible_users(_history(spark), "user", 3, 2)
    assert found.count() == 2
    assert found.filter("n_train < 3").count() == 0
