"""Data quality, statistics and cleaning on small frames."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.numeric import clamp, corrected_kurtosis, corrected_skewness, on_grid
from sparkloom.functions.validate import POWER_RANGES, errors, is_email, is_phone, number_error
from sparkloom.operators import quality as Q
from sparkloom.operators import stats as S

RATINGS = [(10, 1, 4.5), (10, 1, 4.0), (11, 2, 3.0), (12, 3, 5.0), (12, 4, 2.5), (13, 1, 1.0)]


@pytest.fixture
def ratings(spark):
    return spark.createDataFrame(RATINGS, "user int, movie int, rating double")


def test_popularity(ratings):
    got = {r["movie"]: (r["rating_count"], r["mean_rating"]) for r in S.popularity(ratings, "movie", "rating").collect()}
    assert got[1] == (3, pytest.approx(9.5 / 3))


def test_popularity_leaves_null_keys_out(spark):
    rows = spark.createDataFrame([(None, 1.0), (1, 2.0)], "k int, v double")
    assert S.popularity(rows, "k", "v").count() == 1


def test_duplicates(ratings):
    assert [tuple(r) for r in Q.duplicate_keys(ratings, ["user", "movie"]).collect()] == [(10, 1, 1)]
    assert Q.flag_duplicates(ratings, ["user", "movie"]).filter("is_duplicate").count() == 2


def test_orphans_count_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    got = Q.orphans(child, parent, "k", "k", "x").first()
    assert (got["child_rows"], got["orphans"], got["pct"]) == (3, 2, 66.6667)


def test_missing_counts_nan(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert Q.missing_report(rows).first()["missing"] == 2


def test_grid(spark):
    rows = spark.createDataFrame([(0.5,), (4.0,), (3.3,), (6.0,)], "r double")
    got = Q.grid_check(rows, "r", 0.5, 5.0, 0.5).first()
    assert tuple(got) == (4, 1, 1, 2)
    assert rows.filter(on_grid(F.col("r"), 0.5, 0.5)).count() == 3


def test_moments_of_a_small_sample(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    got = rows.agg(corrected_skewness(F.col("v")).alias("s"), corrected_kurtosis(F.col("v")).alias("k")).first()
    assert got["s"] == pytest.approx(1.76363, abs=1e-5)
    assert got["k"] == pytest.approx(3.228, abs=1e-3)


def test_clamp_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (-1.0,), (5.0,), (99.0,)], "v double")
    assert [r[0] for r in rows.select(clamp(F.col("v"), 0.0, 10.0)).collect()] == [None, 0.0, 5.0, 10.0]


def test_rules_apply_in_order(spark):
    rows = spark.createDataFrame([(1, None), (2, 700.0), (3, 5.0), (4, 5.0)], "id int, v double")
    rules = [("null", F.col("v").isNull()), ("high", F.col("v") > 100)]
    judged = Q.first_failing_rule(rows, rules, ["v"], [F.col("id")])
    log = [tuple(r) for r in Q.rule_log(judged, ["null", "high"]).orderBy("step").collect()]
    assert log == [(1, "null", 1, 3), (2, "high", 1, 2), (3, "duplicate", 1, 1)]


def test_summary_of_one_value(spark):
    got = S.summary(spark.createDataFrame([(3.0,)], "v double"), "v").first()
    assert (got["n"], got["std"], got["median"]) == (1, 0.0, 3.0)


def test_histogram_last_bin_is_closed(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    got = {r["bin"]: r["n"] for r in S.histogram(rows, "v", 10).collect()}
    assert got[10] == 2 and sum(got.values()) == 11


def test_gate(spark):
    rows = spark.createDataFrame([(1,)], "v int")
    failed = Q.checks(rows, {"a": F.count("*") > 0, "b": F.max("v") > 3})
    assert tuple(Q.gate(failed).first()) == ("FAIL", 1)


def test_validators(spark):
    rows = spark.createDataFrame([("220",), ("x",), ("300",), (None,)], "v string")
    low, high = POWER_RANGES["Voltage"]
    got = [r[0] for r in rows.select(errors(number_error(F.col("v"), "Voltage", low, high))).collect()]
    assert got == [[], ["Voltage: not a number"], ["Voltage: above 250"], ["Voltage: missing"]]
    texts = spark.createDataFrame([("a@b.co", "+49 30 12345"), ("a@b", "12")], "m string, p string")
    assert [tuple(r) for r in texts.select(is_email(F.col("m")), is_phone(F.col("p"))).collect()] == [(True, True), (False, False)]


def test_correlation_is_exact(spark):
    rows = spark.createDataFrame([(float(i), float(2 * i), float(-i)) for i in range(5)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in S.correlations(rows, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == 1.0 and got[("a", "c")] == -1.0 and not math.isnan(got[("b", "c")])
