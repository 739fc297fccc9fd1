"""Top-K by bounds against the whole product; quantiles that several columns share."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import stats
from sparkloom.operators.ordering import column_quantiles
from sparkloom.operators.similarity import scores, top_k
from sparkloom.operators.topk import build_index, postings_read, top_k_by_bounds


def unit(rows: list[tuple]) -> list[tuple]:
    norm: dict = {}
    for key, *_, w in rows:
        norm[key] = norm.get(key, 0.0) + w * w
    return [(*r[:-1], r[-1] / math.sqrt(norm[r[0]])) for r in rows]


@pytest.fixture(scope="module")
def items(spark):
    """Items of ten topics, each with words of its topic and a few common ones; equal items too."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        topic = i % 10
        words = {f"t{topic}-{rng.randrange(6)}" for _ in range(4)} | {f"all{rng.randrange(5)}"}
        rows += [(i, f"p{i % 2}", w, rng.choice([1.0, 1.0, 2.0])) for w in words]
    rows += [(500 + i, "p0", "t3-1", 1.0) for i in range(30)]
    return spark.createDataFrame(unit(rows), "id long, g string, term string, weight double").cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(8)
    rows = []
    for q in range(25):
        words = {f"t{q % 10}-{rng.randrange(6)}" for _ in range(3)} | {"all0"}
        rows += [(q, f"p{q % 2}", w, rng.random()) for w in words]
    rows += [(90, "p0", "unheard", 1.0), (91, None, "t3-1", 1.0)]
    return spark.createDataFrame(unit(rows), "q long, g string, term string, weight double").cache()


def ranked(df) -> set[tuple]:
    return {(r["q"], r["id"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("k", "block"), [(1, 8), (5, 8), (20, 3), (1000, 8)])
def test_the_same_as_the_whole_product(items, queries, tmp_path, k, block):
    folder = str(tmp_path)
    index = build_index(items, "id", folder, block=block)
    got = top_k_by_bounds(queries, index, "q", k, folder, block=block)
    assert ranked(got) == ranked(top_k(scores(queries, items, "q", "id"), "q", "id", k))
    read = postings_read(queries, index, "q", k, folder, block=block).first()
    if k <= 5:
        assert read["read"] < 0.6 * read["postings"]
    else:
        assert read["read"] <= read["postings"]


def test_what_is_excluded_makes_room(items, queries, tmp_path):
    folder = str(tmp_path)
    index = build_index(items, "id", folder)
    seen = top_k(scores(queries, items, "q", "id"), "q", "id", 7).select("q", "id")
    got = top_k_by_bounds(queries, index, "q", 4, folder, exclude=seen)
    rest = scores(queries, items, "q", "id").join(seen, ["q", "id"], "left_anti")
    assert ranked(got) == ranked(top_k(rest, "q", "id", 4))


def test_parts_are_searched_apart(items, queries, tmp_path):
    folder = str(tmp_path)
    index = build_index(items, "id", folder, part="g")
    got = top_k_by_bounds(queries, index, "q", 3, folder, part="g")
    both = queries.withColumnRenamed("weight", "qw").join(items, ["g", "term"]).groupBy("q", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    assert ranked(got) == ranked(top_k(both, "q", "id", 3))


def test_empty_sides(items, queries, tmp_path):
    index = build_index(items.limit(0), "id", str(tmp_path / "a"))
    assert top_k_by_bounds(queries, index, "q", 3, str(tmp_path / "a")).count() == 0
    index = build_index(items, "id", str(tmp_path / "b"))
    assert top_k_by_bounds(queries.limit(0), index, "q", 3, str(tmp_path / "b")).count() == 0


def want(values: list[float], p: float) -> float:
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = values[int(at)], values[min(len(values) - 1, int(at) + 1)]
    return low if low == high else low + (at - int(at)) * (high - low)


def test_quantiles_of_several_columns(spark):
    rng = random.Random(3)
    close = [1e9 + rng.random() * 1e-3 for _ in range(300)]  # one group of magnitude, many parts of it
    rows = [(rng.choice("ab"), close[i], rng.choice([-3.0, 0.0, -0.0, 2.0, None]), -(2.0 ** rng.randrange(-40, 40)) * rng.random(), i * 7 % 101) for i in range(300)]
    rows += [("a", float("inf"), None, None, None), ("c", None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double, n int").repartition(4)
    at = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.77, "e": 1.0}
    values = {c: F.col(c) for c in "xyzn"}
    one = column_quantiles(df, values, at).first()
    by = {r["k"]: r for r in column_quantiles(df, values, at, ["k"]).collect()}
    assert set(by) == {"a", "b"}
    for i, c in enumerate("xyzn"):
        for n, p in at.items():
            assert one[f"{c}_{n}"] == pytest.approx(want([r[i + 1] for r in rows if r[i + 1] is not None], p), rel=1e-12)
            for k in by:
                assert by[k][f"{c}_{n}"] == pytest.approx(want([r[i + 1] for r in rows if r[0] == k and r[i + 1] is not None], p), rel=1e-12)


def test_two_scans_whatever_the_columns(spark, tmp_path):
    spark.range(5_000).select(*[(F.hash("id", F.lit(i)) / 7).alias(f"c{i}") for i in range(4)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = column_quantiles(df, {f"c{i}": F.col(f"c{i}") for i in range(4)}, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") <= 2


def test_activity_of_no_and_one_key(spark):
    none = spark.createDataFrame([], "k string")
    assert stats.activity(none, "k").first()["n_keys"] == 0
    one = stats.activity(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k").first()
    assert (one["n_keys"], one["median"], one["p99"], one["heavy"], one["light"]) == (1, 2.0, 2.0, 1, 1)
