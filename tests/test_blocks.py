"""Top-K of blocks of queries against the whole product; documents dealt out by size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.text import normal_tokens
from sparkloom.operators.blocks import dense_top_k, sparse_top_k
from sparkloom.operators.ordering import dealt
from sparkloom.operators.similarity import dense_cosine, scores, top_k
from sparkloom.operators.tfidf import tfidf


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    items = [(i, f"p{i % 2}", f"t{t}", rng.choice([0.2, 0.5])) for i in range(300) for t in rng.sample(range(40), 1 + i % 5)]
    asked = [(q, f"p{q % 2}", f"t{t}", rng.choice([0.3, 0.6])) for q in range(30) for t in rng.sample(range(45), 4)]
    return [spark.createDataFrame(r, f"{k} long, g string, term string, weight double").cache() for r, k in ((asked, "q"), (items, "id"))]


def same(a, b) -> None:
    assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("cells", [1 << 24, 100])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_sparse_is_the_whole_product(sides, k, cells):
    asked, items = sides
    same(sparse_top_k(asked, items, "q", "id", k, cells=cells), top_k(scores(asked, items, "q", "id"), "q", "id", k))


@pytest.mark.parametrize("cells", [1 << 24, 100])
def test_sparse_parts_and_pairs_left_out(sides, cells):
    asked, items = sides
    both = asked.withColumnRenamed("weight", "w").join(items, ["g", "term"]).groupBy("q", "id").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    same(sparse_top_k(asked, items, "q", "id", 3, part="g", cells=cells), top_k(both, "q", "id", 3))
    seen = top_k(scores(asked, items, "q", "id"), "q", "id", 5).select("q", "id")
    rest = scores(asked, items, "q", "id").join(seen, ["q", "id"], "left_anti")
    same(sparse_top_k(asked, items, "q", "id", 3, exclude=seen, cells=cells), top_k(rest, "q", "id", 3))
    assert sparse_top_k(asked.limit(0), items, "q", "id", 3).count() == sparse_top_k(asked, items.limit(0), "q", "id", 3).count() == 0


def test_a_task_hands_on_k_rows_of_a_query(sides):
    """The pairs themselves are never rows: no join of queries and items is in the plan."""
    plan = sparse_top_k(*sides, "q", "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("block", [1_000, 3])
def test_dense_is_the_whole_product(spark, block):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(120)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [1.0]), (204, [-2.0]), (205, []), (206, [float("nan"), 1.0, 1.0]), (207, [float("inf"), 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    asked = v.filter("id % 5 = 0 or id > 199")
    q = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    every = q.crossJoin(v).filter("id <> query_id").select("query_id", "id", dense_cosine(F.col("q"), F.col("v")).alias("score")).filter("score is not null and id <> 201 and query_id <> 201")
    got = dense_top_k(v, "id", "v", asked, 4, block=block)
    plain = lambda df: sorted((r["query_id"], r["id"], repr(r["score"]), r["rank"]) for r in df.collect())
    assert plain(got) == plain(top_k(every, "query_id", "id", 4, 5))


def test_parts_grow_in_number_with_rows_and_characters(spark):
    rows = spark.range(3_000).select("id", F.repeat(F.lit("x"), 10).alias("t")).coalesce(1)
    assert dealt(rows, "id", rows=100).rdd.getNumPartitions() == 30
    assert dealt(rows, "id", chars=1_000).rdd.getNumPartitions() == 30


def test_items_of_a_frequent_term_stay_where_they_are(spark):
    """Weights need one shuffle of whole documents: none by term but for the statistics of terms."""
    docs = spark.range(2_000).select("id", F.concat(F.lit("red w"), (F.col("id") % 50).cast("string")).alias("t")).coalesce(1)
    plan = tfidf(docs, "id", normal_tokens(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(term") <= 1
