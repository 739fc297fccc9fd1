"""Similar items: every item meets every seed where it lies."""

from __future__ import annotations

import pytest

from sparkloom.operators import similarity, tfidf

ROWS = [(1, "a", 0.6), (1, "b", 0.8), (2, "b", 1.0), (3, "c", 1.0), (4, "a", 0.6), (4, "c", 0.8), (5, "d", 1.0)]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def triples(spark):
    return spark.createDataFrame(ROWS, "id long, term string, weight double")


def test_pairs_of_items_and_seeds_are_not_joined_in_a_shuffle(spark, triples):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        seeds = spark.createDataFrame([(1,), (5,)], "id long")
        assert "SortMergeJoin" not in physical(similarity.similar_items(tfidf.dealt(triples, "id"), "id", seeds, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_equal_brute_force(spark, triples):
    vectors = {}
    for i, term, w in ROWS:
        vectors.setdefault(i, {})[term] = w

    def best(seed, ids, k):
        dot = {i: round(sum(w * vectors[seed].get(x, 0.0) for x, w in vectors.get(i, {}).items()), 6) for i in ids if i != seed}
        ranked = sorted(dot.items(), key=lambda x: (-x[1], x[0]))[:k]
        return [(seed, i, s, rank) for rank, (i, s) in enumerate(ranked, 1)]

    def rows(df):
        return sorted((r["seed"], r["id"], r["score"], r["rank"]) for r in df.select("seed", "id", "score", "rank").collect())

    assert rows(similarity.similar_items(triples, "id", [1, 5, 9], 3)) == sorted(best(1, vectors, 3) + best(5, vectors, 3))
    allowed = [2, 3, 5, 7]  # 7 has no terms
    table = spark.createDataFrame([(i,) for i in allowed], "id long")
    assert rows(similarity.similar_items(triples, "id", [1, 5], 9, table)) == sorted(best(1, allowed, 9) + best(5, allowed, 9))
