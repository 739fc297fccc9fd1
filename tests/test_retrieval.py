"""Questions and answers where the whole vocabulary and every question count."""

from __future__ import annotations

from sparkloom.plans import QUERIES


def answers(spark, folder, rows):
    """By question: relevance, out_of_domain, and the best answer with its score."""
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    relevance = {r["question_id"]: (r["relevance"], r["out_of_domain"]) for r in QUERIES["query_relevance"](spark, str(folder)).collect()}
    best = {r["question_id"]: (r["answer_id"], r["score"]) for r in QUERIES["best_answer"](spark, str(folder)).collect()}
    return relevance, best


def test_terms_beyond_the_20000_most_counted_are_searched(spark, tmp_path):
    common = [" ".join(f"w{i}" for i in range(k, k + 200)) for k in range(0, 20_000, 200)]
    rows = [(5 * k + c, 1, "assistant", text) for k, text in enumerate(common) for c in (1, 2, 3)]
    rows += [(10_000, 1, "assistant", "zebra"), (100, 0, "user", "zebra")]
    relevance, best = answers(spark, tmp_path, rows)
    assert relevance == {100_000: (1.0, False)} and best == {100_000: (10_000_001, 1.0)}


def test_questions_without_a_shared_term_stay(spark, tmp_path):
    rows = [(5, 1, "assistant", "red car"), (10, 1, "assistant", "blue car"), (100, 0, "user", "blue car"), (200, 0, "user", "unheard")]
    rows += [(300, 0, "user", ""), (400, 0, "user", None), (1, 1, "assistant", "pear"), (500, 0, "user", "pear"), (6, 1, "assistant", None)]
    relevance, best = answers(spark, tmp_path, rows)
    assert relevance == {100_000: (1.0, False), 200_000: (0.0, True), 300_000: (0.0, True), 400_000: (0.0, True), 500_000: (1.0, False)}
    assert best == {100_000: (10_001, 1.0), 200_000: (5001, 0.0), 300_000: (5001, 0.0), 400_000: (5001, 0.0), 500_000: (5001, 0.0)}
