"""Searches by grams and joins with keywords against looking at every text."""

from __future__ import annotations

import random

import pytest

from sparkloom.operators import substrings

TEXTS = ["Small Ring", "bolt", "Ring of rings", "", None, "aaaa", "naïve été", "x", "ab", "😀 smile 😀", "RING", "banana nana", "a.b*c"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(20, "Ring", "clash")]
    return spark.createDataFrame(rows, "id long, t string, needle_ string").repartition(3)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("grams") / "index")
    substrings.write_gram_index(table, "id", "t", folder)
    return folder


@pytest.mark.parametrize("needle", ["ring", "RING", "r", "in", "ring ", "aaa", "aaaaa", "é", "ïve", "😀", "😀 s", ".b*", "", "zzz", "l r"])
def test_search_is_contains(table, index, needle):
    want = {i for i, t in [*enumerate(TEXTS), (20, "Ring")] if t is not None and needle.lower() in t.lower()}
    got = substrings.search(table, "id", "t", index, needle).collect()
    assert {r["id"] for r in got} == want and len(got) == len(want)


def test_many_needles_at_once(spark, table, index):
    needles = ["ring", "Ring", "a", "na", "", None, "été", "zzz"]
    got = substrings.search_all(table, "id", "t", index, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    want = {(n.lower(), i) for n in needles if n for i, t in [*enumerate(TEXTS), (20, "Ring")] if t and n.lower() in t.lower()}
    assert sorted((r["needle"], r["id"]) for r in got) == sorted(want)


def places(text: str, word: str) -> list[int]:
    return [i + 1 for i in range(len(text)) if text.startswith(word, i)]


def test_keywords_at_every_place(spark, table):
    words = ["ring", "na", "ana", "a", "é", "banana nana", "", None, "RINGS", "aa", "😀", "smile", "none such"]
    got = substrings.keyword_matches(table, "id", "t", spark.createDataFrame([(w,) for w in words], "keyword string")).collect()
    want = sorted((w.lower(), i, p) for w in words if w for i, t in [*enumerate(TEXTS), (20, "Ring")] if t for p in places(t.lower(), w.lower()))
    assert sorted((r["keyword"], r["id"], r["place"]) for r in got) == want


def test_ten_thousand_keywords(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 12))) for _ in range(11_000)})[:10_000]
    texts = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(60)]
    df, known = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in words], "keyword string")
    got = {(r["keyword"], r["id"]) for r in substrings.keyword_matches(df, "id", "t", known).select("keyword", "id").distinct().collect()}
    assert got == {(w, i) for i, t in texts for w in words if w in t}


def test_no_rows(spark, table, tmp_path):
    none = table.limit(0)
    substrings.write_gram_index(none, "id", "t", str(tmp_path / "i"))
    assert substrings.search(none, "id", "t", str(tmp_path / "i"), "ring").count() == 0
    assert substrings.keyword_matches(none, "id", "t", spark.createDataFrame([("a",)], "keyword string")).count() == 0
    assert substrings.keyword_matches(table, "id", "t", spark.createDataFrame([], "keyword string")).count() == 0
