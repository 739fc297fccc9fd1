"""Small corpora with everything that can be odd about a table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

#: Further columns whose names operators might use themselves.
CLASHING = ("row_id", "n", "sid", "tid", "spans", "node", "size", "target", "rate", "part", "block", "u", "v", "links", "held_out",
            "_own", "_gone", "_all", "_row", "_mix", "_mix_of", "_mix_source", "ctx", "key", "parent", "low", "high")


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, passages, odd and null rows."""
    rng = random.Random(3)
    passage, base = sentence(rng, 70), sentence(rng, 200)
    rows: list[tuple] = [(i, sentence(rng, rng.randrange(1, 160)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(40 + i, sentence(rng, 30) + " " + passage + " " + sentence(rng, 25), "en", "s0") for i in range(6)]
    for i in range(8):  # near copies
        words = base.split()
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((50 + i, " ".join(words), "de", "s1"))
    rows += [(60 + i, base, "de", "s1") for i in range(4)]  # exact copies
    rows += [
        (70, None, "en", "s0"), (71, "", "en", None), (72, "  \t\n ", None, "s2"), (73, "one", "en", "s0"), (74, "one", "fr", "s0"),
        (75, "two words", "en", "s0"), (76, "12 34 !!", "en", "s9"), (77, "Éa été çà", "fr", "é"), (78, "a b " * 300, "en", "s0"),
        (79, "a b " * 280, "en", "s0"), (80, sentence(rng, 6000), "en", "s0"), (81, "THE End\x0bof\x1cit", "en", "s0"),
        (None, sentence(rng, 60), "en", "s0"), (82, passage, "en", "s0"), (82, passage, "en", "s0"), (83, base + " " + passage, None, None),
    ]
    return rows


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    extra = [("clash",) * len(CLASHING)] * len(rows)
    shape = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([r + e for r, e in zip(rows, extra, strict=True)], shape).repartition(3)


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows) -> DataFrame:
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark) -> DataFrame:
    return frame(spark, corpus()[:1]).limit(0)
