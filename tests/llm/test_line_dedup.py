"""Line dedup against a plain count of lines."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from sparkloom.llm import line_dedup

from .conftest import frame

WHITE = " \t\n\x0b\f\r"


def key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(rows, least_docs, least_chars) -> Counter:
    texts = [(r[0], (r[1] or "").split("\n")) for r in rows]
    found = Counter(k for _, lines in texts for k in {key(x) for x in lines})
    many = {k for k, n in found.items() if n >= least_docs and len(k) >= least_chars}
    out = Counter()
    for doc, lines in texts:
        kept = [x for x in lines if key(x) not in many]
        out[(doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def lined() -> list[tuple]:
    rng = random.Random(8)
    common = ["Home | About", "  home | ABOUT\t", "ÉTÉ", "été", "x", "", "   ", "© 2020", "a\rb"]
    rows = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(200)}" for _ in range(rng.randrange(1, 30))]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    rows += [(60 + i, "only\nthis", "en", "s0") for i in range(12)]  # copies: all lines go
    rows += [(80, None, None, None), (81, "", "en", "s1"), (82, "\n\n", "en", "s1"), (83, "this", "en", "s1"), (83, "this", "en", "s1")]
    rows += [(None, "only\nnew", "en", "s1"), (84, "Home | About\n" * 5_000 + "last", "en", "s1"), (85, "\x1conly\x1c ", "en", "s1")]
    return rows


@pytest.mark.parametrize("least_docs", [2, 3, 10])
@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_KEYS, 0])
def test_against_plain_counts(spark, monkeypatch, least_docs, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", broadcast)
    rows = lined()
    docs = frame(spark, rows)
    got = line_dedup.report(docs, least_docs=least_docs)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, least_docs, 1)


@pytest.mark.parametrize("least_chars", [0, 1, 4])
def test_batches_give_the_same(spark, least_chars):
    rows = lined()
    batches = [frame(spark, rows[k::7]) for k in range(7)]
    got = line_dedup.report(frame(spark, rows), batches, least_docs=5, least_chars=least_chars)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 5, least_chars)


def test_levels_stay_few_and_sorted(spark):
    runs = line_dedup.LineRuns(least_docs=3)
    for k in range(10):
        runs.add(frame(spark, [(i, f"line {i % 4}\nown {k} {i}", "en", "s") for i in range(8)]))
    assert all(len(level) < runs.fanout for level in runs.levels) and len(runs.runs()) <= 2 * len(runs.levels)
    for run in runs.runs():
        for part in run.rdd.glom().collect():
            keys = [(r["h1"], r["h2"]) for r in part]
            assert keys == sorted(keys)
    assert runs.frequent().count() == 4
    runs.drop()


def test_known_lines_are_not_added_again(spark):
    runs = line_dedup.LineRuns(least_docs=3)
    for _ in range(2):
        runs.add(frame(spark, [(i, "same", "en", "s") for i in range(5)]))
    assert [run.count() for run in runs.runs()] == [1, 0]


def test_file_batches_hold_every_row(spark, tmp_path):
    frame(spark, lined()).repartition(5).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    parts = line_dedup.file_batches(table, most=3)
    assert len(parts) == 3 and sum(p.count() for p in parts) == table.count()


def test_no_rows(spark, no_docs):
    assert line_dedup.report(no_docs).collect() == []


def test_no_python_on_the_executors(spark, docs):
    plan = line_dedup.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
