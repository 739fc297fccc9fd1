"""Source divergence against exact counts of everything."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import divergence

from .conftest import frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top=200) -> set[tuple]:
    docs = [(r[2] or "", r[3] or "", TERM.findall(lower(r[1] or ""))) for r in rows]
    df = defaultdict(Counter)
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    kept = {lang: [t for t, n in found.items() if n >= least] for lang, found in df.items()}
    counts, whole = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        own = [t for t in terms if df[lang][t] >= least]
        counts[lang, source].update(own)
        whole[lang].update(own)
    out = set()
    groups = {(lang, source) for lang, source, _ in docs}

    def p(found, t, v):
        return 1 + 10**9 * (found[t] + 1) // (sum(found.values()) + v)

    def ranked(lang, source, part, found, most):
        found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
        out.update((lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found))

    for lang, source in groups:
        terms, own = kept.get(lang, []), counts[lang, source]
        v = len(terms)
        pairs = []
        for other in {s for g, s in groups if g == lang} - {source}:
            them = counts[lang, other]
            pairs.append((other, sum((p(own, t, v) - p(them, t, v)) ** 2 // p(them, t, v) for t in terms)))
        ranked(lang, source, "pair", pairs, None)
        found = []
        for t in terms:
            a, b = p(own, t, v), p(whole[lang], t, v)
            if own[t] and a > b:
                found.append((t, (a - b) ** 2 // b))
        ranked(lang, source, "term", found, top)
    return out


def odd(rows):
    more = [(200, "Été ÉTÉ it's it's naïve\x1cnaïve", "fr", "é"), (201, "it s Été", "fr", ""), (202, "it s été", "fr", None), (203, "12 34", "xx", "a"),
            (204, None, "xx", "b"), (205, "alone here", "yy", "a"), (206, "1", "yy", "b")]
    return rows + more


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 5), (2, 200)])
def test_against_exact_counts(spark, rows, least, top):
    rows = odd([(r[0], (r[1] or "").translate(str.maketrans("0123456789", "abcdefghij")) or r[1], *r[2:]) for r in rows])
    got = [tuple(r) for r in divergence.report(frame(spark, rows), least, top).collect()]
    want = plain(rows, least, top)
    assert len(got) == len(want) and set(got) == want


def test_small_pieces_and_many_flushes(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "_PIECE", 7)
    rows = odd([(r[0], (r[1] or "").replace("w", "q "), *r[2:]) for r in rows])
    assert b"".join(b"".join(p) for p in divergence.terms(b"Ab-cd" * 9)) == b"abcd" * 9
    assert {tuple(r) for r in divergence.report(frame(spark, rows)).collect()} == plain(rows, 3)


def test_nothing_kept_and_no_rows(spark, no_docs):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "de", "a")]
    got = {tuple(r) for r in divergence.report(frame(spark, rows)).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.report(no_docs).collect() == []


def test_estimates_are_never_below(spark, monkeypatch):
    rows = [(i, " ".join(f"t{'abcdefghij'[i % 10]}{'abcdefghij'[k % 10]}{'xyz'[(i * k) % 3]}" for k in range(30)), "en", "s") for i in range(50)]
    sketch = divergence.build_sketch(frame(spark, rows), divergence._SLICE)
    found = Counter(t for r in rows for t in set(TERM.findall(r[1])))
    names = [t.encode() for t in found]
    for least in (1, 3, 10, 300):
        may = sketch.may_reach(b"en", names, least)
        assert all(ok for t, ok in zip(found, may, strict=True) if found[t] >= least)
    assert not sketch.may_reach(b"de", names, 3).any()
    assert np.mean(sketch.may_reach(b"en", [b"q" + str(i).encode() for i in range(500)], 1)) < 0.1


def test_counters_stop(spark):
    rows = [(i, "often", "en", "s") for i in range(700)]
    sketch = divergence.build_sketch(frame(spark, rows).repartition(5), divergence._SLICE)
    assert sketch.counters.max() == divergence.CEILING and sketch.may_reach(b"en", [b"often"], 700).all()
