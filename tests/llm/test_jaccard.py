"""The similarity join against all pairs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import jaccard_join as J

from .conftest import frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sets(rows: list[tuple], n: int) -> list[tuple[object, frozenset]]:
    out = []
    for r in rows:
        words = WORD.findall(lower(r[1] or ""))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
        out.append((r[0], frozenset(grams)))
    return out


def brute(rows: list[tuple], n: int, num: int, den: int) -> list[tuple]:
    items = sets(rows, n)
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(items)), 2):
        a, b = items[i][1], items[j][1]
        if a and b and den * len(a & b) >= num * len(a | b):
            parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(items)), key=repr)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_components(docs, rows, n, num):
    got = sorted((tuple(r) for r in J.jaccard_components(docs, n, num, 100).collect()), key=repr)
    assert got == brute(rows, n, num, 100)


def test_long_texts_and_parts(spark):
    """Sets beyond the smallest bitmap, and a block dealt out as a grid."""
    rng = random.Random(5)
    base = sentence(rng, 3000, 10_000).split()
    rows = []
    for i in range(12):
        words = list(base)
        for _ in range(rng.randrange(10, 60)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(100 + i, sentence(rng, 2800, 10_000), "en", "s") for i in range(4)]
    docs = frame(spark, rows)
    want = brute(rows, 4, 85, 100)
    assert len({w[2] for w in want}) < len(rows)
    for block in (J.BLOCK_KEYS, 9000):
        got = sorted((tuple(r) for r in J.jaccard_components(docs, 4, 85, 100, block).collect()), key=repr)
        assert got == want


def test_a_block_of_several_clusters_in_parts(spark, monkeypatch):
    """Near copies around three texts that are near each other, dealt out in many parts."""
    monkeypatch.setattr(J, "PIVOTS", 3)
    rng = random.Random(11)
    base = sentence(rng, 160, 5000).split()
    rows = []
    for c in range(3):
        own = list(base)
        for p in range(5 * c):
            own[p * 7] = f"c{c}.{p}"
        for i in range(25):
            words = list(own)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            rows.append((100 * c + i, " ".join(words), "en", "s"))
    docs = frame(spark, rows)
    want = brute(rows, 4, 85, 100)
    assert 1 < len({w[2] for w in want}) < len(rows)
    for block in (1000, 4000):
        got = sorted((tuple(r) for r in J.jaccard_components(docs, 4, 85, 100, block).collect()), key=repr)
        assert got == want


def test_keep_one(docs, rows):
    kept = J.keep_one_per_component(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute(rows, 5, 80, 100) if d == c}  # of the repeated rows one
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_keep_one_of_repeated_and_null_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    rows = [(1, a), (None, a), (2, a), (2, b), (None, c), (None, c), (3, d), (3, d + " end"), (None, None), (None, None)]
    kept = J.keep_one_per_component(frame(spark, [(i, t, "en", "s") for i, t in rows]), 5, 80, 100).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept if r["doc_id"] != 3), key=repr)
    assert got == sorted([(1, a), (2, b), (None, c), (None, None), (None, None)], key=repr)
    assert [r["text"] in (d, d + " end") for r in kept if r["doc_id"] == 3] == [True]


def test_empty(no_docs):
    assert J.jaccard_components(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 25), max_size=14), max_size=14), st.sampled_from([50, 80, 85]))
def test_trie_finds_every_link(items, num):
    trie = J.TrieJoin(num, 100)
    for s in items:
        trie.add(np.array(sorted(s), np.uint64))
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(items)), 2):
        if items[i] and items[j] and 100 * len(items[i] & items[j]) >= num * len(items[i] | items[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    assert [trie.find(i) for i in range(len(items))] == [find(i) for i in range(len(items))]


@settings(max_examples=60, deadline=None)
@given(st.frozensets(st.integers(0, 5000), min_size=1, max_size=1500), st.frozensets(st.integers(0, 5000), min_size=1, max_size=60))
def test_bitmaps_bound_the_difference(a, change):
    b = a ^ change
    if not b:
        return
    spread = lambda s: np.array([(x * 0x9E3779B97F4A7C15) % (1 << 64) for x in s], np.uint64)
    x, y = J.parity_bitmap(spread(a)), J.parity_bitmap(spread(b))
    words = min(len(x), len(y))
    assert np.bitwise_count(J.fold(x, words) ^ J.fold(y, words)).sum() <= len(a ^ b)


def swap_sequence(letters: str, n: int) -> str:
    """The Thue-Morse word: it and its complement agree in every low-order linear sum."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_long_words_that_linear_sums_confuse(spark):
    a, b = swap_sequence("ab", 1024), swap_sequence("ba", 1024)
    rows = [(1, f"p q r {a} p q r {b}", "en", "s"), (2, f"p q r {a}", "en", "s"), (3, f"p q r {b}", "en", "s")]
    got = sorted(tuple(r) for r in J.jaccard_components(frame(spark, rows), 4, 85, 100).collect())
    assert got == brute(rows, 4, 85, 100) == [(1, 5, 1), (2, 1, 2), (3, 1, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB z\n"), max_size=90), max_size=6))
def test_word_hashes_tell_words_apart(texts):
    words, counts = J.hash_words([t.encode() for t in texts], lower=True)
    split = [WORD.findall(lower(t)) for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    seen: dict[str, int] = {}
    for word, h in zip((w for ws in split for w in ws), words.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hot_shingles_form_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(J, "HOT_TOKEN", 3)
    got = sorted((tuple(r) for r in J.jaccard_components(docs, 4, 85, 100).collect()), key=repr)
    assert got == brute(rows, 4, 85, 100)


def test_lone_rows_across_batches():
    """Sorted rows dealt in batches of any size give the same rows as in one."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(12), (10, 10, 11, 40, 90)[h % 5], h) for h in (rng.randrange(30) for _ in range(120)))
    table = J.pa.table({"token": [r[0] for r in rows], "half": [r[2] for r in rows], "n": J.pa.array([r[1] for r in rows], J.pa.int32())})
    want = None
    for size in (1000, 7, 1):
        got = [tuple(r.values()) for b in J._without_lone(85, 100, 100)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        want = got if want is None else want
        assert got == want
    brute_ = {(t, h, n) for t, n, h in rows if any(t == t2 and h != h2 and 100 * min(n, n2) >= 85 * max(n, n2) for t2, n2, h2 in rows)}
    assert {(t, h, n) for t, h, n in want} == brute_


@pytest.mark.parametrize("hot", [1, 3, 6])
def test_rows_of_hot_tokens_are_tied(hot, monkeypatch):
    """The sets of a token with more rows are one component, those of others stay as they are."""
    monkeypatch.setattr(J, "_TIED", 2)
    rng = random.Random(6)
    rows = sorted({(t, 100, rng.randrange(50)) for t in range(9) for _ in range(rng.randrange(1, 12))})
    table = J.pa.table({"token": [r[0] for r in rows], "half": [r[2] for r in rows], "n": J.pa.array([r[1] for r in rows], J.pa.int32())})
    sizes = {t: len([r for r in rows if r[0] == t]) for t in range(9)}
    assert max(sizes.values()) > hot
    for size in (1000, 5, 1):
        got = [tuple(r.values()) for b in J._without_lone(85, 100, hot)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {(t, h) for t, h, n in got if n > 0} == {(t, h) for t, _, h in rows if 1 < sizes[t] <= hot}
        parent = J.Forest()
        by: dict[int, list[int]] = {}
        for t, h, n in got:
            if n < 0:
                by.setdefault(t, []).append(h)
        for own in by.values():
            for h in own:
                parent.union(own[0], h)
        for t in sizes:
            if sizes[t] > hot:
                assert len({parent.find(h) for tt, _, h in rows if tt == t}) == 1


def test_no_part_holds_a_block_of_sets_that_do_not_link(spark, monkeypatch):
    """400 sets of frequent words, few of them linked: one block, of which no part holds more than its bound."""
    monkeypatch.setattr(J, "HOT_TOKEN", 10)
    rng = random.Random(9)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(40)], 12)) for _ in range(400)]
    texts += [" ".join(t.split()[:-1]) for t in texts[:5]]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    placed = []
    keep = J.left_over_parts
    monkeypatch.setattr(J, "left_over_parts", lambda named, keys: placed.append(keep(named, keys)) or placed[-1])
    got = sorted((tuple(r) for r in J.jaccard_components(frame(spark, rows), 1, 85, 100, block_keys=1_000).collect()), key=repr)
    assert got == brute(rows, 1, 85, 100)
    parts = placed[0].groupBy("block", "part").count().collect()
    assert len(parts) > 40 and max(r["count"] for r in parts) * 12 <= 1_000
