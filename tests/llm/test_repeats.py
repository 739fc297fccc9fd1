"""Substring and suffix-array dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import repeats, substring_dedup, suffix_dedup
from sparkloom.llm.common import hash_words

from .conftest import frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows: list[tuple], window: int) -> list[tuple[object, list[str], set[int]]]:
    first: dict[tuple, int] = {}
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for doc, words in split:
        if doc is None:
            continue
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone: set[int] = set()
        for a in range(len(words) - window + 1) if doc is not None else []:
            if first[tuple(words[a : a + window])] < doc:
                gone.update(range(a, a + window))
        out.append((doc, words, gone))
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup(docs, rows, window):
    got = Counter(tuple(r) for r in substring_dedup.report(docs, window).collect())
    want = Counter(
        (d, len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest())
        for d, w, g in brute(rows, window)
    )
    assert got == want


def sources(rows: list[tuple], window: int) -> set[tuple]:
    """Passages by brute force: every window's first document and place, runs with one source."""
    first: dict[tuple, tuple] = {}
    split = {(r[0], r[1]): WORD.findall(r[1] or "") for r in rows if r[0] is not None}
    for (doc, _), words in split.items():
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            first[key] = min(first.get(key, (doc, a)), (doc, a))
    out = set()
    for (doc, _), words in split.items():
        by: dict[tuple, list[int]] = {}
        for a in range(len(words) - window + 1):
            where, place = first[tuple(words[a : a + window])]
            if where < doc:
                by.setdefault((where, place - a), []).append(a)
        for (where, shift), starts in by.items():
            begin = last = starts[0]
            for a in [*starts[1:], None]:
                if a is None or a > last + window:
                    out.add((doc, begin, last + window, last + window - begin, where, begin + shift))
                    begin = a
                last = a
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_suffix_dedup(docs, rows, window):
    got = [tuple(r) for r in suffix_dedup.report(docs, window).collect()]
    assert len(got) == len(set(got)) and set(got) == sources(rows, window)
    found: dict[int, set[int]] = {}
    for doc, start, stop, *_ in got:
        found.setdefault(doc, set()).update(range(start, stop))
    assert found == {d: g for d, _, g in brute(rows, window) if g}


def test_passages_of_two_sources_stay_apart(spark):
    rng = random.Random(7)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (3, a + " " + b, "en", "s")]
    got = sorted(tuple(r) for r in suffix_dedup.report(frame(spark, rows)).collect())
    assert got == [(3, 0, 60, 60, 1, 0), (3, 60, 120, 60, 2, 0)]


def test_long_words_that_differ_are_no_repeat(spark):
    rng = random.Random(8)
    words = sentence(rng, 61).split()
    rows = []
    for doc, letters in ((1, "ab"), (2, "ba")):
        own = list(words)
        own[30] = "".join(letters[i.bit_count() & 1] for i in range(1024))
        rows.append((doc, " ".join(own), "en", "s"))
    docs = frame(spark, rows)
    assert sorted(tuple(r)[:3] for r in substring_dedup.report(docs).collect()) == [(1, 61, 0), (2, 61, 0)]
    assert suffix_dedup.report(docs).count() == 0


@pytest.mark.parametrize("group", [1, 3])
@pytest.mark.parametrize("window", [50, 12])
def test_prefixes_with_many_contexts_are_made_longer(docs, rows, monkeypatch, group, window):
    monkeypatch.setattr(repeats, "GROUP", group)
    got = Counter(tuple(r)[:3] for r in substring_dedup.report(docs, window).collect())
    assert got == Counter((d, len(w), len(g)) for d, w, g in brute(rows, window))
    assert {tuple(r) for r in suffix_dedup.report(docs, window).collect()} == sources(rows, window)


def test_a_full_filter_is_followed_by_a_join(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_BITS", 1)
    got = Counter(tuple(r)[:3] for r in substring_dedup.report(docs).collect())
    assert got == Counter((d, len(w), len(g)) for d, w, g in brute(rows, 50))


def test_kept_texts_agree(docs):
    a, b = substring_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(docs)
    assert Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_empty_tables(no_docs):
    assert substring_dedup.report(no_docs).count() == 0
    assert suffix_dedup.report(no_docs).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    for _ in range(50):
        window, gram = rng.randrange(2, 30), rng.randrange(1, 9)
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))).encode() for _ in range(4)]
        words, counts = hash_words(texts)
        h, text, place, first, last = repeats.anchors(words, counts, window, gram)
        seen: dict[tuple, tuple] = {}
        covered = 0
        for a, t, p, x, y in zip(h, text, place, first, last, strict=True):
            own = texts[t].split()
            for s in range(x, y + 1):
                covered += 1
                assert s <= p <= s + window - min(gram, window)
                assert seen.setdefault(tuple(own[s : s + window]), (int(a), int(p - s))) == (int(a), int(p - s))
        assert covered == sum(max(0, c - window + 1) for c in counts)


def test_subtrees_have_the_shared_lengths():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 25))] for _ in range(5)]
        ids = np.array([x for t in texts for x in [*t, 0]])
        starts, stops, suffixes, at = [], [], [], 0
        for t in texts:
            for k in range(len(t)):
                starts.append(at + k)
                stops.append(at + len(t))
                suffixes.append(t[k:])
            at += len(t) + 1
        tree = substring_dedup.SubTree(ids, np.array(starts), np.array(stops), max(map(len, texts)))
        ordered = [suffixes[k] for k in tree.order]
        assert ordered == sorted(suffixes)
        for x, y, shared in zip(ordered, ordered[1:], tree.shared[1:], strict=False):
            assert shared == next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        depth = rng.randrange(1, 6)
        _, node = tree.nodes(depth)
        deep = [k for k, s in enumerate(suffixes) if len(s) >= depth]
        for i in deep:
            for j in deep:
                assert (node[i] == node[j]) == (suffixes[i][:depth] == suffixes[j][:depth])


def test_tables_end_with_a_prefix(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "TOGETHER", 5)
    keys = sorted(random.Random(3).choices(range(8), k=60))
    table = pa.table({"key": keys})
    pieces = [p["key"].to_pylist() for p in repeats._pieces(iter(table.to_batches(max_chunksize=4)))]
    assert [k for p in pieces for k in p] == keys and len(pieces) > 3
    assert all(p[-1] != q[0] for p, q in zip(pieces, pieces[1:], strict=False))


def test_words_split_like_the_pattern():
    text = "a\x1cb c\x0bd\u00a0e  f\t\u2003g\n"
    words, counts = hash_words([text.encode(), None, b""])
    assert counts.tolist() == [len(WORD.findall(text)), 0, 0] and len(words) == counts[0]


def all_sources(rows: list[tuple], window: int) -> set[tuple]:
    """sources() with the windows that start earlier in their own document and in no smaller one."""
    first: dict[tuple, tuple] = {}
    split = {(r[0], r[1]): WORD.findall(r[1] or "") for r in rows if r[0] is not None}
    for (doc, _), words in split.items():
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            first[key] = min(first.get(key, (doc, a)), (doc, a))
    out = set()
    for (doc, _), words in split.items():
        last: dict[tuple, list[int]] = {}
        for a in range(len(words) - window + 1):
            where, place = first[tuple(words[a : a + window])]
            if (where, place) == (doc, a):
                continue
            open_ = last.get((where, place - a))
            if open_ is not None and a <= open_[1]:
                open_[1] = a + window
            else:
                last[where, place - a] = open_ = [a, a + window]
            out.add((doc, where, place - a, open_[0]))
        # the runs as they ended
        for (where, shift), _ in last.items():
            starts = sorted(x[3] for x in out if len(x) == 4 and x[:3] == (doc, where, shift))
            for b in starts:
                a = b
                while a + 1 <= len(words) - window and any(first[tuple(words[c : c + window])] == (where, c + shift) for c in range(a + 1, min(a + window, len(words) - window) + 1)):
                    a = next(c for c in range(a + 1, a + window + 1) if first[tuple(words[c : c + window])] == (where, c + shift))
                out.add((doc, b, a + window, a + window - b, where, b + shift))
    return {x for x in out if len(x) == 6}


@pytest.mark.parametrize("window", [50, 12])
def test_repeats_inside_a_document(spark, window):
    rng = random.Random(12)
    one, two = sentence(rng, 80), sentence(rng, 70)
    rows = [
        (1, f"{one} {sentence(rng, 9)} {one}", "en", "s"), (2, f"{sentence(rng, 20)} {one} x {two} y {two} z", "en", "s"), (3, "a b " * 90, "en", "s"),
        (4, sentence(rng, 200), "en", "s"), (5, f"{two} {two} {two}", "en", "s"), (6, None, "en", "s"), (7, "", "en", "s"),
        (8, f"{one} end {sentence(rng, 4)} {one} end", "en", "s"), (None, f"{one} {one}", "en", "s"),
    ]
    docs = frame(spark, rows)
    got = {tuple(r) for r in suffix_dedup.report(docs, window, inside=True).collect()}
    assert got == all_sources(rows, window)
    assert {r for r in got if r[0] != r[4]} == sources(rows, window)
    assert any(r[0] == r[4] == 1 and r[3] == 80 for r in got)
    kept = {r["doc_id"]: r["kept_text"].decode().split() for r in suffix_dedup.remove_repeats(docs, window, inside=True).collect()}
    assert len(kept[1]) == 89 and kept[4] == rows[3][1].split()
