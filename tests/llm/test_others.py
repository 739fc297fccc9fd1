"""Decontamination, embeddings, mixing, chat, language, tokens, licences, the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparkloom.llm import chat, decontaminate, embedding_dedup, language_id, license_scan, mixing, queries, token_output
from sparkloom.llm.bloom import build_bloom
from sparkloom.llm.components import connected_components

from .conftest import sentence

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- decontamination


def items(rows) -> list[tuple]:
    texts = [rows[3][1], rows[41][1], "One!", None, "", rows[82][1] if len(rows) > 82 else "x", "a b A, b", rows[41][1]]
    return list(enumerate(texts))


def judged(rows, bench, window) -> Counter:
    windows: dict[tuple, set] = {}
    for i, text in bench:
        words = ALNUM.findall(lower(text))
        size = min(window, len(words))
        for a in range(len(words) - size + 1) if words else []:
            windows.setdefault(tuple(words[a : a + size]), set()).add(str(i))
    out = Counter()
    for r in rows:
        words = ALNUM.findall(lower(r[1]))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                own = windows.get(tuple(words[a : a + size]))
                if own:
                    hit.update(range(a, a + size))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(r[0], len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words))] += 1
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 40])
def test_decontamination(spark, docs, rows, block):
    bench = items(rows)
    table = spark.createDataFrame(bench, "item_id long, text string")
    want = judged(rows, bench, 13)
    got = decontaminate.report(docs, table, block_bytes=block).drop("longest_match")
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = decontaminate.remove_contaminated(docs, table, block_bytes=block)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({k[0]: n for k, n in Counter({(w[0],): c for w, c in want.items() if not w[5]}).items()}) or kept.count() == sum(c for w, c in want.items() if not w[5])


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 40])
def test_ids_that_are_strings_and_ties(spark, docs, rows, block):
    bench = [(f"q{9 - i}", text) for i, text in items(rows)] + [(None, "never heard")]
    table = spark.createDataFrame(bench, "item_id string, text string")
    got = decontaminate.report(docs, table, block_bytes=block).drop("longest_match")
    assert Counter(tuple(r) for r in got.collect()) == judged(rows, bench, 13)
    twice = spark.createDataFrame([("b", rows[41][1]), ("a", rows[41][1]), ("c", rows[41][1])], "item_id string, text string").repartition(3)
    longest = {r["doc_id"]: r["longest_item"] for r in decontaminate.find_matches(docs, twice, block_bytes=block).collect()}
    assert longest[41] == "a" and longest[0] is None


def test_longest_match(spark, docs, rows):
    table = spark.createDataFrame([(1, rows[41][1])], "item_id long, text string")
    longest = {r["doc_id"]: r["longest"] for r in decontaminate.find_matches(docs, table).collect()}
    assert longest[41] == len(rows[41][1].split()) and longest[40] >= 70 and longest[0] == 0


def test_longest_match_against_all_places(spark):
    """Every length from five words on, whatever shards the documents fall in."""
    rng = random.Random(21)
    bench = [(i, sentence(rng, rng.choice([3, 9, 40]), 12)) for i in range(6)]
    data = [(i, sentence(rng, rng.randrange(0, 60), 12)) for i in range(40)] + [(100, bench[2][1] + " " + bench[5][1]), (101, "")]
    cut = [t.split() for _, t in bench]

    def longest(words):
        best = 0
        for item in cut:
            for i in range(len(item)):
                for j in range(len(words)):
                    n = 0
                    while i + n < len(item) and j + n < len(words) and item[i + n] == words[j + n]:
                        n += 1
                    best = max(best, n)
        return best if best >= decontaminate.LEAST else 0

    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = decontaminate.find_matches(table, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["longest"] for r in got} == {d: longest(t.split()) for d, t in data}
    for r in got:
        if r["longest"]:
            part = dict(data)[r["doc_id"]].split()[r["longest_at"] : r["longest_at"] + r["longest"]]
            assert " ".join(part) in dict(bench)[r["longest_item"]]
        else:
            assert r["longest_item"] is None


def test_a_long_item_is_held_once():
    import pickle

    rng = random.Random(2)
    text = sentence(rng, 100_000, 50_000)
    tests = decontaminate.TestSuffixes([(1, text.encode())], 13)
    assert len(pickle.dumps(tests)) < 6_000_000
    words = text.encode().split()
    shard = decontaminate.Shard(tests, [words[500:900], words[:5000]])
    assert shard.hit_spans() == {0: [(0, 400)], 1: [(0, 5000)]}
    assert {k: v[0] for k, v in shard.longest().items()} == {0: 400, 1: 5000}


def test_items_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("_row", F.lit("clash"))
    bench = spark.createDataFrame([(None, text), (None, "other words")], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 10):
        r = decontaminate.report(docs, bench, block_bytes=block).first()
        assert (r["n_hit"], r["n_items"], r["contaminated"]) == (20, 0, True)
        left = decontaminate.remove_contaminated(docs, bench, block_bytes=block)
        assert left.columns == docs.columns and left.count() == 0


def test_empty_benchmark(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).filter("contaminated").count() == 0
    assert decontaminate.report(docs, none).count() == len(rows)
    assert decontaminate.report(no_docs, none).count() == 0


# -- embeddings


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    out = []
    for i in range(120):
        noise = rng.normal(size=16) * rng.choice([0.0, 0.02, 0.05, 0.2])
        out.append((i, [float(np.float32(x)) for x in base[i % 30] + noise], int(i % 30) % 3))
    out += [
        (200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] + [1.0] * 15, 1),
        (204, [None] + [1.0] * 15, 1), (205, [], 1), (206, out[0][1], None), (207, out[0][1], 0), (207, out[0][1], 0),
        (208, [2 * x for x in out[0][1]], 0), (209, out[0][1], 2), (210, [1.0, 2.0], 0), (211, [2.0, 4.0], 0),
    ]
    return out


@pytest.mark.parametrize("recall", [1.0, embedding_dedup.RECALL])
def test_embeddings(spark, recall, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 3)
    data = vectors()
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    usable = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in data]
    links = [set() for _ in data]
    for i, a in enumerate(data):
        for j, b in enumerate(data):
            if i != j and usable[i] and usable[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y >= 0.98 * np.linalg.norm(x) * np.linalg.norm(y):
                    links[i].add(j)
    want = Counter()
    for i, r in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(data[j][0] for j in seen)
        want[(r[0], len(links[i]), least, least == r[0])] += 1
    assert Counter(tuple(r) for r in embedding_dedup.near_duplicates(table, 0.98, recall).collect()) == want


def test_cosines_of_very_large_and_small_vectors(spark):
    data = [(1, [1e200, 0.0]), (2, [1e200, 1e200]), (3, [1e-200, 0.0]), (4, [1e-200, 1e-200]), (5, [3e250, 3e250]), (6, [5e-324, 0.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r)[:3] for r in embedding_dedup.near_duplicates(table).collect())
    assert got == [(1, 2, 1), (2, 2, 2), (3, 2, 1), (4, 2, 2), (5, 2, 2), (6, 2, 1)]


def test_recall_of_some_thousand_vectors(spark):
    """Links found by the traversal against all pairs, with a codebook of more than a few cells."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(900, 24))
    x = np.float32(np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.05, 0.1, 0.15)]))
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table).collect()}
    assert all(got[i] <= links[i] for i in got) and links.sum() > 1000
    assert sum(got.values()) >= 0.9 * links.sum()
    row, one, _ = embedding_dedup.MultiIndex(unit, 0.98, 64, 0.999).visits(unit[:200])
    assert len(np.unique(np.bincount(row))) > 1 and len(one) < 200 * 64 * 64 / 4  # each stops by itself, early


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_links_count_at_both_ends(spark):
    """Pairs of near vectors under a traversal that stops early: what one end finds counts for both."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.982 * x + np.sqrt(1 - 0.982**2) * y
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(1_000 + i, v.tolist(), "a") for i, v in enumerate(y)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table, 0.98, 0.9).collect()}
    assert all(got[i][0] == got[1_000 + i][0] for i in range(700))
    assert 600 < sum(got[i][0] for i in range(700)) < 700
    assert all((got[1_000 + i][1] == i) == (got[i][0] > 0) for i in range(700))
    index = embedding_dedup.fit_index(table.select(F.lit(16).alias("dim"), "embedding", F.xxhash64("label").alias("label"), F.col("vec_id").alias("node")), 0.98, 0.9, len(rows), 16)[16]

    def cells(v):
        return [set(zip(*(a[r == k].tolist() for a in (one, two)), strict=True)) for r, one, two in [index.visits(v)] for k in range(len(v))]

    seen = [cells(v) for v in (x, y)]
    home = [list(zip(*(c.tolist() for c in index.cells(v)), strict=True)) for v in (x, y)]
    one_sided = [i for i in range(700) if (home[1][i] in seen[0][i]) != (home[0][i] in seen[1][i])]
    assert len(one_sided) > 5 and all(got[i][0] == 1 for i in one_sided)


def test_labels_compare_as_they_are(spark):
    v = [0.5, 1.0, 2.0]
    numbers = spark.createDataFrame([(1, v, 1.2), (2, v, 1.7), (3, v, 1.2)], "vec_id long, embedding array<double>, label double")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(numbers).collect()} == {1: 1, 2: 0, 3: 1}
    names = spark.createDataFrame([(1, v, "cat"), (2, v, "dog"), (3, v, "cat"), (4, v, None)], "vec_id long, embedding array<double>, label string")
    assert {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(names).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_multi_sequence_is_in_order():
    rng = np.random.default_rng(0)
    one, two = rng.random(7), rng.random(5)
    got = list(embedding_dedup.multi_sequence(one, two))
    assert [t for *_, t in got] == pytest.approx(sorted((one[:, None] + two).ravel()))
    assert len({(i, j) for i, j, _ in got}) == 35


def test_visits_hold_all_within_the_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.MultiIndex(x, 0.9, 8, 1.0)
    row, one, two = index.visits(x)
    visited = set(zip(row.tolist(), one.tolist(), two.tolist(), strict=True))
    c1, c2 = index.cells(x)
    for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True):
        assert (i, c1[j], c2[j]) in visited


# -- mixing


def test_mixing(docs, rows):
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # share what is left by weight, stop those that are above, again
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]} if total else set()
        if not above:
            break
        for s in above:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in above)
        open_ -= above
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    by_size = {(r[0], r[1]): r[3] for r in rows}
    for r, (doc, text, _, source) in zip(sorted(got, key=lambda r: (repr(r["doc_id"]), r["size"])), sorted(rows, key=lambda r: (repr(r[0]), len(WORD.findall(r[1] or "")))), strict=True):
        assert r["size"] == len(WORD.findall(text or "")) and by_size[(doc, text)] == source
        assert r["target"] == pytest.approx(target[source]) and r["source_size"] == sizes[source]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.report(docs.repartition(7)).collect()), key=repr)


def test_mix_repeats_rows(docs, no_docs):
    copies = Counter()
    for r in mixing.report(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mixing.report(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


# -- chat


def test_chat_reads_back(spark):
    rng = random.Random(6)
    bits = ["\\", "</turn>", "###", "### Assistant: ", "\n", ": ", "\\t", "\\b", "é", "🙂", "x", "</turn", ">", "role="]
    talks = []
    for c in range(40):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "to:ol\\", "", None, "User", "role=x"])
            talks.append((c, turn, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))])))
    talks += [(50, 0, "user", "a"), (50, 0, "user", "a"), (51, None, "assistant", "late"), (51, 3, "user", "q"), (None, 0, "user", "n")]
    table = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    by: dict = {}
    for c, turn, role, text in talks:
        by.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.report(table).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    out = chat.format_conversations(table).collect()
    assert all(len(r["formatted"]) == got[r["conv_id"]]["formatted_chars"] for r in out)


@pytest.mark.parametrize("roles,valid,error", [("su", True, None), ("sua", True, None), ("u", True, None), ("uau", True, None), ("s", False, None), ("uu", False, 2), ("a", False, 1), ("usa", False, 2)])
def test_turn_order(spark, roles, valid, error):
    names = {"s": "system", "u": "user", "a": "assistant"}
    table = spark.createDataFrame([(1, i, names[r], "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(table).first()
    assert (got["valid"], got["error_turn"]) == (valid, error)


def test_chat_is_native(spark):
    table = spark.createDataFrame([(1, 0, "user", "t")], "conv_id long, turn long, role string, text string")
    plan = chat.report(table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.report(table.limit(0)).count() == 0


# -- language


def tongue(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def polyglot(spark):
    rng = random.Random(8)
    data = []
    for i in range(150):
        lang, letters = rng.choice([("aa", "abcde"), ("bb", "xyzéw"), ("cc", "klmno")])
        data.append((i, tongue(rng, letters, rng.randrange(3, 60)), lang))
    data += [(500, None, "aa"), (501, "", "aa"), (502, "12 ½ ²!", "aa"), (503, "abc dead", None), (None, "xyz wé", "bb")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("held_out", F.lit("clash"))


def test_language_held_out(polyglot):
    got = language_id.identify(polyglot).collect()
    truth = {r["doc_id"]: r["lang"] for r in polyglot.collect()}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in held if r["doc_id"] < 500)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {500, 501, 502}
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(truth)
    kept = language_id.keep_identified(polyglot)
    assert kept.columns == polyglot.columns and kept.count() == len(truth) - 3


def test_words_of_switched_text(polyglot):
    field = language_id.fit(language_id.sample_windows(polyglot))
    labels = [lang for _, lang, _ in field.label_words("abcd bade cabe xyzw yéxw zzyx")]
    assert labels == ["aa"] * 3 + ["bb"] * 3


def test_long_runs_are_read_to_their_end(polyglot):
    field = language_id.fit(language_id.sample_windows(polyglot))
    a, b = "abcde" * 8, "xyzéw" * 100
    assert language_id.words_of("".join([a, b])) == [a] + [b[i : i + 40] for i in range(0, 500, 40)]
    assert [lang for _, lang, _ in field.label_words(a + b)] == ["aa"] + ["bb"] * 13
    ((lang, score, words),) = field.predict([a + b])
    assert (lang, words) == ("bb", 14) and score > 0.8


def test_chains_are_cut_without_a_trace(polyglot):
    """Labels of a long text are those of one chain over the whole of it."""
    field = language_id.fit(language_id.sample_windows(polyglot))
    rng = random.Random(3)
    words = " ".join(tongue(rng, rng.choice(["abcde", "xyzéw", "klmno", "abxyk"]), rng.randrange(1, 40)) for _ in range(60)).split()
    assert len(words) > 5 * language_id.CHAIN
    scores = field.word_scores(words)
    whole, _ = language_id.forward_backward(scores.astype(np.float64)[None], np.array([len(words)]), field.start, field.moves)
    assert np.abs(field.posteriors(scores, np.array([len(words)])) - whole[0]).max() < 1e-9
    short = field.posteriors(np.concatenate([scores[:7], scores]), np.array([7, 0, len(words)]))
    assert np.abs(short[7:] - whole[0]).max() < 1e-9


def test_texts_without_spaces(spark):
    """Scripts that do not part words; the two of one alphabet differ beyond the 40th letter only."""
    rng = random.Random(5)
    common = "".join(chr(0x4E00 + rng.randrange(40)) for _ in range(40))
    data = []
    for i in range(120):
        low = 0x5000 if i % 2 else 0x6000
        data.append((i, common + "".join(chr(low + rng.randrange(60)) for _ in range(300)), "zz" if i % 2 else "yy"))
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = [r for r in language_id.identify(table).collect() if r["held_out"]]
    assert len(got) > 20 and all(r["lang_pred"] == data[r["doc_id"]][2] for r in got)


def test_fifty_languages_fit_in_bounded_memory(spark):
    import tracemalloc

    rng = random.Random(6)
    letters = [[chr(0x400 + rng.randrange(900)) for _ in range(6)] for _ in range(50)]
    windows = [(f"l{i % 50:02}", tongue(rng, letters[i % 50], 32).split()) for i in range(3000)]
    tracemalloc.start()
    field = language_id.fit(windows, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(field.labels) == 50 and peak < 500e6
    rows = [(i, " ".join(w), lang) for i, (lang, w) in enumerate(windows[:200])]
    few = language_id.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=120)
    assert 0 < len(few) <= 120 and len({lang for lang, _ in few}) > 40
    assert len({lang for lang, _ in language_id.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=7)}) == 7


def test_expected_moves_against_all_paths():
    rng = np.random.default_rng(4)
    scores, start, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want, total = np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[path[0]] + sum(scores[0, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for a, b in zip(path, path[1:], strict=False):
            want[a, b] += w
    _, got = language_id.forward_backward(np.concatenate([scores, scores]), np.array([4, 1]), start, moves, pairs=True)
    assert got == pytest.approx(want / total)


def test_nothing_to_learn(polyglot):
    blank = polyglot.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(blank).collect()} == {"und"}
    assert language_id.identify(polyglot.limit(0)).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    scores, start, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[path[0]] + sum(scores[0, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            want[t, y] += w
    post, _ = language_id.forward_backward(scores, np.array([4]), start, moves)
    assert post[0] == pytest.approx(want / want.sum(axis=1, keepdims=True))


# -- tokens


def test_special_tokens_in_texts(spark):
    """By default what the library gives for its own strings; as plain text only when asked."""
    from tokenizers import Tokenizer

    texts = ["x <|endoftext|> y", "<|endoftext|>", "a <|endoftext|", "<|endoftext|><|endoftext|> b"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for plain in (False, True):
        tokenizer = Tokenizer.from_file(queries.tokenizer_path())
        if plain:
            tokenizer.encode_special_tokens = True
        ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert any(50256 in x for x in ids) != plain
        got = token_output.report(table, queries.tokenizer_path(), plain_specials=plain).orderBy("start").collect()
        assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]


def test_rows_of_one_doc_id_are_spread(spark, tmp_path):
    table = spark.range(2000).selectExpr("cast(null as long) as doc_id", "'t' || id as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_output.write_token_files(table, f"file://{tmp_path}/ids", queries.tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in token_output.read_documents(spark, f"file://{tmp_path}/ids").groupBy("shard").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_tokens(docs, rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())  # as the library has it
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for r in order:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for kind in (8, 1):
        got = sorted((tuple(r) for r in token_output.report(docs, queries.tokenizer_path(), kind=kind).collect()), key=lambda r: r[1])
        assert got == want
    assert token_output.report(no_docs, queries.tokenizer_path()).count() == 0


def test_files_give_back_the_ids(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_output.write_token_files(docs, path, queries.tokenizer_path(), chunk=500)
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in token_output.read_documents(spark, path).collect())
    encoder = token_output.Encoder(Path(queries.tokenizer_path()).read_text("utf-8"))
    stop = np.array([2], "<u4").tobytes()
    texts = docs.select("doc_id", "text").collect()
    assert got == Counter((r["doc_id"], encoder.encode([r["text"] or ""])[0] + stop) for r in texts)
    starts = [r["chunk_start"] for r in token_output.chunk_starts(spark, path).orderBy("shard", "chunk").collect()]
    assert starts[0] == 0 and starts == sorted(starts) and len(starts) > 3


@pytest.mark.parametrize("kind", [8, 1])
@pytest.mark.parametrize("n", [0, 1, 7, 100, 101, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    assert (token_output.unpack(token_output.pack(ids, kind, block=100)) == ids).all()


def test_pieces_are_the_library_s():
    encoder = token_output.Encoder(Path(queries.tokenizer_path()).read_text("utf-8"), known=50)
    rng = random.Random(9)
    letters = "ab 's\n\t12'.,!éñ¿×÷’“ªº·\u00a0\u3000\u0085ǅ½٣"
    for _ in range(200):
        texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(3)] + ["", "<|endoftext|>"]
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# -- licences


def test_licenses(spark, no_docs):
    mit = dict(license_scan.TEXTS)["MIT"]
    texts = [
        "Copyright (c) 2020 Somebody\n\n" + mit.replace("license", "licence").upper(), mit + " And more.", "x\nReleased under the MIT Licence\ny",
        "licensed under cc-by-nc 4.0", None, "", "Copyright 2001\n(c) x", "SPDX-License-Identifier: MIT",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license_id", F.lit("clash"))
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.scan_licenses(table).collect()}
    assert got == {
        0: ("MIT", "MIT"), 1: (None, ""), 2: (None, "MIT"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), 4: (None, ""), 5: (None, ""), 6: (None, ""),
        7: ("MIT", "MIT"),
    }
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_whole_texts_in_usual_forms(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
    given, texts = dict(license_scan.TEXTS), [("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2014 A B\n\n" + mit)]
    for license_id, title in (("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License")):
        texts.append((license_id, f"{title}\n\nCopyright (c) 2014, A B\nAll rights reserved.\n\n{given[license_id]}"))
    folder = Path(license_scan.__file__).parent / "licenses"
    long = {p.stem: p.read_text("utf-8") for p in folder.glob("*.txt")}
    assert set(long) == {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense"}
    texts += [*long.items(), ("Apache-2.0", long["Apache-2.0"].split("   APPENDIX:")[0]), (None, long["Apache-2.0"][:5000])]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(table).collect()}
    assert got == {i: license_id for i, (license_id, _) in enumerate(texts)}


def rewrapped(rng: random.Random, text: str) -> str:
    """Paragraphs in lines of another width, other case, other marks around words."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        if re.search(r"copyright \(c\)|copyright \[|copyright <|all rights reserved|copyright 2", paragraph.lower()):
            out.append(paragraph)
            continue
        lines, width, line = [], rng.randrange(9, 90), ""
        for word in paragraph.split():
            if line and len(line) + len(word) >= width:
                lines.append(line)
                line = ""
            line = f"{line} {word}" if line else word
        out.append("\n".join([*lines, line]))
    joined = "\n\n".join(out)
    return rng.choice([str.lower, str, str])(joined).replace('"', rng.choice(['"', "'", "“"])).replace(",", rng.choice([",", " ,"]))


def test_texts_in_any_wrapping(spark):
    """A line may begin with any word of a licence, "copyright" included."""
    rng = random.Random(13)
    folder = Path(license_scan.__file__).parent / "licenses"
    whole = [*license_scan.TEXTS, *((p.stem, p.read_text("utf-8")) for p in sorted(folder.glob("*.txt")))]
    texts = []
    for license_id, text in whole:
        for head in ("", "Copyright (c) 1999-2024, A. Person <a@b.c>\nAll rights reserved.\n\n", "© 2020 B\n\n", "(c) 2011 C\n\n", "Copyright 2001 D\n\n"):
            texts += [(license_id, head + rewrapped(rng, text)) for _ in range(3)]
    for license_id, at in (("BSD-3-Clause", "copyright notice, this"), ("MIT", "COPYRIGHT HOLDERS BE")):
        texts.append((license_id, dict(license_scan.TEXTS)[license_id].replace(at, "\n" + at)))
    texts += [(None, dict(license_scan.TEXTS)["MIT"].replace("copyright notice", "notice")), (None, "copyright notice\n" + dict(license_scan.TEXTS)["MIT"])]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(table).collect()}
    assert [(i, want, got[i]) for i, (want, _) in enumerate(texts) if got[i] != want] == []


def normal_by_hand(text: str) -> str:
    """The normal form word by word, from its description and not from the operator's patterns."""
    words: list[str] = []
    for line in lower(text).split("\n"):
        bare = line.lstrip(" \t#*/;>-")
        if bare.startswith("copyright"):
            behind = bare[9:].lstrip(" \t:,")
            notice = behind[:3] == "(c)" or behind[:1] in ("©", "<", "[", "{") or behind[:3] == "by " or (len(behind) > 3 and all(c in "0123456789" for c in behind[:4]))
        else:
            behind = bare[3:].lstrip(" \t") if bare.startswith("(c)") else ""
            year = len(behind) > 3 and all(c in "0123456789" for c in behind[:4])
            notice = year or behind.startswith("copyright") or bare.startswith(("©", "all rights reserved"))
        if not notice:
            fold = "".join(" " if (ord(c) < 128 and not c.isalnum()) or c in "\u00a0«»" or "‐" <= c <= "‧" or "‰" <= c <= "⁞" else c for c in line)
            words += fold.split(" ")
    same = {"organisation": "organization", "whilst": "while", "https": "http"}
    out = " " + " ".join(w for w in words if w) + " "
    for a, b in same.items():
        out = out.replace(f" {a}", f" {b}")
    return out.replace(" licence", " license").replace(" sublicence", " sublicense").replace(" sub license", " sublicense").replace(" non commercial", " noncommercial").replace(" per cent", " percent").strip()


def test_normal_form_against_one_by_hand(spark):
    rng = random.Random(14)
    bits = ["Copyright", "copyright notice", "(c)", "2019", "©", "Licence", "sub-licence", "sub license", "All rights reserved.", "non-commercial", "organisation", "whilst", "https://x", "«a»", "per cent", "\n", "\n", " * ", "A-b", "é", "–", "3.", "by me", "[yyyy]"]
    texts = ["".join(rng.choice(["", " "]) + rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["digest"] for r in license_scan.scan_licenses(table).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != hashlib.md5(normal_by_hand(t).encode()).hexdigest()] == []


def test_every_notice_can_be_looked_up(spark):
    known = spark.createDataFrame(list(license_scan.NOTICES), "license_id string, text string")
    assert known.select(license_scan._spelled(F.col("text")).alias("x")).filter("not x").count() == 0


# -- shared parts and the whole


def test_components_of_random_graphs(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    nodes = {n for e in edges if None not in e and e[0] != e[1] for n in e}
    table = spark.createDataFrame(edges, "u long, v long").repartition(6)
    assert {tuple(r) for r in connected_components(table).collect()} == {(n, find(n)) for n in nodes}
    assert connected_components(table.limit(0)).count() == 0


def test_bloom_loses_nothing(spark):
    keys = spark.range(1000).selectExpr("id * 7919 - 500000 as k")
    bloom = build_bloom(keys, 1000)
    own = np.array([r["k"] for r in keys.collect()])
    assert bloom.may_hold(own).all()
    assert bloom.may_hold(np.arange(10**6, 10**6 + 10_000)).mean() < 0.05


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]


def test_pipeline_against_its_parts(spark, tmp_path):
    """Every stage by brute force on a small folder of tables."""
    rng = random.Random(12)
    base, leaked = sentence(rng, 120), sentence(rng, 40)
    docs = [(i, sentence(rng, 30), "en", f"s{i % 2}", 1) for i in range(30)]
    docs += [(40, base, "en", "s0", 1), (41, base, "en", "s0", 1), (42, base + " end", "en", "s0", 1), (43, leaked + " " + sentence(rng, 20), "en", "s1", 1), (44, "12 !", "en", "s1", 1), (45, None, "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    path, kept = str(tmp_path / "documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = str(tmp_path / f"stage{k}")
        stage(spark, spark.read.parquet(path), str(tmp_path)).write.parquet(out)
        kept[name] = Counter(r["doc_id"] for r in spark.read.parquet(out).collect())
        assert spark.read.parquet(out).columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = out
    every = set(range(30)) | {40, 41, 42, 43}
    assert set(kept["language_id"]) == every
    assert set(kept["ngram_jaccard_join"]) == every - {41, 42}
    assert set(kept["benchmark_decontamination"]) == every - {41, 42, 43}
    assert set(kept["source_mixing"]) <= every - {41, 42, 43}
    final = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter(r["doc_id"] for r in final.collect())
    assert got == kept["source_mixing"]


def test_notices_without_usual_words_are_found(spark):
    """Known texts are looked up whatever words they hold, also where a spelling makes them."""
    known = (("A", "Use it for good, never for evil."), ("B", "Whilst you live, organisation matters"), ("C", "Version 2"), ("D", "Share alike under this licence."))
    texts = ["x\n  USE it for good -- never for EVIL!\ny", "while you live organization matters", "a\nv2\nver 2\nv3", "share alike under this LICENSE", "nothing", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notices"]) for r in license_scan.scan_licenses(docs, known).collect()}
    assert got == {0: (None, "A", 1), 1: ("B", "B", 1), 2: (None, "C", 2), 3: ("D", "D", 1), 4: (None, "", 0), 5: (None, "", 0)}
    assert license_scan.scan_licenses(docs, ()).filter("license_id is not null or n_notices > 0").count() == 0


def test_pieces_stand_in_every_known_text(spark):
    known = license_scan.KNOWN + license_scan.usual_forms()
    forms = [r["form"] for r in license_scan.known_digests(spark, known).collect()]
    pieces = license_scan.anchors(forms)
    assert pieces and len(pieces) < 12 and all(any(p in text.lower() for p in pieces) for _, text in known)
    assert license_scan.anchors(["version 2", "while organization"]) is None and license_scan.anchors([]) == ()
