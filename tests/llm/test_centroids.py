"""Centroid clustering against plain rounds that measure every distance."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import centroids

from .conftest import CLASHING


def plain(rows, k, rounds, seed, dim) -> Counter:
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e):
            kept.append((vec_id, [int(np.floor(1024 * c)) for c in e]))
    named = [v for v in kept if v[0] is not None]
    starts = sorted(named, key=lambda v: (hashlib.sha256(f"{seed}:{v[0]}".encode()).hexdigest(), v[1]))[:k]
    centres = [v[1] for v in starts]
    if not centres:
        return Counter()

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centres)):
            members = [x for (_, x), (a, _) in zip(kept, own, strict=True) if a == c]
            if members:
                centres[c] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    own = assign()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    by = Counter()
    for c, d in own:
        by[c] += d
    return Counter((v, c, d, by[c], sum(by.values()), digests[c]) for (v, _), (c, d) in zip(kept, own, strict=True))


def vectors(n: int, dim: int) -> list[tuple]:
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, list(rows[7][1])) for i in range(40)]  # a group of copies
    rows += [(3, list(rows[3][1])), (3, [0.5] * dim), (None, [0.25] * dim), (900, None), (901, []), (902, [1.0] * (dim - 1))]
    rows += [(903, [float("nan")] + [1.0] * (dim - 1)), (904, [float("inf")] * dim), (905, [None] + [0.0] * (dim - 1)), (906, [0.0] * dim), (907, [-7.5] * dim)]
    return rows


def table(spark, rows):
    shape = "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in (*CLASHING, "x", "own", "cluster", "sums"))
    return spark.createDataFrame([(v, e, 1) + ("clash",) * (len(CLASHING) + 4) for v, e in rows], shape).repartition(3)


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (1, 3), (20, 4), (8, 0)])
def test_against_plain_rounds(spark, k, rounds):
    dim, rows = 6, vectors(150, 6)
    single = [(v, None if e is None else [None if c is None else float(np.float32(c)) for c in e]) for v, e in rows]
    got = centroids.report(table(spark, rows), k=k, rounds=rounds, seed=3, dim=dim)
    assert Counter(tuple(r) for r in got.collect()) == plain(single, k, rounds, 3, dim)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, 1.5]), (2, [0.25, -1.0])]
    assert Counter(tuple(r) for r in centroids.report(table(spark, rows), dim=2).collect()) == plain(rows, 8, 10, 3, 2)
    assert centroids.report(table(spark, rows), dim=3).count() == 0
    assert centroids.report(table(spark, rows).limit(0), dim=2).collect() == []
    assert centroids.report(table(spark, [(None, [0.5, 1.5])]), dim=2).collect() == []


def test_components_beyond_the_bound_count_as_it(spark):
    most = centroids.most_component(2)
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1e29, 1.0])]
    got = {r["vec_id"]: r["distance"] for r in centroids.report(table(spark, rows), k=2, rounds=1, dim=2).collect()}
    assert set(got) == {1, 2, 3} and max(got.values()) < 2**63 and most < 2**31


@pytest.mark.parametrize("b", [1, 2, 5, 11])
def test_bounds_never_miss_a_nearer_centre(b):
    rng = np.random.default_rng(b)
    x = rng.integers(-6, 6, (400, 3))  # many ties
    centres = rng.integers(-6, 6, (12, 3))
    bounds = centroids.Bounds.measured(x, centres, b)
    for step in range(30):
        d = centroids.squared(x, centres)
        assert (bounds.own == d.argmin(axis=1)).all()
        assert (bounds.up**2 >= d.min(axis=1) * (1 - 1e-9)).all()
        new = centres + rng.integers(-1, 2, centres.shape) * (rng.random(centres.shape) < 0.3)
        bounds.move(np.sqrt(((new - centres) ** 2).sum(axis=1)) * (1 + centroids.EPS))
        centres = new
        if step == 10:
            bounds.keep(max(1, b // 2))
        bounds.settle(x, centres)


def test_bounds_save_distances(monkeypatch):
    rng = np.random.default_rng(0)
    hubs = rng.integers(-9_000, 9_000, (16, 8))
    x = hubs[rng.integers(0, 16, 2_000)] + rng.integers(-300, 300, (2_000, 8))
    centres = hubs + 50
    bounds = centroids.Bounds.measured(x, centres, 4)
    calls = []
    monkeypatch.setattr(centroids, "squared", lambda *a: calls.append(a) or None)
    bounds.move(np.full(16, 3.0))
    assert bounds.settle(x, centres) == 0 and not calls


def test_wide_components_stay_exact():
    most = centroids.most_component(64)
    x = np.array([[most] * 64, [-most] * 64], np.int64)
    assert centroids.squared(x, x[1:])[0, 0] == sum((2 * most) ** 2 for _ in range(64))
