"""Embedding near-dedup with an inverted multi-index.

Independent codebooks on the two halves of the unit vectors form a product grid of
cells. A vector visits cells nearest first, by the multi-sequence traversal over its two
lists of half distances, and stops by itself once the cells it has seen hold the target
share of what can be near it; what it meets there is verified by cosine in double
precision. Equal vectors of one label are one node, so copies are not expanded; a cell
with very many vectors is a grid of parts, in which each visitor meets each stored
vector once.

The codebooks grow with the number of vectors (up to ``MOST_CENTRES`` a half) and are
fitted on a bounded sample (``SAMPLE`` to ``MOST_SAMPLE`` vectors, ``SAMPLE_NUMBERS``
components); all vectors are indexed. When a traversal has seen enough is calibrated on
the sample: neighbours at exactly the threshold are drawn in random directions, and the
share of them in cells up to a distance bound says how far the target recall reaches.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, column, materialize, prepare, tidy
from .components import connected_components

SAMPLE, MOST_SAMPLE = 20_000, 65_536
MOST_CENTRES = 4_096
#: Components of all vectors in the sample and in the calibration (8 bytes each).
SAMPLE_NUMBERS = 4_000_000
RECALL = 0.999
#: Stored vectors of a part of a cell, of which a cell has so many a side at most; then parts grow
#: up to the largest, beyond which there are more of them again.
CELL, SIDES, LARGEST = 1_024, 16, 16_384
#: Centres nearest to a vector whose bisectors bound its distance to a cell.
NEAREST = 16
#: Cells with parts (some 24 bytes each) up to which their table is broadcast; beyond, joined.
BROADCAST_CELLS = 100_000


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(d, 0)


def _nearest(x: np.ndarray, centres: np.ndarray, rows: int = 2_048) -> np.ndarray:
    """Number of the centre nearest to each vector, some rows at a time."""
    parts = [_distances(x[i : i + rows], centres).argmin(axis=1) for i in range(0, len(x), rows)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a fixed start; empty clusters keep their centre."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(5).choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class MultiIndex:
    """Codebooks of the halves, and when a traversal has reached its recall."""

    def __init__(self, sample: np.ndarray, cosine: float, k: int, recall: float) -> None:
        half = sample.shape[1] // 2
        self.halves = (slice(0, half), slice(half, None))
        self.books = [fit_codebook(sample[:, h], k) for h in self.halves]
        most = 2 - 2 * cosine
        if recall >= 1:
            self.reach = most + 1e-9
            return
        rng = np.random.default_rng(11)
        x = sample[rng.integers(0, len(sample), max(1, min(SAMPLE, SAMPLE_NUMBERS // sample.shape[1])))]
        y = rng.normal(size=x.shape)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        y = cosine * x + np.sqrt(1 - cosine * cosine) * y / np.where(norm > 0, norm, 1)
        apart = []
        for i in range(0, len(x), 1_024):
            own, bounds = self.cells(y[i : i + 1_024]), self.bounds(x[i : i + 1_024])
            rows = np.arange(len(own[0]))
            apart.append(bounds[0][rows, own[0]] + bounds[1][rows, own[1]])
        #: The bound of a cell at which cells up to it hold the target share of neighbours.
        self.reach = min(most + 1e-9, float(np.quantile(np.concatenate(apart), recall)) + 1e-9)

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        return [_nearest(x[:, h], c) for h, c in zip(self.halves, self.books, strict=True)]

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """By half and centre: the least squared distance to anything in that cell.

        Vectors of a cell lie beyond the bisector of its centre and any other centre; of
        those the bisectors with the centres nearest to x are looked at.
        """
        out = []
        for h, c in zip(self.halves, self.books, strict=True):
            d = _distances(x[:, h], c)
            few = min(NEAREST, len(c))
            near = np.argpartition(d, few - 1, axis=1)[:, :few]
            best, rows = np.zeros_like(d), np.arange(len(x))
            for k in near.T:
                gap = np.sqrt(np.maximum(_distances(c[k], c), 1e-300))
                best = np.maximum(best, (d - d[rows, k][:, None]) / (2 * gap))
            out.append(best * best)
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell of half one, cell of half two), its own cell included: each row's
        traversal, from the nearest cell on until it has reached the recall."""
        one, two = self.bounds(x)
        own = self.cells(x)
        rows = np.arange(len(x))
        one[rows, own[0]] = two[rows, own[1]] = 0
        row: list[int] = []
        first: list[int] = []
        second: list[int] = []
        for r in range(len(x)):
            for i, j, apart in multi_sequence(one[r], two[r], self.reach):
                if apart > self.reach:
                    break
                row.append(r)
                first.append(i)
                second.append(j)
        return np.array(row, np.int64), np.array(first, np.int64), np.array(second, np.int64)


def multi_sequence(one: np.ndarray, two: np.ndarray, most: float = np.inf) -> Iterator[tuple[int, int, float]]:
    """Pairs (i, j) of two lists of half distances in ascending order of their sum; halves
    that alone are beyond most are not looked at."""
    lists = []
    for d in (one, two):
        at = np.flatnonzero(d <= most)
        at = at[np.argsort(d[at], kind="stable")]
        lists.append((at.tolist(), d[at].tolist()))
    (a, da), (b, db) = lists
    heap = [(da[0] + db[0], 0, 0)] if a and b else []
    while heap:
        total, i, j = heapq.heappop(heap)
        yield a[i], b[j], total
        if j + 1 < len(b):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if not j and i + 1 < len(a):  # a row is opened by the row before it, so no pair comes twice
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def _usable(embedding: Column) -> Column:
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return embedding.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False))


def _vectors(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension as they are, and as unit vectors."""
    x = np.array(column(batch, name), np.float64)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return x, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _cell_sizes(nodes: DataFrame, index: dict[int, MultiIndex]) -> DataFrame:
    """Vectors by label, dimension and cell; counted before the shuffle."""
    shared = nodes.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("one", pa.int32()), ("two", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                at = shared.value.get(int(dim))
                label = own.column(own.schema.get_field_index("label"))
                cells = at.cells(_vectors(own, "embedding")[1]) if at else [np.zeros(own.num_rows)] * 2
                one, two = (pa.array(c.astype(np.int32)) for c in cells)
                many = pa.array(np.full(own.num_rows, dim, np.int32))
                yield pa.RecordBatch.from_arrays([label, many, one, two], schema=schema)

    cells = nodes.select("label", "dim", "embedding").mapInArrow(tidy(scan), "label long, dim int, one int, two int")
    return cells.groupBy("label", "dim", "one", "two").count()


def cell_code(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """One number for a cell."""
    return one.astype(np.int64) << 32 | two.astype(np.int64)


def _visit_rows(nodes: DataFrame, index: dict[int, MultiIndex]) -> DataFrame:
    """Rows of nodes at the cells they visit; in their own they are also stored.

    home: the node's own cell. seen: where it is stored, all cells it visits, ascending.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema(
        [("node", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("one", pa.int32()), ("two", pa.int32()),
         ("stored", pa.bool_()), ("copies", pa.int64()), ("vector", pa.binary()), ("home", pa.int64()), ("seen", pa.binary())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x, unit = _vectors(own, "embedding")
                single = x.astype(np.float32)  # half the bytes where nothing is lost
                raw = [v.tobytes() for v in (single if (single == x).all() else x)]
                node, label, copies = (own.column(own.schema.get_field_index(c)).to_numpy() for c in ("node", "label", "copies"))
                at = shared.value.get(int(dim))
                if at is None:  # a dimension the sample had none of: one cell
                    row = np.arange(len(x))
                    one = two = home = np.zeros(len(x), np.int64)
                    stored = np.ones(len(x), bool)
                else:
                    row, one, two = at.visits(unit)
                    home = cell_code(*at.cells(unit))
                    stored = cell_code(one, two) == home[row]
                ends = np.searchsorted(row, np.arange(len(x) + 1))
                visited = cell_code(one, two)
                seen = [np.sort(visited[ends[r] : ends[r + 1]]).tobytes() if s else None for r, s in zip(row.tolist(), stored.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[row]), pa.array(label[row].astype(np.int64)), pa.array(np.full(len(row), dim, np.int32)),
                     pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(stored),
                     pa.array(copies[row]), pa.array([raw[r] for r in row], pa.binary()), pa.array(home[row].astype(np.int64)),
                     pa.array(seen, pa.binary())], schema=schema
                )

    shape = "node long, label long, dim int, one int, two int, stored boolean, copies long, vector binary, home long, seen binary"
    return nodes.mapInArrow(tidy(scan), shape)


def _numbers(raw: bytes, dim: int) -> np.ndarray:
    """The vector divided by a power of two near its largest component: products stay in range
    and no digit is lost."""
    x = np.frombuffer(raw, np.float64 if len(raw) == 8 * dim else np.float32).astype(np.float64)
    return np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0))[1]))


class CellPart:
    """Stored vectors of one part of a cell; what visitors link with."""

    def __init__(self, cosine: float, dim: int, code: int) -> None:
        self.cosine, self.dim, self.code = cosine, dim, code
        self.names: list[int] = []
        self.copies: list[int] = []
        self.vectors: list[bytes] = []
        self.seen: list[np.ndarray] = []
        self.ready = False

    def store(self, node: int, copies: int, vector: bytes, seen: bytes) -> None:
        self.names.append(node)
        self.copies.append(copies)
        self.vectors.append(vector)
        self.seen.append(np.frombuffer(seen, np.int64))

    def visit(self, visitors: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, int]]:
        """visitors: node, copies, vector, own cell. Gives (node, copies it links with, one of them).

        A stored vector that does not visit the cell of a visitor it links with has the
        link counted here as well, since its own visits do not meet it. Rows that count
        nothing are edges to one member of each further component of the stored vectors
        a visitor links with.
        """
        if not self.names or not visitors:
            return []
        if not self.ready:
            self.x = np.stack([_numbers(v, self.dim) for v in self.vectors])
            self.norm = np.linalg.norm(self.x, axis=1)
            self.node, self.weight = np.array(self.names), np.array(self.copies)
            self.comp = np.arange(len(self.x))
            self.vectors, self.ready = [], True
        q = np.stack([_numbers(v, self.dim) for _, _, v, _ in visitors])
        near = q @ self.x.T >= self.cosine * np.linalg.norm(q, axis=1)[:, None] * self.norm
        out = []
        back: dict[int, list[int]] = {}
        for (node, copies, _, home), row in zip(visitors, near, strict=True):
            at = np.flatnonzero(row)
            at = at[self.node[at] != node]
            if not len(at):
                continue
            roots, first = np.unique(self.comp[at], return_index=True)
            out.append((node, int(self.weight[at].sum()), int(self.node[at[first[0]]])))
            if len(roots) > 1:
                out += [(node, 0, int(self.node[at[k]])) for k in first[1:]]
                self.comp[np.isin(self.comp, roots)] = roots[0]
            if home != self.code:
                for k in at.tolist():
                    place = np.searchsorted(self.seen[k], home)
                    if place == len(self.seen[k]) or self.seen[k][place] != home:
                        found = back.setdefault(k, [0, node])
                        found[0] += copies
        return out + [(int(self.node[k]), copies, node) for k, (copies, node) in back.items()]


def _verify(cosine: float, together: int = 512) -> Callable:
    """Rows of one cell part, stored ones first: links of each visitor, and edges."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    cell = ("label", "dim", "one", "two", "part")

    def rows_of(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, visitors = None, CellPart(cosine, 0, 0), []
        for batch in batches:
            keys = zip(*(column(batch, c) for c in cell), strict=True)
            own = (column(batch, c) for c in ("stored", "node", "copies", "home", "seen"))
            for key, stored, node, copies, home, seen, vector in zip(keys, *own, binary_column(batch, "vector"), strict=True):
                if key != now or len(visitors) >= together:
                    yield rows_of(part.visit(visitors))
                    visitors = []
                if key != now:
                    now, part = key, CellPart(cosine, key[1], key[2] << 32 | key[3])
                if stored:
                    part.store(node, copies, vector, seen)
                else:
                    visitors.append((node, copies, vector, home))
        yield rows_of(part.visit(visitors))

    return scan


def fit_index(nodes: DataFrame, cosine: float, recall: float, count: int, widest: int) -> dict[int, MultiIndex]:
    """An index for each dimension in a sample of vectors, taken by hash: at most MOST_SAMPLE
    of them, and at most SAMPLE_NUMBERS components."""
    k = min(MOST_CENTRES, 1 << max(2, round(np.log2(max(1.0, count / 50)) / 2)))
    size = max(1, min(max(SAMPLE, min(16 * k, MOST_SAMPLE)), SAMPLE_NUMBERS // max(1, widest)))
    rows = nodes.select("dim", "embedding").orderBy(F.xxhash64("label", "embedding"), "node").limit(size)
    by_dim: dict[int, list] = {}
    for row in rows.toLocalIterator():
        by_dim.setdefault(row["dim"], []).append(row["embedding"])
    out = {}
    for dim, vectors in by_dim.items():
        x = np.array(vectors, np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if dim > 1:
            out[dim] = MultiIndex(x, cosine, k, recall)
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98, recall: float = RECALL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels (of any type, known by a 64-bit hash) are equal
    and not null and they have as many components; vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing. n_links counts the other rows linked directly (found
    from either end with cosine >= the threshold, none below); component_id is the smallest vec_id
    reachable by links, itself included; kept says whether that is the row's own.
    Repeated rows count as vectors of their own; other columns are not looked at; an
    empty table gives no rows.
    """
    prepare(embeddings.sparkSession)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"), "embedding"
    )
    usable = F.col("label").isNotNull() & _usable(F.col("embedding"))
    names = F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("again"), "embedding", "label").alias("h2")
    rows = rows.select("vec_id", "label", "embedding", *[F.when(usable, h).alias(n) for h, n in zip(names, ("h1", "h2"), strict=True)])
    nodes = materialize(
        rows.filter("h1 is not null")
        .groupBy("h1", "h2")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"),
             F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    size = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("widest")).first()
    index = fit_index(nodes, cosine, recall, size["n"], size["widest"] or 1)
    cell = ["label", "dim", "one", "two"]
    sides = F.ceil(F.col("count") / CELL)
    sides = F.when(sides <= SIDES, sides).otherwise(F.greatest(F.lit(SIDES), F.ceil(F.col("count") / LARGEST)))
    parts = _cell_sizes(nodes, index).filter(F.col("count") > CELL)
    parts = materialize(parts.select(*cell, sides.cast("int").alias("sides")), "cells")
    placed, n_large = _visit_rows(nodes, index), parts.count()
    if n_large:
        placed = placed.join(F.broadcast(parts) if n_large <= BROADCAST_CELLS else parts, cell, "left")
    else:
        placed = placed.withColumn("sides", F.lit(1))
    spread = placed.withColumn("sides", F.coalesce("sides", F.lit(1)))
    own, side = F.pmod(F.xxhash64("node"), F.col("sides").cast("long")).cast("int"), F.col("sides")
    every = F.sequence(F.lit(0), F.col("sides") - 1)  # stored: one row of the grid; visitor: one column
    visits = F.transform(every, lambda s: F.struct(F.lit(False).alias("stored"), (s * side + own).alias("part")))
    stays = F.transform(every, lambda s: F.struct(F.lit(True).alias("stored"), (own * side + s).alias("part")))
    rows_at = F.when(F.col("stored"), F.concat(stays, visits)).otherwise(visits)
    dealt = spread.withColumn("at", F.explode(rows_at)).select(
        "node", *cell, "copies", "vector", "home", F.when(F.col("at.stored"), F.col("seen")).alias("seen"), "at.stored", "at.part"
    )
    dealt = dealt.repartition(*cell, "part").sortWithinPartitions(*cell, "part", F.desc("stored"), "node")
    found = materialize(dealt.mapInArrow(tidy(_verify(cosine)), "node long, links long, other long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = nodes.select("node", "h1", "h2", "copies", "least").join(roots, nodes["node"] == roots["id"], "left")
    named = named.join(links, "node", "left").select(
        "h1", "h2", "least", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(whole, "root").select("h1", "h2", "n_links", "component_id")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
