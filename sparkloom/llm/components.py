"""Connected components of a graph given as edges, without the driver or one task.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014); every round is written to the shared folder, so the
lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import column, drop_materialized, materialize, prepare, tidy


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True

    def stars(self) -> list[tuple]:
        """(member, root) for every member but the roots."""
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


#: Members after which a task hands on what it has merged so far.
_HELD = 1_000_000


def edge_rows(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind)], names=["u", "v"]
    )


def _contract(kind: pa.DataType) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(column(batch, "u"), column(batch, "v"), strict=True):
                forest.union(a, b)
            if len(forest.parent) > _HELD:
                yield edge_rows(forest.stars(), kind)
                forest = Forest()
        yield edge_rows(forest.stars(), kind)

    return scan


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (id, root): every node's smallest node. Nodes are longs or binary names.

    Edges with a null end are ignored; loops and repeats are allowed; no edges give no
    rows. Only nodes with an edge to another node get a row.
    """
    prepare(edges.sparkSession)
    kind, node = ("binary", pa.binary()) if edges.schema["u"].dataType == BinaryType() else ("long", pa.int64())
    clean = edges.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"))
    clean = clean.filter("u is not null and v is not null and u <> v")
    now = materialize(clean.mapInArrow(tidy(_contract(node)), f"u {kind}, v {kind}").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        following = materialize(small.distinct(), "edges")
        was, state = state, _state(following)
        drop_materialized(now)
        now = following
        if state == was:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
