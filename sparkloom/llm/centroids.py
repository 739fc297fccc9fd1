"""Centroid clustering with Drake's adaptive bounds, in exact integers.

Every vector keeps its centroid with an upper bound of its distance, the next few nearest
centroids each with a lower bound, and one remainder bound for all others. When centroids
move, bounds move with them; a vector is looked at again only where its upper bound
reaches one of its lower bounds, and then only the centroids up to the last such bound
are measured exactly. Where even the remainder bound is reached, all centroids are. The
number of bounds starts at a quarter of the centroids and shrinks, down to an eighth, to
the most that any vector needed in a round.

Components are integers, so distances, sums and centroids are exact and do not depend on
the order of rows. Bounds are doubles with a margin far above their rounding: a vector
stays unmeasured only when its centroid is nearest without a tie.

A round is one pass: tasks read the vectors with their bounds, write them with the new
ones to the shared folder, and add a row of sums for each centroid to the same table.
Only these, added up by centroid and component, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, column, drop_materialized, materialize, prepare, tidy

#: Relative margin of the bounds.
EPS = 1e-12
SCALE = 1_024


def most_component(dim: int) -> int:
    """Components beyond this count as it, so that squared distances fit in 64 bits: some 1.9e8 for 64."""
    return isqrt((1 << 61) // max(1, dim))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(centres).max(initial=0))
    if x.shape[1] * reach * reach < 1 << 52:  # every sum is exact in doubles
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * a @ c.T + (c * c).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(centres)), np.int64)
    for k, c in enumerate(centres):
        gap = x - c
        out[:, k] = (gap * gap).sum(axis=1)
    return out


def squared_to(x: np.ndarray, centres: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to its own list of centres."""
    out = np.empty(which.shape, np.int64)
    for j in range(which.shape[1]):
        gap = x - centres[which[:, j]]
        out[:, j] = (gap * gap).sum(axis=1)
    return out


class Bounds:
    """Of some vectors: centroid, upper bound, near centroids with lower bounds, remainder bound."""

    def __init__(self, own: np.ndarray, up: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> None:
        self.own, self.up, self.near, self.low, self.rest = own, up, near, low, rest

    @classmethod
    def measured(cls, x: np.ndarray, centres: np.ndarray, b: int) -> Bounds:
        """All distances, nearest first; ties go to the smaller number."""
        d = squared(x, centres)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        rest = root[:, 1 + b] if root.shape[1] > 1 + b else np.full(len(x), np.inf)
        return cls(order[:, 0], root[:, 0] * (1 + EPS), order[:, 1 : 1 + b], root[:, 1 : 1 + b] * (1 - EPS), rest * (1 - EPS))

    def keep(self, b: int) -> None:
        """The first b lower bounds; the others go into the remainder."""
        if self.near.shape[1] > b:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(axis=1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]

    def move(self, moved: np.ndarray) -> None:
        """Centroids have moved by so much."""
        self.up = (self.up + moved[self.own]) * (1 + EPS)
        self.low = self.low - moved[self.near] - EPS * (np.abs(self.low) + moved[self.near])
        most = moved.max(initial=0)
        self.rest = self.rest - most - EPS * (np.where(np.isinf(self.rest), 0, np.abs(self.rest)) + most)

    def settle(self, x: np.ndarray, centres: np.ndarray) -> int:
        """Assign again what the bounds do not certify; the number of bounds that one vector needed at most."""
        b = self.near.shape[1]
        ends = np.concatenate([self.low, self.rest[:, None]], axis=1)
        ends = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]  # the least from each bound on
        open_ = np.flatnonzero(~(self.up < ends[:, 0]))
        if not len(open_):
            return 0
        exact = squared_to(x[open_], centres, self.own[open_, None])[:, 0]
        self.up[open_] = np.sqrt(exact.astype(np.float64)) * (1 + EPS)
        reached = (self.up[open_, None] >= ends[open_]).sum(axis=1)
        for c in range(1, b + 1):
            at = open_[reached == c]
            if not len(at):
                continue
            which = np.sort(np.concatenate([self.own[at, None], self.near[at, :c]], axis=1), axis=1)
            d = squared_to(x[at], centres, which)
            order = np.argsort(d, axis=1, kind="stable")
            which = np.take_along_axis(which, order, axis=1)
            root = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
            self.own[at], self.up[at] = which[:, 0], root[:, 0] * (1 + EPS)
            self.near[at, :c], self.low[at, :c] = which[:, 1:], root[:, 1:] * (1 - EPS)
        at = open_[reached > b]
        if len(at):
            new = Bounds.measured(x[at], centres, b)
            self.own[at], self.up[at], self.near[at], self.low[at], self.rest[at] = new.own, new.up, new.near, new.low, new.rest
        return int(reached.max(initial=0))


def _usable(embedding: Column, dim: int) -> Column:
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dim) & ~odd, F.lit(False))


def integer_vectors(embeddings: DataFrame, dim: int = 64) -> DataFrame:
    """(vec_id, x array<int>): floor(1024 * component) of vectors of dim finite components."""
    most = float(most_component(dim))
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    x = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c, F.lit(most)), F.lit(-most)) * SCALE), F.lit(int(most))), F.lit(-int(most))).cast("int"))
    return rows.filter(_usable(F.col("embedding"), dim)).select("vec_id", x.alias("x"))


def start_centres(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order; ids that repeat are ordered by vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.filter("vec_id is not null").orderBy(name, "x").limit(k)
    return np.array([r["x"] for r in first.collect()], np.int64)


_STATE = (
    "vec_id long, x binary, own int, up double, near binary, low binary, rest double, cluster int, n long, sums array<long>, used int, measured long"
)
_SCHEMA = pa.schema(
    [("vec_id", pa.int64()), ("x", pa.binary()), ("own", pa.int32()), ("up", pa.float64()), ("near", pa.binary()), ("low", pa.binary()),
     ("rest", pa.float64()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("used", pa.int32()), ("measured", pa.int64())]
)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    if pa.types.is_binary(x.type):
        return np.frombuffer(b"".join(x.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
    return np.asarray(x.flatten()).reshape(-1, dim).astype(np.int64)


def _bounds(batch: pa.RecordBatch) -> Bounds:
    own, up, rest = (np.array(batch.column(batch.schema.get_field_index(c))) for c in ("own", "up", "rest"))
    rows = batch.num_rows
    near = np.frombuffer(b"".join(binary_column(batch, "near")), np.int32).reshape(rows, -1)
    low = np.frombuffer(b"".join(binary_column(batch, "low")), np.float64).reshape(rows, -1)
    return Bounds(own.astype(np.int64), up, near.astype(np.int64), low.copy(), rest)


def _pack(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def assign_round(state: DataFrame, centres: np.ndarray, moved: np.ndarray | None, b: int) -> DataFrame:
    """The state after one assignment (all measured where moved is None), and the rows of sums."""
    shared = state.sparkSession.sparkContext.broadcast((centres, moved))
    k, dim = centres.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, moved = shared.value
        sums, counts, used = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            if not (rows := batch.num_rows):
                continue
            x = _vectors(batch, dim)
            if moved is None:
                bounds = Bounds.measured(x, centres, b)
            else:
                bounds = _bounds(batch)
                bounds.keep(b)
                bounds.move(moved)
                used = max(used, bounds.settle(x, centres))
            share = np.zeros((rows, k))
            share[np.arange(rows), bounds.own] = 1
            sums += (share.T @ x).astype(np.int64)  # exact: a batch's sums are far below 2 ** 53
            counts += np.bincount(bounds.own, minlength=k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("vec_id")), _pack(x.astype(np.int32)), pa.array(bounds.own.astype(np.int32)),
                 pa.array(bounds.up), _pack(bounds.near.astype(np.int32)), _pack(bounds.low), pa.array(bounds.rest),
                 *(pa.nulls(rows, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()))], schema=_SCHEMA
            )
        at = np.flatnonzero(counts)
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(m, f.type) for f in list(_SCHEMA)[:7]), pa.array(at.astype(np.int32)), pa.array(counts[at]),
             pa.array(list(sums[at]), pa.list_(pa.int64())), pa.array(np.full(m, used, np.int32)), pa.nulls(m, pa.int64())], schema=_SCHEMA
        )

    return state.mapInArrow(tidy(scan), _STATE)


def moved_centres(table: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """Floors of the means by component, and the most bounds used; k times dim rows reach the driver."""
    sums = table.filter("cluster is not null").select("cluster", "n", "used", F.posexplode("sums").alias("pos", "s"))
    wide = "decimal(38,0)"
    found = sums.groupBy("cluster", "pos").agg(F.sum(F.col("s").cast(wide)).alias("s"), F.sum("n").alias("n"), F.max("used").alias("used"))
    out, used = centres.copy(), 0
    for row in found.collect():
        out[row["cluster"], row["pos"]] = int(row["s"]) // row["n"]
        used = max(used, row["used"])
    return out, used


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after so many rounds and one more assignment."""
    prepare(embeddings.sparkSession)
    vectors = integer_vectors(embeddings, dim)
    centres = start_centres(vectors, k, seed)
    if not len(centres):  # nothing is kept, or nothing that has an id
        none = F.lit(None)
        return vectors.select("vec_id", none.cast("int").alias("cluster"), none.cast("long").alias("distance")).limit(0), centres
    k = len(centres)
    b, least = max(0, min(k - 1, max(2, -(-k // 4)))), min(k - 1, max(1, -(-k // 8)))
    state, moved = vectors, None
    for _ in range(rounds):
        table = materialize(assign_round(state, centres, moved, b), "clusters")
        if state is not vectors:
            drop_materialized(state)
        new, used = moved_centres(table, centres)
        if moved is not None:
            b = max(least, min(b, used))
        moved = np.sqrt(((new - centres).astype(np.float64) ** 2).sum(axis=1)) * (1 + EPS)
        state, centres = table.filter("cluster is null"), new
        if not moved.any():  # further rounds would not change anything
            break
    last = assign_round(state, centres, moved, b).filter("cluster is null").select("vec_id", "x", "own")
    done = materialize(_distances(last, centres), "clustered")
    if state is not vectors:
        drop_materialized(state)
    return done, centres


def _distances(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.array(column(batch, "own"), np.int64)
                d = squared_to(_vectors(batch, shared.value.shape[1]), shared.value, own[:, None])[:, 0]
                ids = batch.column(batch.schema.get_field_index("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(tidy(scan), "vec_id long, cluster int, distance long")


def report(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of dim components, none null or not finite; others give no row. Rows
    that repeat are vectors of their own; a row without vec_id is clustered, but starts no
    centroid. With fewer kept vectors than k there are as many centroids; if no kept
    vector has an id, there are no rows. Components beyond most_component(dim) count as
    that, so distances fit a long. Only vec_id and embedding are looked at.
    """
    rows, centres = cluster(embeddings, k, rounds, seed, dim)
    spark = embeddings.sparkSession
    names = [(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centres)]
    names = spark.createDataFrame(names, "cluster int, components string").select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())).join(names, "cluster")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int, rounds: int, seed: int, dim: int = 64) -> str:
    """DuckDB SQL of the plain algorithm: every distance in every round."""
    steps = [
        f"""with points as materialized (
  select row_number() over () as r, vec_id, embedding::double[] as e from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select r, pos, floor(1024 * e[pos + 1])::bigint as x from (select r, e, unnest(range({dim})) as pos from points)
), starts as (
  select r, row_number() over (order by sha256('{seed}:' || vec_id), e) - 1 as c from points where vec_id is not null
  order by sha256('{seed}:' || vec_id), e limit {k}
), c0 as materialized (select c, pos, x from starts join parts using (r))"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} as materialized (
  select r, c, d from (select p.r, q.c, sum((p.x - q.x) * (p.x - q.x)) as d from parts p join c{i} q using (pos) group by p.r, q.c)
  qualify row_number() over (partition by r order by d, c) = 1
)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} as materialized (
  select o.c, o.pos, coalesce((s - ((s % n) + n) % n) // n, o.x)::bigint as x
  from c{i} o left join (select c, pos, sum(x) as s, count(*) as n from a{i} join parts using (r) group by c, pos) using (c, pos)
)"""
            )
    steps.append(
        f"""digests as (select c, sha256(string_agg(x::varchar, ',' order by pos)) as digest from c{rounds} group by c)
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, digest as centroid_sha256
from a{rounds} join points using (r) join digests using (c)"""
    )
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]
