"""Cosine retrieval over triples and dense vectors: equi-joins on terms, no cross joins
between tables that grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scores(queries: DataFrame, items: DataFrame, qkey: str, key: str, small: bool = False) -> DataFrame:
    """(qkey, key, score) of all pairs that share a term, from unit triples.

    small: the queries are a stated few and are broadcast, so no frequent term takes its items to one task.
    """
    q = queries.select(qkey, "term", F.col("weight").alias("qw"))
    met = items.select(key, "term", "weight").join(F.broadcast(q) if small else q, "term")
    return met.groupBy(qkey, key).agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))


def checked_k(k: object) -> int:
    """k, which has to be a whole number of 1 or more; a truth value is none."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k has to be a whole number of 1 or more, not {k!r}")
    return k


def top_k(scored: DataFrame, qkey: str, key: str, k: int, digits: int = 6) -> DataFrame:
    """Per query the k best items: rank, score rounded; score first, then the lower id."""
    k = checked_k(k)
    rounded = scored.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), key))
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k)


def similar_items(
    triples: DataFrame, key: str, seeds: Sequence[int] | DataFrame, k: int, allowed: DataFrame | None = None
) -> DataFrame:
    """Per seed its k most similar other items, of the allowed ones if given.

    seeds: ids, or a table of a few with the key. Items without a common term have score 0
    and fill up; a seed without terms, or an unknown one, has none.
    """
    chosen = triples.join(F.broadcast(seeds.select(key)), key, "left_semi") if isinstance(seeds, DataFrame) else triples.filter(F.col(key).isin(*seeds))
    q = chosen.select(F.col(key).alias("seed"), "term", F.col("weight").alias("qw"))
    asked = F.broadcast(q.select("seed").distinct())
    pool = triples.join(allowed, key, "left_semi") if allowed is not None else triples
    # terms that are not shared count as 0, so every item meets every seed where it lies and no pairs are shuffled or joined
    pairs = pool.select(key, "term", "weight").crossJoin(asked).join(F.broadcast(q), ["seed", "term"], "left")
    filled = pairs.groupBy("seed", key).agg(F.sum(F.coalesce(F.col("qw") * F.col("weight"), F.lit(0.0))).alias("score"))
    if allowed is not None:  # those without terms are items too
        filled = allowed.select(key).crossJoin(asked).join(filled, ["seed", key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    filled = filled.filter(F.col(key) != F.col("seed"))
    return top_k(filled, "seed", key, k)


def profiles(triples: DataFrame, liked: DataFrame, user: str, key: str) -> DataFrame:
    """(user, term, weight): the mean vector of liked items, by their number, unit length."""
    sizes = liked.groupBy(user).agg(F.count("*").alias("n"))
    summed = liked.join(triples, key).groupBy(user, "term").agg(F.sum("weight").alias("w"))
    mean = summed.join(sizes, user).select(user, "term", (F.col("w") / F.col("n")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(user)))
    return mean.select(user, "term", (F.col("w") / norm).alias("weight"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null when one has no length."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def dense_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, digits: int = 5, block: int = 1_000) -> DataFrame:
    """Per query row of a stated set its k most similar others: ``blocks.dense_top_k``."""
    from .blocks import dense_top_k as by_blocks  # which ranks by top_k() of this module

    return by_blocks(vectors, key, vector, queries, k, digits, block)
