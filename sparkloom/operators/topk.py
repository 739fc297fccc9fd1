"""Exact top-K over an inverted index whose posting blocks hold their largest weight.

Items are put into small blocks with others that have the same heaviest terms. For each block
and term the index holds the largest weight, so one small join bounds the score of any
item of a block from above. The blocks with the largest bounds are scored first; the
K-th score found there is a floor, and of all other blocks only those whose bound
reaches it are scored. What is skipped cannot be among the best K, so the result is
that of the whole product, of which only the chosen blocks are ever made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_position
from .similarity import checked_k, top_k

#: Items of a block, and terms by which items are put in order.
BLOCK, LEAD = 8, 8


@dataclass(frozen=True)
class PostingIndex:
    """postings: part, block, term, the key, weight. tops: part, block, term, top, n (postings)."""

    key: str
    postings: DataFrame
    tops: DataFrame


def build_index(triples: DataFrame, key: str, folder: str, part: str | None = None, block: int = BLOCK) -> PostingIndex:
    """Index of (key, term, weight) triples with weights of 0 or more, written to a folder.

    part: a column of triples, the same for all terms of an item; searches stay within one
    value of it, and blocks do not span two. Items are put in order by their heaviest terms,
    so neighbours share these and the bounds of their blocks are tight.
    """
    spark = triples.sparkSession
    own = F.col(part).cast("string") if part else F.lit("")
    rows = triples.select(key, F.coalesce(own, F.lit("")).alias("part"), "term", "weight")
    rows.write.mode("overwrite").parquet(f"{folder}/triples")
    rows = spark.read.parquet(f"{folder}/triples")
    lead = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("weight", "term")), asc=False), lambda x: x["term"]), 1, LEAD)
    paths = rows.groupBy("part", key).agg(F.concat_ws("\u0001", lead).alias("path"))
    placed = with_position(paths, ["part", "path", key], "place").select("part", key, F.floor(F.col("place") / block).alias("block"))
    rows.join(placed, ["part", key]).select("part", "block", "term", key, "weight").write.mode("overwrite").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    tops = postings.groupBy("part", "block", "term").agg(F.max("weight").alias("top"), F.count("*").alias("n"))
    tops.write.mode("overwrite").parquet(f"{folder}/tops")
    return PostingIndex(key, postings, spark.read.parquet(f"{folder}/tops"))


def _scored(queries: DataFrame, chosen: DataFrame, index: PostingIndex, qkey: str) -> DataFrame:
    """(qkey, key, score) of all items of the chosen blocks that share a term."""
    asked = queries.join(chosen, ["part", qkey])
    met = asked.join(index.postings, ["part", "block", "term"])
    return met.groupBy(qkey, index.key).agg(F.sum(F.col("_w") * F.col("weight")).alias("score"))


def top_k_by_bounds(
    queries: DataFrame, index: PostingIndex, qkey: str, k: int, folder: str, part: str | None = None,
    exclude: DataFrame | None = None, digits: int = 6, block: int = BLOCK,
) -> DataFrame:
    """Per query its k best items: (qkey, key, score, rank); score first, then the lower id.

    queries: (qkey, term, weight) triples with weights of 0 or more, and part where the index
    has parts. exclude: (qkey, key) pairs that are left out. Items without a common term are
    not among the results. The bounds are written to the folder and read twice.
    """
    k, spark = checked_k(k), queries.sparkSession
    own = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    asked = queries.select(qkey, own.alias("part"), "term", F.col("weight").alias("_w"))
    met = asked.join(index.tops, ["part", "term"]).groupBy("part", qkey, "block")
    met.agg(F.sum(F.col("_w") * F.col("top")).alias("bound")).write.mode("overwrite").parquet(f"{folder}/bounds")
    bounds = spark.read.parquet(f"{folder}/bounds")
    first = F.row_number().over(Window.partitionBy("part", qkey).orderBy(F.desc("bound"), "block"))
    seeds = bounds.withColumn("_first", first).filter(F.col("_first") <= 2 + -(-2 * k // block)).select("part", qkey, "block")

    def left(scored: DataFrame) -> DataFrame:
        return scored if exclude is None else scored.join(exclude.select(qkey, index.key).distinct(), [qkey, index.key], "left_anti")

    top_k(left(_scored(asked, seeds, index, qkey)), qkey, index.key, k, digits).write.mode("overwrite").parquet(f"{folder}/first")
    found = spark.read.parquet(f"{folder}/first")
    floor = found.filter(F.col("rank") == k).select(qkey, F.col("score").alias("_floor"))
    # scores are compared as rounded, and sums may round apart
    reach = (F.col("bound") + 2 * 10.0**-digits >= F.col("_floor")) | F.col("_floor").isNull()
    others = bounds.join(seeds, ["part", qkey, "block"], "left_anti").join(floor, qkey, "left").filter(reach).select("part", qkey, "block")
    more = top_k(left(_scored(asked, others, index, qkey)), qkey, index.key, k, digits)
    both = found.drop("rank").unionByName(more.drop("rank"))
    return top_k(both, qkey, index.key, k, digits)


def postings_read(queries: DataFrame, index: PostingIndex, qkey: str, k: int, folder: str, part: str | None = None, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """One row on a search that top_k_by_bounds() has left in the folder: postings, those of all
    blocks that share a term, and read, those of the blocks that it scored."""
    spark = queries.sparkSession
    own = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    asked = queries.select(qkey, own.alias("part"), "term")
    bounds, found = spark.read.parquet(f"{folder}/bounds"), spark.read.parquet(f"{folder}/first")
    first = F.row_number().over(Window.partitionBy("part", qkey).orderBy(F.desc("bound"), "block"))
    floor = found.filter(F.col("rank") == k).select(qkey, F.col("score").alias("_floor"))
    seed = F.col("_first") <= 2 + -(-2 * k // block)
    reach = (F.col("bound") + 2 * 10.0**-digits >= F.col("_floor")) | F.col("_floor").isNull()
    judged = bounds.withColumn("_first", first).join(floor, qkey, "left").select("part", qkey, "block", (seed | reach).alias("scored"))
    met = asked.join(index.tops, ["part", "term"]).join(judged, ["part", qkey, "block"])
    return met.agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("scored"), F.col("n")).otherwise(0)).alias("read"))
