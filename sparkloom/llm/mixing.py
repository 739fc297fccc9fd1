"""Mixing sources to target weights.

Word counts are summed per source with partial aggregates, so a hot source costs no
more than any other; targets follow from the sums alone. A document of a source with
repetition rate r is taken floor(r) times, and once more when a hash of its id and the
seed falls below the fraction of r. Reruns therefore agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

#: Weights of the sources in code point order, null last; repeated.
WEIGHTS = (3, 1, 2)
#: Words to take, in words there are: BUDGET[0] / BUDGET[1].
BUDGET = (3, 2)
#: No source is taken more often than this.
MOST = 2
#: Sources up to which their table (some 40 bytes a row) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5("seed:doc_id")."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    most: int = MOST,
) -> DataFrame:
    """Per source: source, source_size, weight, target, rate.

    Targets share budget x all words by weight; a target stops at most x the source's
    size and the excess is shared by weight again until none is above. This is the
    water level L with sum(min(most * size, L * weight)) = budget, found from running
    sums over the sources ordered by the level at which each stops. A source without
    words has target and rate 0; a null source is a source of its own, the last.
    """
    up, down = budget
    sized = documents.select("source", word_count(F.col("text")).alias("n"))
    sums = materialize(sized.groupBy("source").agg(F.sum("n").alias("source_size")), "sources")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("size") * most
    before = (
        sums.withColumn("weight", weight.cast("long"))
        .withColumn("size", F.col("source_size").cast("decimal(24,0)"))  # products of sizes and weights outgrow a long
        .withColumn("total", F.sum("size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("used", F.coalesce(F.sum(cap).over(by_level), F.lit(0)))
        .withColumn("free", F.col("all_weight") - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
    )
    left = F.col("total") * up - F.col("used") * down
    stopped = before.withColumn("stops", cap * F.col("free") * down <= left * F.col("weight"))
    level = (
        stopped.withColumn("stopped", F.coalesce(F.sum(F.when(F.col("stops"), cap)).over(everything), F.lit(0)))
        .withColumn("open", F.coalesce(F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything), F.lit(0)))
    )
    rest = (F.col("total") * up - F.col("stopped") * down) * F.col("weight")
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(
        rest.cast("double") / (F.col("open") * down).cast("double")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return level.withColumn("target", target).select(
        "source", "source_size", "weight", "target", rate.alias("rate")
    )


def _planned(documents: DataFrame, seed: int, name: str, **plan) -> DataFrame:
    """documents with one more column of that name: size, source_size, target, copies."""
    targets = materialize(source_targets(documents, **plan), "targets")
    source, of = free_name(documents, "_mix_source"), free_name(documents, "_mix_of")
    own = targets.select(F.col("source").alias(source), F.struct("source_size", "target", "rate").alias(of))
    if targets.count() <= BROADCAST_SOURCES:
        own = F.broadcast(own)
    joined = documents.join(own, documents["source"].eqNullSafe(own[source]))
    rate = F.col(f"{of}.rate")
    extra = (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(
        name,
        F.struct(
            word_count(F.col("text")).alias("size"),
            F.col(f"{of}.source_size").alias("source_size"),
            F.col(f"{of}.target").alias("target"),
            (F.floor(rate) + extra).alias("copies"),
        ),
    ).drop(source, of)


def report(documents: DataFrame, seed: int = 0, **plan) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (words, repeats
    counted), copies.

    Null and empty texts have size 0; repeated rows of one doc_id are taken alike; an
    empty table gives no rows; other columns are not looked at.
    """
    planned = _planned(documents.select("doc_id", "text", "source"), seed, "_mix", **plan)
    return planned.select(
        "doc_id",
        "_mix.size",
        "_mix.source_size",
        "_mix.target",
        (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"),
        "_mix.copies",
    )


def mix(documents: DataFrame, seed: int = 0, **plan) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns."""
    name = free_name(documents, "_mix")
    planned = _planned(documents, seed, name, **plan)
    times = planned.filter(F.col(f"{name}.copies") > 0)
    times = times.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies"))))
    return times.drop(name)
