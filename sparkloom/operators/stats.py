"""Descriptive statistics: summaries, distributions, popularity, moments, outliers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bucket, corrected_kurtosis, corrected_skewness, pct, round_scaled
from .ordering import quantiles
from .quality import melt


def summary(df: DataFrame, name: str, digits: int = 4) -> DataFrame:
    """One row: n, min, max, mean, median, std (sample; 0 for a single value)."""
    c = F.col(name).cast("double")
    one = df.agg(
        F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), digits).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), digits).alias("std"),
    )
    middle = quantiles(df, c, {"median": 0.5}).select(F.round("median", digits).alias("median"))
    return one.crossJoin(F.broadcast(middle)).select("n", "min", "max", "mean", "median", "std")


def grid_distribution(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """Counts over the whole grid of integers, zero where there is none; pct 3 decimals."""
    counts = df.groupBy(value.cast("int").alias("grid")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("grid"))
    total = df.agg(F.count("*").alias("total"))
    return grid.join(F.broadcast(counts.filter(F.col("grid").between(low, high))), "grid", "left").crossJoin(total).select(
        "grid", F.coalesce("n", F.lit(0)).alias("n"), pct(F.coalesce("n", F.lit(0)), F.col("total"), 3).alias("pct")
    )


def activity(df: DataFrame, key: str) -> DataFrame:
    """One row on how often keys occur: keys, min, max, mean, median, p01, p99, and how
    many keys lie at or beyond those two. Null keys are left out.

    Keys are counted by how often they occur first: n rows have fewer than sqrt(2 * n) different
    counts, so what is put in order is small at any size.
    """
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    freq = per.groupBy("n").agg(F.count("*").alias("m")).withColumn("_all", F.sum("m").over(Window.partitionBy()))
    placed = freq.withColumn("_upto", F.sum("m").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    at = {"median": 0.5, "p01": 0.01, "p99": 0.99}
    place = {name: (F.col("_all") - 1) * F.lit(p) for name, p in at.items()}
    ends = [F.min(F.when(F.col("_upto") > end(p), F.col("n").cast("double"))).alias(f"_{what}_{name}") for name, p in place.items() for what, end in (("lo", F.floor), ("hi", F.ceil))]
    one = placed.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_keys"), F.min("n").cast("double").alias("min"), F.max("n").cast("double").alias("max"),
        F.round(F.sum(F.col("n") * F.col("m")) / F.sum("m"), 4).alias("mean"), F.max("_all").alias("_all"), *ends,
    )
    between = {name: F.when(F.floor(p) == F.ceil(p), F.col(f"_lo_{name}")).otherwise((F.ceil(p) - p) * F.col(f"_lo_{name}") + (p - F.floor(p)) * F.col(f"_hi_{name}")).alias(name) for name, p in place.items()}
    one = one.select("n_keys", "min", "max", "mean", *between.values())
    ends = freq.crossJoin(F.broadcast(one.select("p01", "p99"))).agg(
        F.coalesce(F.sum(F.when(F.col("n") >= F.col("p99"), F.col("m"))), F.lit(0)).alias("heavy"),
        F.coalesce(F.sum(F.when(F.col("n") <= F.col("p01"), F.col("m"))), F.lit(0)).alias("light"),
    )
    return one.crossJoin(F.broadcast(ends))


def popularity(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: rating_count and mean_rating, summed in doubles."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("rating_count"), F.avg(F.col(value).cast("double")).alias("mean_rating")
    )


def value_share(df: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """Per value: n and its share of all rows that have one."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", round_scaled(F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def moments(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    """Per column: bias-corrected skewness and excess kurtosis."""
    aggs = []
    for c in names:
        aggs += [corrected_skewness(F.col(c)).alias(f"{c}_s"), corrected_kurtosis(F.col(c)).alias(f"{c}_k")]
    parts = [(c, [F.round(F.col(f"{c}_s"), digits), F.round(F.col(f"{c}_k"), digits)]) for c in names]
    return melt(df.agg(*aggs), parts, ["column_name", "skewness", "kurtosis"])


def correlations(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass; pairs with nulls left out."""
    pairs = list(combinations(names, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    parts = [(a, [F.lit(b), F.round(F.col(f"{a}__{b}"), digits)]) for a, b in pairs]
    return melt(row, parts, ["a", "b", "r"])


def correlation_ranking(df: DataFrame, target: str, names: Sequence[str], digits: int = 6) -> DataFrame:
    """Correlation with a target, with strength and sign; rank 1 is the strongest."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in names])
    found = melt(row, [(c, [F.round(F.col(c), digits)]) for c in names], ["feature", "r"])
    size = F.abs("r")
    strength = F.when(size >= 0.5, "Strong").when(size >= 0.3, "Moderate").otherwise("Weak")
    return found.select(
        "feature", "r", strength.alias("strength"), F.when(F.col("r") >= 0, "Positive").otherwise("Negative").alias("sign"),
        F.row_number().over(Window.orderBy(F.desc(size), "feature")).alias("rank"),
    )


def iqr_outliers(df: DataFrame, name: str, digits: int = 6) -> DataFrame:
    """One row: quartiles, fences at 1.5 times their distance, outliers below and above."""
    c = F.col(name).cast("double")
    q = quantiles(df, c, {"q1": 0.25, "q3": 0.75})
    q = q.withColumns({"low": F.expr("q1 - 1.5 * (q3 - q1)"), "high": F.expr("q3 + 1.5 * (q3 - q1)")})
    return df.select(c.alias("_v")).crossJoin(F.broadcast(q)).agg(
        *[F.round(F.first(x), digits).alias(x) for x in ("q1", "q3", "low", "high")],
        F.count_if(F.col("_v") < F.col("low")).alias("below"), F.count_if(F.col("_v") > F.col("high")).alias("above"),
        pct(F.count_if((F.col("_v") < F.col("low")) | (F.col("_v") > F.col("high"))), F.count("_v"), 4).alias("pct"),
    )


def histogram(df: DataFrame, name: str, bins: int = 50) -> DataFrame:
    """Non-empty bins of equal width from least to largest value: bin, n."""
    ends = df.agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    binned = df.filter(F.col(name).isNotNull()).crossJoin(F.broadcast(ends))
    return binned.groupBy(bucket(F.col(name), F.col("_low"), F.col("_high"), bins).alias("bin")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """Per key: minimum, quartiles, maximum."""
    c = F.col(name).cast("double")
    return quantiles(df, c, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, [key])


def exploded_counts(df: DataFrame, values: Column, none: str) -> DataFrame:
    """Per value of an array column: n and pct of all rows (3 decimals)."""
    total = df.agg(F.count("*").alias("_total"))
    n = df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", pct(F.col("n"), F.col("_total"), 3).alias("pct"))


def multi_hot(df: DataFrame, key: str, values: Column, vocabulary: Sequence[str]) -> DataFrame:
    """One 0/1 column for each value of the vocabulary."""
    names = {v: "is_" + v.replace(" ", "_").replace("-", "_") for v in vocabulary}
    return df.select(key, *[F.array_contains(values, v).cast("int").alias(n) for v, n in names.items()])


def ordered_concat(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Per key its distinct normal values, the most frequent of all keys first, joined."""
    tags = df.select(key, value.alias("tag")).filter("tag is not null and tag <> ''")
    pairs = tags.groupBy(key, "tag").agg(F.count("*").alias("n"))
    freq = pairs.groupBy("tag").agg(F.sum("n").alias("freq"))
    ranked = pairs.join(freq, "tag").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "tag"))).alias("t"))
    return ranked.select(key, F.array_join(F.transform("t", lambda x: x["tag"]), " ").alias("tags"), F.size("t").alias("num_tags"))


def class_balance(df: DataFrame, key: str, least: int) -> DataFrame:
    """One row: classes, min and max size, their ratio, classes below the least size."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("classes"), F.min("n").alias("min_size"), F.max("n").alias("max_size"),
        F.round(F.min("n") / F.max("n"), 6).alias("ratio"), F.count_if(F.col("n") < least).alias("below"),
    )
