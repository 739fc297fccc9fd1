"""Batch inference with per-row errors, margins, curves and top features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from .ordering import running_sums


def feature_rows(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """The features in order as doubles, and valid: whether every one is a number."""
    cast = [F.col(c).cast("string").try_cast("double").alias(c) for c in features]
    rows = df.select(key, *cast)
    valid = F.lit(True)
    for c in features:
        valid = valid & rows[c].isNotNull()
    return rows.withColumn("valid", valid)


def linear_scores(rows: DataFrame, weights: Mapping[str, float], intercept: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """rows with prediction (null where not valid), kept within bounds if given."""
    score: Column = F.lit(float(intercept))
    for c, w in weights.items():
        score = score + F.col(c) * float(w)
    if low is not None and high is not None:
        score = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), score))
    return rows.withColumn("prediction", F.when(F.col("valid"), score))


def margin_confidence(scores: Column) -> Column:
    """Sigmoid of the distance between the two largest of an array of class scores."""
    ordered = F.sort_array(scores, asc=False)
    return F.when(F.size(scores) > 1, sigmoid(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))).otherwise(1.0)


def roc_points(df: DataFrame, actual: Column, score: Column, digits: int = 6) -> DataFrame:
    """Per distinct score: threshold, fpr, tpr, precision for "at least the threshold".

    Scores are counted before they are put in order.
    """
    by = df.select(actual.alias("y"), score.alias("threshold")).groupBy("threshold").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")
    )
    placed = running_sums(by, ["threshold"], {"p_upto": "p", "q_upto": "q"})
    every = by.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    rows = placed.crossJoin(F.broadcast(every))
    tp, fp = (F.col(f"all_{c}") - F.col(f"{c}_upto") + F.col(c) for c in "pq")
    return rows.select(
        "threshold", F.round(fp / F.col("all_q"), digits).alias("fpr"),
        F.round(tp / F.col("all_p"), digits).alias("tpr"), F.round(tp / (tp + fp), digits).alias("precision"),
    )


def top_weights(df: DataFrame, name: str, weight: str, k: int) -> DataFrame:
    """The k largest weights by size: name, weight, sign, rank."""
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs(weight)), name))
    sign = F.when(F.col(weight) >= 0, "+").otherwise("-")
    return df.orderBy(F.desc(F.abs(weight)), name).limit(k).select(name, weight, sign.alias("sign"), rank.alias("rank"))
