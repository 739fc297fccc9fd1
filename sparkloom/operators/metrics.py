"""Metrics of regressors and classifiers as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import corrected_kurtosis, corrected_skewness
from .ordering import magnitude, with_position


def regression_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """One row: n, mae, mse, rmse, r2, from sums of one pass (values centred on a first mean)."""
    centre = df.agg(F.avg(actual).alias("_m"))
    e, dev = F.col(actual) - F.col(predicted), F.col(actual) - F.col("_m")
    r2 = 1 - F.sum(e * e) / F.nullif(F.sum(dev * dev), F.lit(0.0))
    out = df.crossJoin(F.broadcast(centre)).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"),
    )
    return out.select("n", *[F.round(c, digits).alias(c) for c in ("mae", "mse", "rmse", "r2")])


def residual_stats(df: DataFrame, residual: Column, digits: int = 4) -> DataFrame:
    r = df.select(residual.alias("r"))
    c = F.col("r")
    return r.agg(
        F.round(F.avg(c), digits).alias("mean"), F.round(F.stddev_samp(c), digits).alias("std"), F.round(F.min(c), digits).alias("min"),
        F.round(F.max(c), digits).alias("max"), F.round(corrected_skewness(c), digits).alias("skewness"),
        F.round(corrected_kurtosis(c), digits).alias("kurtosis"),
    )


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: slope and intercept of least squares."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def binary_metrics(df: DataFrame, actual: Column, predicted: Column, digits: int = 6) -> DataFrame:
    """One row: the confusion matrix, accuracy, precision, recall, f1; ratios to 0 are 0."""
    counts = df.agg(
        F.count_if((actual == 1) & (predicted == 1)).alias("tp"), F.count_if((actual == 0) & (predicted == 1)).alias("fp"),
        F.count_if((actual == 1) & (predicted == 0)).alias("fn"), F.count_if((actual == 0) & (predicted == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    values = {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    return counts.select("tp", "fp", "fn", "tn", *[F.round(v, digits).alias(n) for n, v in values.items()])


def roc_auc(df: DataFrame, actual: Column, score: Column, digits: int = 6) -> DataFrame:
    """One row: auc by rank sums; equal scores share their mean rank. Scores are counted, ranked
    within ranges of magnitude side by side, and ranges are put in order by their sums; one scan."""
    by = df.select(actual.alias("y"), score.alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p"))
    ranged = by.withColumn("_range", F.coalesce(magnitude(F.col("s").cast("double")), F.lit(-(1 << 30))))
    within = F.sum("n").over(Window.partitionBy("_range").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("rank", within - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("_range").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("r", F.col("r") + before * F.col("p"))
    out = placed.agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return out.select(F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0)), digits).alias("auc"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """Per class of either column: support, precision, recall, f1 (0 where undefined)."""
    cells = confusion(df, actual, predicted)
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.col(actual).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
        ))
    )
    t = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    values = {
        "precision": _ratio(F.col("hit"), F.col("said")), "recall": _ratio(F.col("hit"), F.col("support")),
        "f1": _ratio(2 * F.col("hit"), F.col("said") + F.col("support")),
    }
    return t.select("label", "support", *[F.round(v, digits).alias(n) for n, v in values.items()])


def multiclass_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """One row: accuracy, and macro and weighted precision, recall, f1."""
    per = class_report(df, actual, predicted, 15)
    total = F.sum("support")
    hits = F.sum(F.col("recall") * F.col("support"))
    out = {"accuracy": hits / total}
    for m in ("precision", "recall", "f1"):
        out[f"{m}_macro"] = F.avg(m)
        out[f"{m}_weighted"] = F.sum(F.col(m) * F.col("support")) / total
    return per.agg(*[F.round(v, digits).alias(n) for n, v in out.items()])


def confusion_pairs(df: DataFrame, actual: str, predicted: str, k: int = 10) -> DataFrame:
    """The k most frequent errors."""
    wrong = confusion(df, actual, predicted).filter(F.col(actual) != F.col(predicted))
    return wrong.orderBy(F.desc("n"), actual, predicted).limit(k)


def stratified_fold(df: DataFrame, label: str, key: str, folds: int, seed: int = 42) -> DataFrame:
    """df with fold: rows of each label dealt in turn, in the order of a hash."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    placed = with_position(df.withColumn("_hash", order), [label, "_hash", key], "_nth")
    start = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_nth").alias("_start"))
    joined = placed.join(F.broadcast(start), F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn("fold", ((F.col("_nth") - F.col("_start")) % folds).cast("int")).select(*df.columns, "fold")
