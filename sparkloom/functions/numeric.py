"""Numeric expressions whose details differ from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(c: Column) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(c, 0.5)


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected skewness of a group; null below three values or without spread."""
    n = F.count(c).cast("double")
    g = F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c))
    return g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis of a group; null below four values or without spread."""
    n = F.count(c).cast("double")
    g = F.when((n > 3) & (F.stddev_pop(c) > 0), F.kurtosis(c))
    return ((n + 1) * g + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))


def round_scaled(c: Column, digits: int) -> Column:
    """A double of 0 or more, rounded as it is stored: Spark's own round goes by its shortest
    decimal writing, and so takes 5.015, which is stored a little smaller, to 5.02."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float, high: float) -> Column:
    """Within bounds; null stays null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def on_grid(c: Column, start: float, step: float) -> Column:
    """Whether a number lies on a grid, within the usual tolerance of closeness."""
    place = (c - start) / step
    return F.abs(place - F.rint(place)) <= 1e-8 + 1e-5 * F.abs(F.rint(place))


def bucket(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 1 to bins of equal width; the last bin is closed."""
    at = F.floor((c - low) / (high - low) * bins) + 1
    return F.when(high > low, F.least(at, F.lit(bins))).otherwise(F.lit(1)).cast("int")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def pct(part: Column, whole: Column, digits: int) -> Column:
    """part in per cent of whole; 0 when there is no whole."""
    return round_scaled(F.coalesce(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), F.lit(0.0)), digits)
