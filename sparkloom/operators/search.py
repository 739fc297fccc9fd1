"""Lookups, searches, pages and candidate filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def matching(df: DataFrame, name: str, wanted: str, exact: bool = False) -> DataFrame:
    """Rows whose column equals or contains a value, in any case; the value is stripped."""
    low, want = F.lower(F.col(name).cast("string")), wanted.strip().lower()
    return df.filter(low == want if exact else low.contains(want))


def matching_all(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows that contain every given value in its column; unknown columns are skipped."""
    tests = [F.lower(F.col(c).cast("string")).contains(v.strip().lower()) for c, v in wanted.items() if c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def page(df: DataFrame, order: Sequence[str], pattern: str | None, name: str, offset: int, limit: int) -> DataFrame:
    """One page of the rows whose lower-cased column matches a regular expression."""
    found = df if pattern is None else df.filter(F.lower(F.col(name)).rlike(pattern.lower()))
    return found.orderBy(*order).offset(offset).limit(limit)


def title_search(items: DataFrame, counts: DataFrame, key: str, title: str, wanted: str) -> DataFrame:
    """The item whose title contains the text: the most rated, the lowest id on ties."""
    found = items.filter(F.lower(F.col(title)).contains(wanted.strip().lower()))
    return (
        found.join(counts, key, "left")
        .withColumn("rating_count", F.coalesce("rating_count", F.lit(0)))
        .orderBy(F.desc("rating_count"), key)
        .limit(1)
    )


def candidates(
    items: DataFrame, counts: DataFrame, key: str, title: str, genres: Column, least: int,
    wanted: Sequence[str] = (), years: tuple[int | None, int | None] = (None, None), year: str | None = None,
) -> DataFrame:
    """Items with a title, enough ratings, any of the wanted genres, and a year in bounds.

    Unknown counts are 0; without a year column its bounds are skipped.
    """
    rows = items.join(counts, key, "left").withColumn("rating_count", F.coalesce("rating_count", F.lit(0)))
    rows = rows.filter(F.col(title).isNotNull() & (strip(F.col(title)) != "") & (F.col("rating_count") >= least))
    if wanted:
        low = F.transform(genres, lambda g: F.lower(F.trim(g)))
        rows = rows.filter(F.arrays_overlap(low, F.array(*[F.lit(w.strip().lower()) for w in wanted])))
    if year is not None:
        for bound, op in ((years[0], ">="), (years[1], "<=")):
            if bound is not None:
                rows = rows.filter(f"{year} {op} {bound}")
    return rows


def display(df: DataFrame, names: Sequence[str], missing: str = "N/A") -> DataFrame:
    """Fixed columns that the table has, as text, missing cells marked."""
    return df.select(*[F.coalesce(F.col(n).cast("string"), F.lit(missing)).alias(n) for n in names if n in df.columns])
