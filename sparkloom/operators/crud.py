"""Maintenance of keyed tables: every change is a new table made by joins and unions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import row_at, with_position

#: Digits of a new row's id.
ID_DIGITS = 8


def next_id(df: DataFrame, key: str) -> DataFrame:
    """One row: next_id, the largest id and 1; 1 for an empty table."""
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def append_with_id(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df and the rows, numbered on from the largest id; columns they lack are null."""
    start = next_id(df, key)
    others = [c for c in rows.columns if c != key]
    kind = dict(df.dtypes)[key]
    placed = with_position(rows, others, "_nth").crossJoin(F.broadcast(start))
    new = placed.withColumn(key, (F.col("next_id") + F.col("_nth") - 1).cast(kind)).drop("next_id", "_nth")
    return df.unionByName(new, allowMissingColumns=True)


def update_by_id(df: DataFrame, key: str, value: object, changes: Mapping[str, Column]) -> DataFrame:
    """The row's columns set; unknown columns are ignored."""
    hit = F.col(key) == F.lit(value)
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in changes.items() if c in df.columns})


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per changed cell: the key, column_name, before, after (as text)."""
    names = [c for c in before.columns if c != key]
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"a.{c}").cast("string").alias("before"), F.col(f"b.{c}").cast("string").alias("after"))
        for c in names
    ])
    rows = joined.select(F.col(f"a.{key}").alias(key), F.inline(F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))))
    return rows


def delete_by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(~F.col(key).eqNullSafe(F.lit(value)))


def _at(df: DataFrame, order: list[str], position: int) -> tuple[DataFrame, Column]:
    """(one row with the order's columns at a place under other names, whether a row is that one)."""
    found = row_at(df, order, position).select(*[F.col(c).alias(f"_at_{i}") for i, c in enumerate(order)])
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{i}"))
    return found, same


def delete_by_position(df: DataFrame, order: list[str], position: int) -> DataFrame:
    """Without the row at a place (from 1) of a total order. The table itself is not moved."""
    found, same = _at(df, order, position)
    return df.join(F.broadcast(found), same, "left_anti")


def upsert(df: DataFrame, rows: DataFrame, key: str, unique: str | None = None) -> DataFrame:
    """Rows replace those of the same key and are added otherwise.

    With unique, rows are refused whose text in that column, in any case and stripped,
    belongs to another key already.
    """
    if unique is not None:
        taken = df.select(F.col(key).alias("_k"), F.lower(F.trim(unique)).alias("_u"))
        clash = (F.lower(F.trim(F.col(unique))) == F.col("_u")) & (F.col(key) != F.col("_k"))
        rows = rows.join(taken, clash, "left_anti")
    return df.join(rows.select(key), key, "left_anti").unionByName(rows)


def with_derived(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """df with columns that follow from others, made in turn."""
    for name, value in derived.items():
        df = df.withColumn(name, value)
    return df


def upsert_derived(df: DataFrame, rows: DataFrame, key: str, derived: Mapping[str, Column], unique: str | None = None) -> DataFrame:
    """upsert, with the derived columns of the new rows made anew from their others."""
    return upsert(df, with_derived(rows, derived).select(df.columns), key, unique)


def update_by_position(df: DataFrame, order: list[str], position: int, changes: Mapping[str, Column]) -> DataFrame:
    """The columns of the row at a place (from 1) of a total order set. The table itself is not moved."""
    return update_validated(df, order, position, changes, F.array().cast("array<string>"))[0]


def update_validated(df: DataFrame, order: list[str], position: int, changes: Mapping[str, Column], errors: Column) -> tuple[DataFrame, DataFrame]:
    """(df with the columns of the row at a place set; the row as it would be, with its errors).

    errors: an array over the columns of df, judged on the changed row as a whole. Where it is
    not empty nothing changes; else the second table is empty. Unknown columns are ignored.
    """
    kinds = dict(df.dtypes)
    found, same = _at(df, order, position)
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    placed = df.join(F.broadcast(found.withColumn("_hit", F.lit(True))), same, "left")
    old = F.struct(*df.columns).alias("_old")
    new = {c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in changes.items() if c in kinds}
    judged = placed.select(*df.columns, "_hit", old).withColumns(new)
    judged = judged.withColumn("errors", F.when(hit, errors).otherwise(F.array().cast("array<string>")))
    bad = F.size("errors") > 0
    table = judged.select(*[F.when(bad, F.col("_old")[c]).otherwise(F.col(c)).alias(c) for c in df.columns])
    return table, judged.filter(bad).select(*df.columns, "errors")


def insert_validated(df: DataFrame, rows: DataFrame, key: str, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(df with the rows that have no errors, each under a new id; the others with their
    errors). Nothing is added when every row is refused.

    An id is the first ``ID_DIGITS`` hex digits of a digest of the row, the same at every
    read; an id that is taken, or that two new rows would share, has all 32 digits.
    """
    judged = rows.withColumn("errors", errors)
    good = judged.filter(F.size("errors") == 0).drop("errors", key)
    text = F.to_json(F.struct(*good.columns)) if good.columns else F.lit("")
    again = F.row_number().over(Window.partitionBy("_text").orderBy("_text"))
    named = good.withColumn("_text", text).withColumn("_id", F.md5(F.concat("_text", F.lit("|"), again.cast("string"))))
    short = F.substring("_id", 1, ID_DIGITS)
    named = named.withColumn("_short", short).withColumn("_times", F.count("*").over(Window.partitionBy("_short")))
    taken = df.select(F.col(key).alias("_taken")).distinct()
    named = named.join(taken, F.col("_short") == F.col("_taken"), "left")
    one = (F.col("_times") == 1) & F.col("_taken").isNull()
    new = named.withColumn(key, F.when(one, F.col("_short")).otherwise(F.col("_id"))).drop("_text", "_id", "_short", "_times", "_taken")
    return df.unionByName(new, allowMissingColumns=True), judged.filter(F.size("errors") > 0)
