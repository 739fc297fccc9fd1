"""Positions, running sums and exact quantiles of a whole table, without one task for all.

A total order is cut at keys that are drawn by a hash, so the cuts depend on the rows
alone: every read of the plan gives the same ranges. Ranges are sorted side by side, and
the sums of the ranges before come from a table of at most ``SIDE * SIDE`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges are found in two steps of so many cuts each.
SIDE = 32
#: Groups of magnitude to a doubling, and even parts of one such group.
STEPS, PARTS = 1_024, 1 << 20
#: Rows and characters of a part of dealt(), and the fewest rows for which another one is started.
PART_ROWS, PART_CHARS, LEAST_ROWS = 50_000, 8_000_000, 500


def parts_needed(df: DataFrame, rows: int = PART_ROWS, chars: int = PART_CHARS) -> int:
    """How many parts the rows of df and the characters of its texts need; they are counted in one scan."""
    texts = [F.length(c) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0))), F.lit(0)).alias("chars")).first()
    least = min(df.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // LEAST_ROWS))
    return max(1, least, -(-size["n"] // rows), -(-size["chars"] // chars))


def dealt(df: DataFrame, *keys: str, rows: int = PART_ROWS, chars: int = PART_CHARS) -> DataFrame:
    """df in as many parts as its rows and the characters of its texts need, by a hash of the keys.

    Files can hold so much in a few splits that what a task makes of its own would grow with
    the table; parts stay as large however much there is. The rows are counted in one scan.
    """
    return df.repartition(parts_needed(df, rows, chars), *keys)


def dealt_in_order(df: DataFrame, key: str, rows: int = PART_ROWS) -> DataFrame:
    """dealt() with the rows of a part by key, for what depends on their order, such as seeded draws of a forest."""
    return dealt(df, key, rows=rows).sortWithinPartitions(key)


def with_range(df: DataFrame, order: Sequence[str], name: str, side: int = SIDE) -> DataFrame:
    """df with the number of each row's range, ascending with the order (nulls first).

    The cuts are one row, at most side * side keys, which is broadcast.
    """
    key = F.struct(*order)
    drawn = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(side * side - 1)
    cuts = drawn.agg(F.array_sort(F.collect_set("k")).alias("c"))
    fine = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice("c", i * side + 1, side - 1))
    coarse = F.filter("c", lambda _, i: (i + 1) % side == 0)
    cuts = cuts.select(coarse.alias("_coarse"), fine.alias("_fine"))
    first = F.size(F.filter("_coarse", lambda x: x <= key))
    joined = df.crossJoin(F.broadcast(cuts)).withColumn("_first", first)
    second = F.size(F.filter(F.get("_fine", F.col("_first")), lambda x: x <= key))
    return joined.select(*df.columns, (F.col("_first") * side + second).cast("int").alias(name))


def running_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, str | Column], side: int = SIDE) -> DataFrame:
    """df with a column for each name: the sum over all rows up to this one in the order.

    The order should be total. Sums of longs are longs; nulls count as 0.
    """
    own, numbers = "_range", {f"_sum_{n}": (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    tagged = with_range(df, order, own, side).withColumns({n: F.coalesce(c, F.lit(0)) for n, c in numbers.items()})
    within = Window.partitionBy(own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(own).agg(*[F.sum(n).alias(n) for n in numbers])
    before = totals.select(F.col(own).alias("_before"), *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_before") for n in numbers])
    summed = tagged.withColumns({n: F.sum(n).over(within) for n in numbers})
    joined = summed.join(F.broadcast(before), F.col(own) == F.col("_before"))  # at most side * side rows
    return joined.select(*df.columns, *[(F.col(f"_sum_{n}") + F.col(f"_sum_{n}_before")).alias(n) for n in sums])


def with_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with the place (from 1) of each row in a total order."""
    return running_sums(df, order, {name: F.lit(1).cast("long")})


def row_at(df: DataFrame, order: Sequence[str], position: int) -> DataFrame:
    """The order's columns of the row at a place (from 1) of a total order; no row beyond the end.

    Ranges are counted, and only the one that holds the place is sorted.
    """
    tagged = with_range(df.select(*order), order, "_range")
    upto = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    counts = tagged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", upto - F.col("_n"))  # side * side rows at most
    held = counts.filter((F.col("_before") < position) & (F.col("_before") + F.col("_n") >= position)).select(F.col("_range").alias("_held"), "_before")
    inside = tagged.join(F.broadcast(held), F.col("_range") == F.col("_held"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return inside.withColumn("_place", place).filter(F.col("_place") == position).select(*order)


def magnitude(v: Column) -> Column:
    """An integer that never falls as the double grows: STEPS for each doubling, NaN last."""
    size = F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0))
    step = F.floor((size + 1101) * STEPS).cast("int")
    return F.when(F.isnan(v), F.lit(1 << 30)).when(v == 0, F.lit(0)).when(v > 0, step).otherwise(-step)


def _same(left: DataFrame, right: DataFrame, on: Sequence[str], small: bool) -> DataFrame:
    """Inner join in which nulls of the keys are equal; the columns of on come once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    equal = F.lit(True)
    for i, c in enumerate(on):
        equal = equal & F.col(c).eqNullSafe(F.col(f"_r_{i}"))
    joined = left.join(F.broadcast(renamed) if small else renamed, equal)
    return joined.select(*left.columns, *[c for c in renamed.columns if not c.startswith("_r_")])


def _holding(groups: DataFrame, path: Sequence[str], by: str) -> DataFrame:
    """Of groups (path, by, _lo, _hi, _n, _before, _ranks) those that hold ranks, with only these
    and with what lies before the group."""
    upto = F.sum("_n").over(Window.partitionBy(*path).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    placed = groups.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    own = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_upto")))
    return placed.withColumn("_ranks", own).filter(F.size("_ranks") > 0).select(*path, by, "_lo", "_hi", "_before", "_ranks")


def column_quantiles(df: DataFrame, values: Mapping[str, Column], at: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles of several numeric columns as doubles, by key if there are
    any: the keys and a column "<value>_<name>" for each value and name. Nulls are left out;
    a column without values has nulls (no row for keys that have none at all).

    By selection, in two scans whatever the columns, keys and ranks: counts by magnitude say
    which group holds a rank; the values of those groups alone are counted, first in
    ``PARTS`` even parts, then in the part that holds the rank. A group of one value is done
    at once. Nothing sorts more than the values of one such part, some 4 million at most.
    """
    names, cols = list(values), list(at)
    each = [F.struct(F.lit(i).alias("_c"), values[n].cast("double").alias("_v")) for i, n in enumerate(names)]
    rows = df.select(*keys, F.inline(F.array(*each))) if len(each) > 1 else df.select(*keys, F.lit(0).alias("_c"), each[0]["_v"].alias("_v"))
    rows = rows.filter("_v is not null").withColumn("_a", magnitude(F.col("_v")))
    one, two, three = [[*keys, "_c"], [*keys, "_c", "_a"], [*keys, "_c", "_a", "_b"]]
    small = not keys  # then at most two rows for each value and name

    counts = rows.groupBy(*two).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    place = [(F.sum("_n").over(Window.partitionBy(*one)) - 1) * F.lit(float(at[n])) for n in cols]
    ranks = [F.struct(F.lit(2 * j + k).alias("i"), end(p).cast("long").alias("rank"), p.alias("place")) for j, p in enumerate(place) for k, end in enumerate((F.floor, F.ceil))]
    first = _holding(counts.withColumns({"_ranks": F.array(*ranks), "_before": F.lit(0).cast("long")}), one, "_a")
    wide = first.filter("_lo < _hi")

    ends = wide.select(*two, "_lo", "_hi")
    if small:
        inside = _same(rows, ends, two, True)
    else:  # counted before they move
        inside = _same(rows.groupBy(*two, "_v").agg(F.count("*").alias("_m")), ends, two, False)
    part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS).cast("int").alias("_b")
    many = F.count("*") if small else F.sum("_m")
    counted = inside.groupBy(*two, part, "_v").agg(many.alias("_n"))
    counts = counted.groupBy(*three).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_n"))
    second = _holding(_same(counts, wide.select(*two, "_before", "_ranks"), two, small), two, "_b")
    narrow = second.filter("_lo < _hi").select(*three, "_before", "_ranks")

    last = _same(counted, narrow, three, small).withColumns({"_lo": F.col("_v"), "_hi": F.col("_v")})
    third = _holding(last, three, "_v")
    found = first.filter("_lo = _hi").select(*one, "_lo", "_ranks")
    found = found.unionByName(second.filter("_lo = _hi").select(*one, "_lo", "_ranks")).unionByName(third.select(*one, "_lo", "_ranks"))
    found = found.select(*one, F.col("_lo").alias("_v"), F.inline("_ranks"))
    ends = {}
    for c in range(len(names)):
        for j in range(len(cols)):
            for what, i, x in (("lo", 2 * j, "_v"), ("hi", 2 * j + 1, "_v"), ("at", 2 * j, "place")):
                ends[f"_{what}_{c}_{j}"] = F.max(F.when((F.col("_c") == c) & (F.col("i") == i), F.col(x)))
    one_row = found.groupBy(*keys).agg(*[v.alias(n) for n, v in ends.items()])

    def between(c: int, j: int) -> Column:
        low, high, p = (F.col(f"_{what}_{c}_{j}") for what in ("lo", "hi", "at"))
        exact = F.floor(p) == F.ceil(p)
        return F.when(exact | (low == high), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return one_row.select(*keys, *[between(c, j).alias(f"{n}_{m}") for c, n in enumerate(names) for j, m in enumerate(cols)])


def quantiles(df: DataFrame, value: Column, at: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """column_quantiles() of one column: the keys and a column for each name."""
    found = column_quantiles(df, {"_q": value}, at, keys)
    return found.select(*keys, *[F.col(f"_q_{n}").alias(n) for n in at])
