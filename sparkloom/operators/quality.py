"""Profiles, missing values, duplicates, orphans, domain checks and gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import on_grid, pct
from ..functions.text import is_blank


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def melt(row: DataFrame, parts: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]) -> DataFrame:
    """One row for each part of a one-row table: its label, then its values by name."""
    structs = [F.struct(F.lit(label).alias(names[0]), *[v.alias(n) for v, n in zip(values, names[1:], strict=True)]) for label, values in parts]
    return row.select(F.inline(F.array(*structs)))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, null cells, rows beyond the first of equal ones."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(missing(df, c)) for c in df.columns])
    cells = df.agg(F.count("*").alias("n_rows"), nulls.cast("long").alias("null_cells"))
    distinct = df.distinct().agg(F.count("*").alias("distinct_rows"))
    return cells.crossJoin(distinct).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "null_cells",
        (F.col("n_rows") - F.col("distinct_rows")).alias("duplicate_rows"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Per column: column_name, missing, pct (4 decimals)."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(missing(df, c)).alias(c) for c in df.columns])
    parts = [(c, [F.col(c), pct(F.col(c), F.col("_n"), 4)]) for c in df.columns]
    return melt(row, parts, ["column_name", "missing", "pct"])


def distinct_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per column the exact number of its distinct values, nulls left out."""
    row = df.agg(*[F.count_distinct(c).alias(c) for c in names])
    return melt(row, [(c, [F.col(c)]) for c in names], ["column_name", "n_distinct"])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often beyond the first."""
    n = df.groupBy(*keys).agg((F.count("*") - 1).alias("extra"))
    return n.filter("extra > 0")


def duplicate_examples(df: DataFrame, keys: Sequence[str], most: int = 5) -> DataFrame:
    """One row: extra, the rows beyond the first of their key, and examples, the first keys as text."""
    found = duplicate_keys(df, keys)
    few = found.orderBy(*keys).limit(most)
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    listed = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, text.alias("_text")))), lambda x: x["_text"]), ", ").alias("examples"))
    return found.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra")).crossJoin(F.broadcast(listed))


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, most: int = 10) -> DataFrame:
    """The first keys of the child that the parent does not have; nulls are no keys."""
    keys = child.select(child_key).filter(F.col(child_key).isNotNull()).distinct()
    known = parent.select(F.col(parent_key).alias("_p")).distinct()
    return keys.join(known, F.col(child_key) == F.col("_p"), "left_anti").orderBy(child_key).limit(most)


def describe_objects(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per text column: n, uniques, top (the most frequent, the first of equals), freq."""
    parts = []
    for c in names:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("f"))
        parts.append(counts.agg(
            F.lit(c).alias("column_name"), F.coalesce(F.sum("f"), F.lit(0)).alias("n"), F.count("*").alias("uniques"),
            F.min_by("v", F.struct(-F.col("f"), "v")).alias("top"), F.max("f").alias("freq"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flag_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with is_duplicate: true on every row of a key that occurs more than once."""
    return df.withColumn("is_duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, label: str) -> DataFrame:
    """One row: relation, child rows, orphans (null keys too), pct (4 decimals).

    The children are counted by key first, so the join sees each key once.
    """
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    by_key = child.groupBy(F.col(child_key).alias("_c")).agg(F.count("*").alias("n"))
    met = by_key.join(keys, by_key["_c"] == keys["_p"], "left")
    return met.agg(
        F.lit(label).alias("relation"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
    ).withColumn("pct", pct(F.col("orphans"), F.col("child_rows"), 4))


def grid_check(df: DataFrame, name: str, low: float, high: float, step: float) -> DataFrame:
    """One row: total, out_of_range, off_grid (of those in range), valid."""
    c = F.col(name)
    inside = c.between(low, high)
    grid = on_grid(c, low, step)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~inside).alias("out_of_range"),
        F.count_if(inside & ~grid).alias("off_grid"),
        F.count_if(inside & grid).alias("valid"),
    )


def id_checks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per id column: missing, negative (0 passes), non_integer."""
    aggs = []
    for c in names:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_m"), F.count_if(F.col(c) < 0).alias(f"{c}_n"),
                 F.count_if(F.col(c) % 1 != 0).alias(f"{c}_f")]
    parts = [(c, [F.col(f"{c}_m"), F.col(f"{c}_n"), F.col(f"{c}_f")]) for c in names]
    return melt(df.agg(*aggs), parts, ["column_name", "missing", "negative", "non_integer"])


def null_or_blank_cells(df: DataFrame) -> DataFrame:
    """Per string column its null and its blank cells."""
    names = [c for c, kind in df.dtypes if kind == "string"]
    aggs = []
    for c in names:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_n"), F.count_if(F.col(c).isNotNull() & is_blank(F.col(c))).alias(f"{c}_b")]
    parts = [(c, [F.col(f"{c}_n"), F.col(f"{c}_b")]) for c in names]
    return melt(df.agg(*aggs), parts, ["column_name", "null_cells", "blank_cells"])


def schema_check(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Per column that is missing or extra: column_name, problem."""
    rows = [(c, "missing") for c in expected if c not in df.columns]
    rows += [(c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column_name string, problem string")


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule (an aggregate condition): check_name, passed; null counts as failed."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    return melt(row, [(n, [F.col(n)]) for n in rules], ["check_name", "passed"])


def gate(results: DataFrame) -> DataFrame:
    """One row: status PASS when every check passed, else FAIL, and how many failed."""
    failed = F.count_if(~F.col("passed"))
    return results.agg(F.when(failed == 0, "PASS").otherwise("FAIL").alias("status"), failed.alias("failed"))


def first_failing_rule(df: DataFrame, rules: Sequence[tuple[str, Column]], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with rule: the first rule a row breaks, "duplicate" for later rows of a key
    among those that break none, else "kept"."""
    rule = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        rule = F.when(broken, F.lit(name)).otherwise(rule)
    judged = df.withColumn("_rule", rule)
    nth = F.row_number().over(Window.partitionBy(F.col("_rule").isNull(), *keys).orderBy(*order))
    later = F.when(F.col("_rule").isNull() & (nth > 1), F.lit("duplicate")).otherwise(F.coalesce("_rule", F.lit("kept")))
    return judged.withColumn("rule", later).drop("_rule")


def rule_log(judged: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Rules in order: step, rule, removed, retained after the step."""
    counts = judged.groupBy("rule").agg(F.count("*").alias("n"))
    names = [*rules, "duplicate"]
    steps = judged.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "step int, rule string")
    total = judged.agg(F.count("*").alias("total"))
    removed = F.coalesce("n", F.lit(0))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.join(F.broadcast(counts), "rule", "left")
        .crossJoin(total)
        .select("step", "rule", removed.alias("removed"), (F.col("total") - F.sum(removed).over(upto)).alias("retained"))
    )


def dataset_gate(df: DataFrame, text: str, label: str, canonical: Sequence[str], least_rows: int, least_per_class: int, most_ratio: float) -> DataFrame:
    """Whether labelled texts are fit to learn from: check_name, level, observed, passed.

    Errors are too few rows, blank texts, blank labels, labels that are not canonical and canonical
    labels with too few rows; a largest class beyond most_ratio times the smallest is a warning.
    The last row says whether no error was found. Classes of the canonical labels, a handful, are
    all that is put together.
    """
    said = F.trim(F.coalesce(label, F.lit("")))
    rows = df.select(said.alias("_said"), (F.trim(F.coalesce(text, F.lit(""))) == "").alias("_blank"))
    per = rows.groupBy("_said").agg(F.count("*").alias("n"), F.count_if("_blank").alias("blank"))
    known = F.col("_said").isin(*canonical)
    wanted = df.sparkSession.createDataFrame([(c,) for c in canonical], "_want string")
    sized = wanted.join(per, F.col("_want") == F.col("_said"), "left").agg(
        F.count_if(F.coalesce("n", F.lit(0)) < least_per_class).alias("small"), (F.max("n") / F.min("n")).alias("ratio")
    )
    one = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(F.col("_said") == "", F.col("n"))), F.lit(0)).alias("unlabelled"),
        F.coalesce(F.sum(F.when(~known & (F.col("_said") != ""), F.col("n"))), F.lit(0)).alias("unknown"),
    ).crossJoin(sized)
    found = (
        ("rows", "error", "rows", F.col("rows") >= least_rows), ("blank_texts", "error", "blank", F.col("blank") == 0),
        ("blank_labels", "error", "unlabelled", F.col("unlabelled") == 0), ("unknown_labels", "error", "unknown", F.col("unknown") == 0),
        ("small_classes", "error", "small", F.col("small") == 0), ("imbalance", "warning", "ratio", F.coalesce(F.col("ratio") <= most_ratio, F.lit(False))),
    )
    checks = [F.struct(F.lit(n).alias("check_name"), F.lit(k).alias("level"), F.round(F.col(c).cast("double"), 6).alias("observed"), ok.alias("passed")) for n, k, c, ok in found]
    bad = sum((F.when(~ok, 1).otherwise(0) for _, k, _, ok in found if k == "error"), F.lit(0))
    last = F.struct(F.lit("is_valid").alias("check_name"), F.lit("result").alias("level"), bad.cast("double").alias("observed"), (bad == 0).alias("passed"))
    return one.select(F.inline(F.array(*checks, last)))
