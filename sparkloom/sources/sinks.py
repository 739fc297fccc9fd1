"""Writing results: CSV, JSON, checked and versioned output, and a bounded history."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header. Arrays are joined with commas."""
    flat = {n: F.array_join(n, ",") for n, kind in df.dtypes if kind.startswith("array<string")}
    df.withColumns(flat).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records; arrays stay arrays."""
    df.write.mode(mode).json(path)


def write_both(df: DataFrame, base: str) -> None:
    """The same records twice: base.csv with arrays joined, base.json with arrays kept."""
    write_csv(df, f"{base}.csv")
    write_json(df, f"{base}.json")


def _files(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_checked(df: DataFrame, path: str) -> int:
    """Write Parquet beside the target, count it there against the rows written, and only
    then put it in the target's place. When the check fails the old table is untouched."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    (new, fs), (target, _), (old, _) = (_files(spark, p) for p in (f"{beside}.new", path, f"{beside}.old"))
    held = df.persist(StorageLevel.DISK_ONLY)  # computed once for both the count and the write
    try:
        wrote = held.count()
        held.write.parquet(new.toString())
        read = spark.read.parquet(new.toString()).count()
        if wrote != read:
            raise OSError(f"{path}: wrote {wrote} rows, read {read}")
        if fs.exists(target) and not fs.rename(target, old):
            raise OSError(f"{path}: cannot be moved aside")
        if not fs.rename(new, target):
            fs.rename(old, target)
            raise OSError(f"{path}: cannot be replaced")
        fs.delete(old, True)
    finally:
        held.unpersist()
        fs.delete(new, True)
    spark.catalog.refreshByPath(path)
    return read


def backup(spark: SparkSession, path: str, base: str, version: str, keep: int = 5) -> list[str]:
    """Copy the table at a path to base/version before it is overwritten; nothing where there is none."""
    own, fs = _files(spark, path)
    return write_version(spark.read.parquet(path), base, version, keep) if fs.exists(own) else []


def write_version(df: DataFrame, base: str, version: str, keep: int = 5) -> list[str]:
    """Write base/version and delete all but the newest versions (by name)."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{base}/version={version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(conf)
    found = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    for name in found[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base}/{name}"), True)
    return found[-keep:]


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def clear_history(spark: SparkSession, path: str) -> None:
    own, fs = _files(spark, path)
    fs.delete(own, True)


def cap_history(spark: SparkSession, path: str, by: list[str], cap: int = 10_000) -> int:
    """Keep the newest cap rows of a stored history."""
    return write_checked(newest(spark.read.parquet(path), by, cap, cap), path)


def newest(history: DataFrame, by: list[str], limit: int = 50, cap: int = 10_000) -> DataFrame:
    """The newest rows of a history of which only the newest cap rows count."""
    order = [F.desc(c) for c in by]
    return history.orderBy(*order).limit(min(limit, cap))


def read_history(spark: SparkSession, path: str, by: list[str], limit: int = 50) -> DataFrame:
    return newest(spark.read.parquet(path), by, limit)


def as_json(*columns: str | Column) -> Column:
    """One JSON record for each row."""
    return F.to_json(F.struct(*columns))


def with_header(df: DataFrame) -> DataFrame:
    """JSON lines: the first has the names of the columns, the others one record each."""
    names = F.to_json(F.struct(F.array(*[F.lit(c) for c in df.columns]).alias("headers")))
    head = df.sparkSession.range(1).select(F.lit(0).alias("_n"), names.alias("value"))
    lines = df.select(F.lit(1).alias("_n"), as_json(*df.columns).alias("value"))
    return head.unionByName(lines)


def write_text(df: DataFrame, path: str, line: Column) -> None:
    """One formatted line for each row."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def refreshed(spark: SparkSession, path: str) -> DataFrame:
    """A table read anew after its files have changed."""
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)
