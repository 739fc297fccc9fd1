"""Tables that are replaced by a pointer.

A version is a folder of Parquet files that is never changed. What readers see is named
by the last pointer: a small file with a number, written once the version is complete
and counted. So a reader finds the old table or the new one, never none or a part, and
a writer that fails leaves the old one in place. A pointer that was cut off is passed
over. Two writers cannot write the same number; the second one fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_POINTERS = "_pointers"


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    rows: int
    notes: dict = field(default_factory=dict)


def _path(spark: SparkSession, path: str) -> tuple:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str:
    own, fs = _path(spark, path)
    stream = fs.open(own)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _numbers(spark: SparkSession, base: str) -> list[int]:
    root, fs = _path(spark, f"{base}/{_POINTERS}")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n) for n in names if n.isdigit())


def versions(spark: SparkSession, base: str) -> list[Version]:
    """All versions with a whole pointer, oldest first."""
    out = []
    for number in _numbers(spark, base):
        try:
            own = json.loads(_read(spark, f"{base}/{_POINTERS}/{number:012d}"))
            out.append(Version(number, own["folder"], own["rows"], own["notes"]))
        except (ValueError, KeyError):  # cut off
            continue
    return out


def current_version(spark: SparkSession, base: str) -> Version | None:
    found = versions(spark, base)
    return found[-1] if found else None


def current(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The table as the last pointer has it, or as a numbered one had it."""
    found = [v for v in versions(spark, base) if number is None or v.number == number]
    if not found:
        raise FileNotFoundError(f"{base}: no version" + ("" if number is None else f" {number}"))
    return spark.read.parquet(f"{base}/{found[-1].folder}")


def _point(spark: SparkSession, base: str, folder: str, rows: int, notes: dict) -> Version:
    number = max(_numbers(spark, base), default=0) + 1
    own, fs = _path(spark, f"{base}/{_POINTERS}/{number:012d}")
    stream = fs.create(own, False)  # fails where the number is taken
    try:
        stream.write(bytearray(json.dumps({"folder": folder, "rows": rows, "notes": notes}), "utf-8"))
    finally:
        stream.close()
    return Version(number, folder, rows, notes)


def replace(df: DataFrame, base: str, keep: int = 5, notes: dict | None = None, expect: int | None = None) -> Version:
    """Write df as a new version, count what is there, and point to it.

    df may read the table it replaces; it is computed once. Where expect is given, another
    number of rows is an error. Of older versions the newest keep - 1 stay.
    """
    spark, folder = df.sparkSession, f"version-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{base}/{folder}")
        there = spark.read.parquet(f"{base}/{folder}").count()
        if expect is not None and there != expect:
            raise OSError(f"{base}: found {there} rows in place of {expect}")
        made = _point(spark, base, folder, there, notes or {})
    except BaseException:
        own, fs = _path(spark, f"{base}/{folder}")
        fs.delete(own, True)
        raise
    clean(spark, base, keep)
    return made


def restore(spark: SparkSession, base: str, number: int) -> Version:
    """Point to an older version again; its files are not copied."""
    found = [v for v in versions(spark, base) if v.number == number]
    if not found:
        raise FileNotFoundError(f"{base}: no version {number}")
    return _point(spark, base, found[0].folder, found[0].rows, found[0].notes)


def clean(spark: SparkSession, base: str, keep: int = 5) -> int:
    """Delete pointers but the newest, and the folders that no kept one names; how many pointers went."""
    found = versions(spark, base)
    gone, stay = found[: -max(1, keep)], {v.folder for v in found[-max(1, keep) :]}
    for v in gone:
        pointer, fs = _path(spark, f"{base}/{_POINTERS}/{v.number:012d}")
        fs.delete(pointer, False)
        if v.folder not in stay:
            own, fs = _path(spark, f"{base}/{v.folder}")
            fs.delete(own, True)
    return len(gone)
