"""Shared pieces of the training-data operators: words, hashes, shared storage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch handed to Python; whole documents are long.
BATCH_ROWS = 256

_UPPER_TO_LOWER = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1))
)
_ALNUM_OR_HIGH = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b)
    if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)


def plain_words(raw: bytes | None) -> list[bytes]:
    """Runs without ASCII white space (space, \\t to \\r), unchanged. Null: none."""
    return raw.split() if raw else []


def lower_words(raw: bytes | None) -> list[bytes]:
    """The same after lower-casing A-Z only."""
    return raw.translate(_UPPER_TO_LOWER).split() if raw else []


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII digits, lower-cased ASCII letters and non-ASCII characters."""
    return raw.translate(_ALNUM_OR_HIGH).split() if raw else []


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])
#: By number of bytes left in a word, the bits of its next eight bytes that count.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one, so that no pass is made for each eight of their bytes.
_LONG_WORD = 64
_LONGEST_RUN = 1 << 20


def hash_words(raws: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all texts, and the number by text.

    A word's hash depends on the word alone. Its bytes go eight at a time through a
    finaliser that is not linear, so no pattern of bytes cancels out; words of eight
    bytes or less with the same length never share a hash.
    """
    hashes, counts = [], []
    run: list[bytes] = []
    size = 0
    for raw in raws:
        if run and size + len(raw or b"") > _LONGEST_RUN:
            h, c = _hash_run(run, lower)
            hashes.append(h)
            counts.append(c)
            run, size = [], 0
        run.append(raw or b"")
        size += len(raw or b"") + 1
    if run:
        h, c = _hash_run(run, lower)
        hashes.append(h)
        counts.append(c)
    if not counts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _hash_run(run: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = b" ".join(run) + b" " * 9
    if lower:
        joined = joined.translate(_UPPER_TO_LOWER)
    space = _SPACE[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    begin, end = edges[::2], edges[1::2]
    ends = np.cumsum([len(r) + 1 for r in run])
    return _word_hashes(joined, begin, end), np.diff(np.searchsorted(begin, ends), prepend=0)


def _word_hashes(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words at the places given; eight bytes at least follow the last."""
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    size = end - begin
    h = size.astype(np.uint64) * _GOLD
    long = size > _LONG_WORD
    live, at, left = slice(None), begin, np.where(long, 0, size)
    while True:
        own = (eight[at] & _MASK[np.minimum(left, 8)]) ^ h[live]
        h[live] = mix64(own * _MIX2 + _GOLD)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(long).tolist():
        h[k] = xxhash.xxh3_64_intdigest(joined[begin[k] : end[k]])
    return h


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-word windows, in order; empty when too short."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for i in range(1, n):
        h = mix64(h * _GOLD + words[i : m + i])
    return h


def grams_at(words: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows at some places only."""
    h = words[places].copy()
    for i in range(1, n):
        h = mix64(h * _GOLD + words[places + i])
    return h


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _trim() -> None:
    """Hand freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that leaves its worker small at the end of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        _trim()

    return run


def package_archive() -> str:
    """This library as an archive for machines that do not see the driver's checkout."""
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="sparkloom-code-")) / "sparkloom.zip"
    atexit.register(shutil.rmtree, out.parent, ignore_errors=True)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted((root / "sparkloom").rglob("*")):
            if path.suffix in (".py", ".txt"):
                archive.write(path, path.relative_to(root))
    return str(out)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since texts are long, and this package for the workers.

    The batch size is set where it is the default or larger; a smaller one stays. Workers on
    this machine read the checkout; on a cluster they are sent an archive of it.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS or int(spark.conf.get(rows)) <= 0:
        spark.conf.set(rows, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        environment = context.environment
        if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    elif context.applicationId not in _shipped:
        context.addPyFile(package_archive())
        _shipped.add(context.applicationId)
    return spark


_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all
    executors are on this machine."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:  # not stopped
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    The copy survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sparkloom/" in parent:
            _delete(df.sparkSession, parent)
