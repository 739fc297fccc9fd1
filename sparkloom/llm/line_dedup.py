"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; it is known
by a 128-bit hash. The documents come in batches. Each batch counts in how many of its
documents a key is, leaves out by a merge-anti-join what the runs already know to be
frequent, and adds the rest as a run of its own, sorted by hash. Runs of one level are
compacted to one run of the next level when there are ``FANOUT`` of them, so a key is
written once a level and there are few runs at any time. After the last batch one more
merge gives the keys that are in enough documents, and every document loses their lines.

All of it is built-in functions. The text of a document moves once, to meet the places
of its dropped lines; lines themselves never move, only their hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

#: Runs of a level that are compacted to one of the next.
FANOUT = 3
#: Batches into which the files of one table are dealt.
BATCHES = 8
#: Frequent keys (some 64 bytes each) up to which they are broadcast; beyond, joined with SALTS copies of each.
BROADCAST_KEYS, SALTS = 400_000, 16

_WHITE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def key_counts(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, docs): rows of docs in which a key is, summed in each task before the shuffle."""
    keys = F.array_distinct(F.transform(_lines(F.col("text")), line_key))
    rows = docs.select(F.explode(keys).alias("key")).filter(F.char_length("key") >= least_chars)
    return rows.select(*_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("docs"))


class LineRuns:
    """Sorted runs of (h1, h2, docs) in levels."""

    def __init__(self, least_docs: int, least_chars: int = 1, fanout: int = FANOUT) -> None:
        self.least_docs, self.least_chars, self.fanout = least_docs, least_chars, max(2, fanout)
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Count the batch, leave out what is known to be frequent, add the rest as a run."""
        own = key_counts(batch, self.least_chars)
        if found := self.runs():
            known = _union(found).filter(F.col("docs") >= self.least_docs).select("h1", "h2").distinct()
            own = own.join(known, ["h1", "h2"], "left_anti")
        self._store(0, own)

    def _store(self, level: int, rows: DataFrame) -> None:
        run = materialize(rows.sortWithinPartitions("h1", "h2"), f"lines-{level}")
        if level == len(self.levels):
            self.levels.append([])
        own = self.levels[level]
        own.append(run)
        if len(own) >= self.fanout:
            self.levels[level] = []
            self._store(level + 1, _merged(own))
            for old in own:
                drop_materialized(old)

    def frequent(self) -> DataFrame | None:
        """(h1, h2) of the keys in at least least_docs rows of all batches; None before the first."""
        found = self.runs()
        rows = _merged(found) if len(found) > 1 else found[0] if found else None
        return None if rows is None else rows.filter(F.col("docs") >= self.least_docs).select("h1", "h2")

    def drop(self) -> None:
        """Delete the runs."""
        for run in self.runs():
            drop_materialized(run)
        self.levels = []


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _merged(runs: list[DataFrame]) -> DataFrame:
    return _union(runs).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))


def file_batches(table: DataFrame, most: int = BATCHES) -> list[DataFrame]:
    """A table read from Parquet files as up to most tables over some of its files each."""
    files = sorted(table.inputFiles())
    if len(files) < 2:
        return [table]
    groups = [files[k::most] for k in range(min(most, len(files)))]
    return [table.sparkSession.read.schema(table.schema).parquet(*group) for group in groups]


def _kept(lines: Column, gone: Column) -> Column:
    """Lines but those at the ascending places (from 0) in gone: the slices between them."""
    begin = F.concat(F.array(F.lit(-1)), gone)
    end = F.concat(gone, F.array(F.size(lines)))
    slices = F.zip_with(begin, end, lambda b, e: F.slice(lines, b + 2, e - b - 1))
    return F.when(F.size(gone) == 0, lines).otherwise(F.flatten(slices))


def without_frequent(docs: DataFrame, frequent: DataFrame, least_chars: int = 1) -> DataFrame:
    """doc_id, lines, kept (both arrays of strings) of every row, without the lines of frequent keys."""
    row = [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("r2")]
    named = docs.select("doc_id", "text", *row)
    lines = named.select("r1", "r2", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("r1", "r2", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    keys = keys.select("r1", "r2", "pos", *_hashes(F.col("key")))
    if frequent.count() <= BROADCAST_KEYS:
        hits = keys.join(F.broadcast(frequent), ["h1", "h2"])
    else:  # the rows of a hot key are dealt out over its copies
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = keys.withColumn("salt", F.pmod(F.xxhash64("r1", "pos"), F.lit(SALTS)).cast("int"))
        hits = salted.join(frequent.select("h1", "h2", salts), ["h1", "h2", "salt"])
    gone = hits.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    none = F.array().cast("array<int>")
    whole = named.join(gone, ["r1", "r2"], "left").select("doc_id", _lines(F.col("text")).alias("lines"), F.coalesce("gone", none).alias("gone"))
    return whole.select("doc_id", "lines", _kept(F.col("lines"), F.col("gone")).alias("kept"))


def dedup_lines(docs: DataFrame, batches: list[DataFrame] | None = None, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """Per row: doc_id, lines, kept. Lines whose key is in least_docs rows or more go everywhere.

    batches: docs in parts that come one after another (one batch by default). A null text
    is one empty line. Every row is a document, also where rows repeat; a key counts once
    for each. Keys of fewer than least_chars code points never go. Only doc_id (of any
    type, null too) and text are looked at; an empty table gives no rows.
    """
    runs = LineRuns(least_docs, least_chars)
    for batch in batches or [docs]:
        runs.add(batch)
    frequent = materialize(runs.frequent(), "frequent-lines")
    runs.drop()
    return without_frequent(docs, frequent, least_chars)


def report(docs: DataFrame, batches: list[DataFrame] | None = None, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines joined by \\n)."""
    rows = dedup_lines(docs, batches, least_docs, least_chars)
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )
