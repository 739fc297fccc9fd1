"""Source divergence audit: how the words of each source differ from those of the others.

1. Every task counts in how many of its documents a term is and adds that to a
   count-min sketch by language. The sketches are merged slice by slice; counters stop
   at ``CEILING``, so a merged estimate is never below the document frequency or that.
2. Occurrences by (language, source, term) are counted in the tasks. Terms whose
   estimate is below the threshold cannot be kept and go before the shuffle; the others
   are counted exactly, and those in too few documents go then.
3. Two sources of a language are compared over all kept terms, but only terms that a
   source has are looked at. With f0 for a term that neither has, the sum is
   V * f0, plus what the terms of the first change and what the terms of the second
   change (both by their distinct counts, a few for each source), plus what a term of
   both changes beyond that, from a join of the sparse counts with themselves.

Probabilities are integers of a thousand-millionth; all arithmetic is exact.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, column, hash_words, materialize, mix64, prepare, tidy

#: Rows of the sketch, and counters of a row: four for each document within these bounds, one byte each.
DEPTH = 3
LEAST_WIDTH, MOST_WIDTH = 1 << 18, 1 << 24
_SLICE = 1 << 16
#: Where counters stop; thresholds above it count as it in the sketch.
CEILING = 255
#: Terms a task holds before it hands on what it has counted.
HELD = 900_000
#: Bytes of a text that are split at once.
_PIECE = 1 << 20
#: Ranks of the term part.
TOP = 200
UNIT = 1_000_000_000

_LETTERS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SALTS = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0x632BE59BD9B4E019))


def terms(raw: bytes | None) -> Iterator[list[bytes]]:
    """Runs of ASCII letters, lower-cased, and non-ASCII characters; long texts in pieces."""
    folded = (raw or b"").translate(_LETTERS)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + _PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _slots(lang: bytes, names: list[bytes], width: int) -> list[np.ndarray]:
    """By row of the sketch, the counter of each term of one language."""
    own = hash_words([b" ".join(names)])[0] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))
    return [(mix64(own * salt + np.uint64(d)) & np.uint64(width - 1)).astype(np.int64) for d, salt in enumerate(_SALTS[:DEPTH])]


class TermSketch:
    """A merged count-min sketch of document frequencies."""

    def __init__(self, counters: np.ndarray) -> None:
        self.counters = counters  # DEPTH rows of bytes

    def may_reach(self, lang: bytes, names: list[bytes], least: int) -> np.ndarray:
        """False only for terms that are in fewer than least documents of the language."""
        found = [row[at] for row, at in zip(self.counters, _slots(lang, names, self.counters.shape[1]), strict=True)]
        return np.minimum.reduce(found) >= min(least, CEILING)


def sketch_width(documents: int) -> int:
    width = LEAST_WIDTH
    while width < MOST_WIDTH and width < 4 * documents:
        width *= 2
    return width


def build_sketch(rows: DataFrame, width: int) -> TermSketch:
    """rows: lang and text, neither lang null. DEPTH * width bytes, whatever the input."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((DEPTH, width), np.int32)
        held: dict[bytes, Counter] = defaultdict(Counter)

        def flush() -> None:
            for lang, counts in held.items():
                many = np.fromiter(counts.values(), np.int32, len(counts))
                for row, at in zip(counters, _slots(lang, list(counts), width), strict=True):
                    np.add.at(row, at, many)
            np.minimum(counters, CEILING, out=counters)
            held.clear()

        for batch in batches:
            for lang, raw in zip(binary_column(batch, "lang"), binary_column(batch, "text"), strict=True):
                own: set[bytes] = set()
                for piece in terms(raw):
                    own.update(piece)
                if own:
                    held[lang].update(own)
            if sum(map(len, held.values())) > HELD:
                flush()
        flush()
        flat = counters.astype(np.uint8).reshape(-1)
        found = [(k, flat[k * _SLICE : (k + 1) * _SLICE]) for k in range(len(flat) // _SLICE)]
        found = [(k, zlib.compress(x.tobytes(), 1)) for k, x in found if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], schema=schema)

    shape = "slice int, counts binary"
    parts = rows.select("lang", "text").mapInArrow(tidy(scan), shape)
    spread = parts.repartition("slice", F.substring(F.md5("counts"), 1, 1)).mapInArrow(tidy(_add_slices), shape)
    merged = spread.repartition("slice").mapInArrow(tidy(_add_slices), shape)
    flat = np.zeros(DEPTH * width, np.uint8)
    for row in merged.collect():  # DEPTH * MOST_WIDTH bytes at most
        flat[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint8)
    return TermSketch(flat.reshape(DEPTH, width))


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(column(batch, "slice"), binary_column(batch, "counts"), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.uint16)
            held[k] = np.minimum(held[k] + part, CEILING) if k in held else part
    packed = [zlib.compress(x.astype(np.uint8).tobytes(), 1) for x in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])


def candidate_counts(rows: DataFrame, sketch: TermSketch, least_docs: int) -> DataFrame:
    """(lang, source, term, n, docs) of terms that may be kept, summed in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    names = ("lang", "source", "term")
    schema = pa.schema([(n, pa.string()) for n in names] + [("n", pa.int64()), ("docs", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
        within: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in occurs.items():
                found, docs = list(counts), within[lang, source]
                may = pa.array(shared.value.may_reach(lang, found, least_docs))
                term = pa.array(found, pa.binary()).filter(may).cast(pa.string())
                many = [np.fromiter(x, np.int64, len(found)) for x in (counts.values(), map(docs.__getitem__, found))]
                if len(term):
                    group = [pa.repeat(pa.scalar(x.decode(), pa.string()), len(term)) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*group, term, *(pa.array(x).filter(may) for x in many)], schema=schema)
            occurs.clear()
            within.clear()

        for batch in batches:
            for lang, source, raw in zip(*(binary_column(batch, c) for c in ("lang", "source", "text")), strict=True):
                own: set[bytes] = set()
                for piece in terms(raw):
                    occurs[lang, source].update(piece)
                    own.update(piece)
                if own:
                    within[lang, source].update(own)
            if sum(map(len, occurs.values())) > HELD:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(tidy(scan), "lang string, source string, term string, n long, docs long")


def _p(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)); null where nothing is kept."""
    size = F.nullif(total + kept, F.lit(0))
    wide = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    small = F.call_function("div", (count + 1) * UNIT, size)  # the product fits a long
    return F.when(count < 9 * UNIT, small).otherwise(F.call_function("div", wide, size.cast("decimal(20,0)"))) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, total) of the kept terms with their occurrences in the source and
    in the language, and (lang, source, size, lang_size, kept) of every group that occurs."""
    prepare(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").alias("text"))
    sketch = build_sketch(rows, sketch_width(docs.count()))
    # the tasks have summed already: one exchange by term serves the sums and the window
    found = candidate_counts(rows, sketch, least_docs).repartition("lang", "term")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("all_docs"),
        (F.col("source") == F.min("source").over(term)).cast("long").alias("leads"),
    )
    kept = materialize(whole.filter(F.col("all_docs") >= least_docs).drop("all_docs"), "kept-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("leads").alias("leads"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["size", "leads"])
    lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "size", F.sum("size").over(lang).alias("lang_size"), F.sum("leads").over(lang).alias("kept"))
    return kept.drop("leads"), materialize(groups, "term-groups")


def term_divergence(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): terms more likely in the source than in the language."""
    rows = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        _p(F.col("n"), F.col("size"), F.col("kept")).alias("p"), _p(F.col("total"), F.col("lang_size"), F.col("kept")).alias("q"),
    )
    rows = rows.filter("p > q").select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def pair_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language."""
    groups = groups.select("lang", "source", "size", "kept", _p(F.lit(0), F.col("size"), F.col("kept")).alias("none"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    sparse = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", _p(F.col("n"), F.col("size"), F.col("kept")).alias("p"), "none")
    f0 = _f(F.col("none"), F.col("other_none"))
    # what the terms of one of the two change, by their distinct probabilities
    alone = sparse.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("m"))
    alone = alone.join(others, "lang").filter("source <> item")
    first = F.col("m") * (_f(F.col("p"), F.col("other_none")) - f0)
    second = F.col("m") * (_f(F.col("other_none"), F.col("p")) - _f(F.col("other_none"), F.col("none")))
    both_ways = F.explode(F.array(F.struct("source", "item", first.alias("change")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), second.alias("change"))))
    alone = alone.select("lang", both_ways.alias("x")).select("lang", "x.*").groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    # what a term of both changes beyond that
    other = sparse.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("none").alias("other_none"))
    p, q = F.col("p"), F.col("other_p")
    more = _f(p, q) - _f(p, F.col("other_none")) - _f(F.col("none"), q) + f0
    both = sparse.join(other, ["lang", "term"]).filter("source <> item").select("lang", "source", "item", more.alias("change"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    changes = alone.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    pairs = groups.join(others, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * f0, F.lit(0)).alias("base"))
    pairs = pairs.join(changes, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.col("base") + F.coalesce("change", F.lit(0))).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(best))


def report(docs: DataFrame, least_docs: int = 3, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts.

    Null text, lang and source count as ''. Every row is a document, also where rows
    repeat. Groups without terms have pairs with the others of their language; a language
    of which no term is kept has pairs of value 0. Other columns are not looked at; an
    empty table gives no rows.
    """
    kept, groups = kept_terms(docs, least_docs)
    parts = [
        rows.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
        for name, rows in (("pair", pair_divergence(kept, groups)), ("term", term_divergence(kept, groups, top)))
    ]
    return parts[0].unionByName(parts[1])
