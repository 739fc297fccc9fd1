"""Where word windows of documents repeat: what the two substring operators share.

1. Suffixes are retained at anchors: the n-gram with the smallest hash (the leftmost of
   equals) in the first ``reach_of(window)`` places of a window. Equal windows have the
   same anchor at the same offset, and from it on a prefix in common that is known to
   be window - reach + 1 words long.
2. Prefixes are counted by documents; suffixes whose prefix is in one document only go.
   Of the others the words of the windows that they anchor travel, once for each
   distinct context: copies of a passage are one row, combined before the shuffle.
3. Contexts are dealt out by prefix. A prefix with more than ``GROUP`` contexts is made
   longer: its windows are told apart by their offset to the anchor, which leaves more
   words that all windows of a part share, at last the whole window. So no task holds
   more than ``GROUP`` contexts of one prefix, however many documents share it.
4. Each group is solved by the operator's own structure, which finds for every window
   the first document and place it starts at; contexts lead back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MOST_BITS, Bloom, build_bloom
from .common import (
    as_long,
    binary_column,
    column,
    gram_hashes,
    grams_at,
    hash_words,
    materialize,
    plain_words,
    prepare,
    tidy,
)

#: Words of an anchor's n-gram.
GRAM = 8
#: Contexts of one prefix that a task looks at; a prefix with more is made longer.
GROUP = 1_000
#: Prefixes to be made longer (8 bytes each) up to which they are broadcast; beyond, joined.
BROADCAST_KEYS = 100_000
#: Names of contexts that a task remembers so as not to send their words again.
_SEEN = 200_000
#: Contexts that a task looks at together, of whole prefixes.
TOGETHER = 4_096


def reach_of(window: int, gram: int = GRAM) -> int:
    """Places of a window in which its anchor lies: 18 of the 43 n-grams of 50 words."""
    return max(1, round(0.42 * (window - min(gram, window) + 1)))


def anchors(
    words: np.ndarray, counts: np.ndarray, window: int, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that follow one another in words; counts: words by text.

    Returns for each anchor occurrence the hash of its prefix, its text, place, and the
    first and last window it anchors; places are those in the text.
    """
    none = np.empty(0, np.int64)
    gram = min(gram, window)
    wide = reach_of(window, gram)
    if len(words) < window:
        return np.empty(0, np.uint64), none, none, none, none
    value = gram_hashes(words, gram)
    place, size = np.arange(len(value)), 1
    while size < wide:  # leftmost least of 1, 2, 4, ... and at last of wide places
        step = min(size, wide - size)
        right = value[step:] < value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        size += step
    ends = np.cumsum(counts)
    start = np.arange(len(words) - window + 1)
    place = place[: len(start)]
    text = np.searchsorted(ends, start, side="right")
    inside = start + window <= ends[text]
    start, text, place = start[inside], text[inside], place[inside]
    if not len(start):
        return np.empty(0, np.uint64), none, none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    own = text[first]
    begin = ends[own] - counts[own]
    key = grams_at(words, place[first], window - wide + 1)
    return key, own, place[first] - begin, start[first] - begin, start[last] - begin


def _numbered(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text"
    ).filter("doc_id is not null and text is not null")


def _prefix_rows(docs: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = hash_words(binary_column(batch, "text"))
            key, text, *_ = anchors(words, counts, window)
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()[text]
            order = np.lexsort((ids, as_long(key)))
            key, ids = as_long(key)[order], ids[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(ids[new])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(scan), "key long, doc_id long")


_SEGMENT = pa.schema(
    [("ctx", pa.binary()), ("key", pa.int64()), ("at", pa.int64()), ("words", pa.binary()), ("doc_id", pa.int64()),
     ("tid", pa.int64()), ("place", pa.int64())]
)
_SEGMENT_SHAPE = "ctx binary, key long, at long, words binary, doc_id long, tid long, place long"


def context_name(at: int, words: bytes) -> bytes:
    """A 128-bit name of the words around an anchor and the place of the anchor in them."""
    return hashlib.blake2b(b"%d " % at + words, digest_size=16).digest()


def _segments(docs: DataFrame, shared: Bloom, window: int) -> DataFrame:
    """A row for each occurrence of an anchor whose prefix is shared; the words come with
    the first row of a context that the task remembers."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > _SEEN:
                seen.clear()
            raws = binary_column(batch, "text")
            words, counts = hash_words(raws)
            key, text, place, first, last = anchors(words, counts, window)
            keep = np.flatnonzero(sent.value.may_hold(as_long(key)))
            key, text, place, first, last = (x[keep] for x in (key, text, place, first, last))
            names: list[bytes] = []
            cut: list[bytes | None] = []
            now, own = -1, []
            for t, a, b, p in zip(text.tolist(), first.tolist(), (last + window).tolist(), place.tolist(), strict=True):
                if t != now:
                    now, own = t, plain_words(raws[t])
                around = b" ".join(own[a:b])
                name = context_name(p - a, around)
                names.append(name)
                cut.append(None if name in seen else around)
                seen.add(name)
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            tids = batch.column(batch.schema.get_field_index("tid")).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(as_long(key)), pa.array(place - first), pa.array(cut, pa.binary()),
                 pa.array(ids[text]), pa.array(tids[text]), pa.array(place)], schema=_SEGMENT
            )

    return docs.mapInArrow(tidy(scan), _SEGMENT_SHAPE)


def _distinct(segments: DataFrame) -> DataFrame:
    """One row for each context: ctx, key, at, words, low (first doc_id and place), high (last doc_id)."""
    return segments.groupBy("ctx").agg(
        F.min("key").alias("key"), F.min("at").alias("at"), F.max("words").alias("words"),
        F.min(F.struct("doc_id", "place")).alias("low"), F.max("doc_id").alias("high"),
    )


def _narrowed(contexts: DataFrame, window: int, wide: int) -> DataFrame:
    """Contexts by parts of so many offsets: the windows of a part and a longer prefix.

    A part is that of the windows which start a to b words before the anchor; they all hold
    the words from a before it on, window - b + a of them, and these are the new key.
    """
    schema = pa.schema([("parent", pa.binary()), *_SEGMENT])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = zip(*(column(batch, c) for c in ("ctx", "at", "words", "doc_id", "high", "place")), strict=True)
            for ctx, at, raw, doc, high, place in rows:
                words = raw.split(b" ")
                least = at - (len(words) - window)  # offsets of the windows: least to at
                for q in range(least // wide, at // wide + 1):
                    a, b = max(least, q * wide), min(at, q * wide + wide - 1)
                    own = b" ".join(words[at - b : at - a + window])
                    common = b" ".join(words[at - q * wide : at - (q * wide + wide - 1) + window])
                    key = int.from_bytes(hashlib.blake2b(b"%d %d " % (wide, q) + common, digest_size=8).digest(), "little", signed=True)
                    out.append((ctx, context_name(b, own), key, b, own, doc, high, place))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    flat = contexts.select("ctx", "at", "words", "low.doc_id", "high", "low.place")
    # the last document stands in the column tid of a segment here
    return flat.mapInArrow(tidy(scan), f"parent binary, {_SEGMENT_SHAPE}")


class Contexts:
    """Contexts of whole prefixes, as word numbers one after another, a zero behind each."""

    def __init__(self, at: np.ndarray, words: list[bytes], doc_id: np.ndarray, place: np.ndarray, window: int) -> None:
        self.window, self.at = window, at
        number: dict[bytes, int] = {}
        flat: list[int] = []
        counts = []
        for raw in words:
            own = raw.split(b" ")
            flat += [number.setdefault(w, len(number) + 1) for w in own]
            flat.append(0)
            counts.append(len(own))
        self.ids, self.counts = np.array(flat, np.int64), np.array(counts, np.int64)
        self.begin = np.cumsum(self.counts + 1) - self.counts - 1
        self.doc_id, self.place = doc_id, place
        self.order = np.lexsort((place, doc_id))
        self.rank = np.empty(len(at), np.int64)
        self.rank[self.order] = np.arange(len(at))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of every window, and its number in the row."""
        sizes = self.counts - self.window + 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


#: Given contexts: for every window (as Contexts.windows has them) the rank of the first
#: context that has it.
Finder = Callable[[Contexts], np.ndarray]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key in tables that end with a key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < TOGETHER:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table["key"].to_numpy()
        differ = np.flatnonzero(keys != keys[-1])
        if len(differ):
            at = int(differ[-1]) + 1
            yield table.slice(0, at)
            table = table.slice(at).combine_chunks()
        held, size = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_RUN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])


def _solved(window: int, finder: Finder) -> Callable:
    """Runs of windows by context: start and stop from the anchor on, and the first document
    that has them with the place of its anchor."""
    schema = pa.schema([("ctx", pa.binary()), ("runs", pa.list_(_RUN))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches):
            key, high = table["key"].to_numpy(), table["high"].to_numpy()
            ctx, doc, place = table["ctx"].to_pylist(), table["doc_id"].to_numpy(), table["place"].to_numpy()
            at = table["at"].to_numpy()
            alone = np.ones(len(key), bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[1:] != key[:-1]
            names: list[bytes] = []
            runs: list[list[dict]] = []
            some = np.flatnonzero(alone & (high > doc))
            for k, raw in zip(some.tolist(), table["words"].take(pa.array(some)).to_pylist(), strict=True):
                names.append(ctx[k])
                begin = -int(at[k])
                runs.append([{"start": begin, "stop": begin + raw.count(b" ") + 1, "doc_id": doc[k], "place": place[k]}])
            met = np.flatnonzero(~alone)
            if len(met):
                own = Contexts(at[met], table["words"].take(pa.array(met)).to_pylist(), doc[met], place[met], window)
                row, inner = own.windows()
                first = own.order[finder(own)]
                keep = np.flatnonzero(own.doc_id[first] < high[met][row])
                row, inner, first = row[keep], inner[keep], first[keep]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1) | (first[1:] != first[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(row)) - 1
                starts, stops = inner[begin] - own.at[row[begin]], inner[end] - own.at[row[begin]] + window
                now = -1
                for r, a, b, f in zip(row[begin].tolist(), starts.tolist(), stops.tolist(), first[begin].tolist(), strict=True):
                    if r != now:
                        now = r
                        names.append(ctx[met[r]])
                        runs.append([])
                    runs[-1].append({"start": a, "stop": b, "doc_id": own.doc_id[f], "place": own.place[f]})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(runs, pa.list_(_RUN))], schema=schema)

    return scan


def repeated_spans(documents: DataFrame, window: int, finder: Finder, label: str, group: int | None = None) -> DataFrame:
    """Per document with any: doc_id, tid (xxhash64 of the text), spans.

    spans: start, stop (word places), first_doc_id and first_start of runs of windows
    whose word sequence also starts in a document with a smaller doc_id, at first_start
    there; it is the first such document and the first place in it.
    """
    prepare(documents.sparkSession)
    group = GROUP if group is None else group
    docs = _numbered(documents)
    counted = _prefix_rows(docs, window).groupBy("key")
    ends = counted.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialize(ends.filter("low < high").select("key"), f"{label}-prefixes")
    n_shared = shared.count()
    segments = _segments(docs, build_bloom(shared, n_shared), window)
    if 16 * n_shared > MOST_BITS:  # the filter lets too much through
        segments = segments.join(shared, "key", "left_semi")
    segments = materialize(segments.select("ctx", "key", "at", "words", "doc_id", "tid", "place"), f"{label}-segments")
    contexts = _distinct(segments)
    places = segments.select("ctx", "doc_id", "tid", "place")
    spans, wide = [], reach_of(window)
    while True:
        contexts = materialize(contexts, f"{label}-contexts")
        many = materialize(contexts.groupBy("key").count().filter(F.col("count") > group).select("key"), f"{label}-many")
        n_many = many.count() if wide > 1 else 0
        few = contexts
        if n_many:
            many = F.broadcast(many) if n_many <= BROADCAST_KEYS else many
            few = contexts.join(many, "key", "left_anti")
        rows = few.select("ctx", "key", "at", "words", "low.doc_id", "low.place", "high")
        rows = rows.repartition("key").sortWithinPartitions("key", "ctx")
        solved = rows.mapInArrow(tidy(_solved(window, finder)), "ctx binary, runs array<struct<start: long, stop: long, doc_id: long, place: long>>")
        found = places.join(solved, "ctx").select("doc_id", "tid", "place", F.explode("runs").alias("run"))
        spans.append(found.filter("run.doc_id < doc_id").select(
            "doc_id", "tid", (F.col("place") + F.col("run.start")).alias("start"), (F.col("place") + F.col("run.stop")).alias("stop"),
            F.col("run.doc_id").alias("first_doc_id"), (F.col("run.place") + F.col("run.start")).alias("first_start"),
        ))
        if not n_many:
            break
        wide = max(1, wide // 3)
        parts = materialize(_narrowed(contexts.join(many, "key", "left_semi"), window, wide), f"{label}-parts")
        contexts = parts.groupBy("ctx").agg(
            F.min("key").alias("key"), F.min("at").alias("at"), F.max("words").alias("words"),
            F.min(F.struct("doc_id", "place")).alias("low"), F.max("tid").alias("high"),
        )
        held = parts.select("parent", F.col("ctx").alias("part"))
        places = places.join(held, places["ctx"] == held["parent"]).select(F.col("part").alias("ctx"), "doc_id", "tid", "place")
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    whole = F.sort_array(F.collect_set(F.struct("start", "stop", "first_doc_id", "first_start")))
    return materialize(every.groupBy("doc_id", "tid").agg(whole.alias("spans")), f"{label}-spans")


def covered(spans: list[dict]) -> list[tuple[int, int]]:
    """Disjoint runs (start, stop) of the places that spans in ascending order cover."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [tuple(x) for x in out]


def cleaned(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, kept_text (words joined by one
    space) without the words that the spans cover.

    Texts of documents without spans stay where they are read; only the others are
    dealt out to meet their spans.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    bloom = build_bloom(spans.select("doc_id"), spans.count())
    sent = spark.sparkContext.broadcast(bloom)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())]
    )

    def may(batch: pa.RecordBatch) -> np.ndarray:
        ids = np.array([-1 if x is None else x for x in column(batch, "doc_id")], np.int64)
        return sent.value.may_hold(ids)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may(batch)))

    def finish(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        sizes, gone, kept = [], [], []
        for raw, own in zip(binary_column(batch, "text"), spans, strict=True):
            words = plain_words(raw)
            left, at = [], 0
            for a, b in covered(own or []):
                left += words[at:a]
                at = b
            left += words[at:]
            sizes.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        return pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()),
             pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], schema=schema
        )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~may(batch)))
            yield finish(batch, [None] * batch.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finish(batch, column(batch, "spans"))

    shape = "doc_id long, n_words long, n_removed long, kept_text binary"
    rest = docs.mapInArrow(tidy(candidates), docs.schema)
    same = rest["doc_id"].eqNullSafe(spans["doc_id"]) & (rest["tid"] == spans["tid"])
    met = rest.join(spans, same, "left").select(rest["doc_id"], "text", "spans")
    return docs.mapInArrow(tidy(untouched), shape).unionByName(met.mapInArrow(tidy(touched), shape))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
