"""Suffix-array dedup with sparse suffix arrays.

Suffixes are retained at minimiser positions alone (the anchors of repeats). In each
group they are sorted once by what follows them and once by what precedes them; the
comparison of neighbours gives the lengths they share. A match is extended from its
anchor to the left and to the right: two occurrences agree on o words before and
window - o words from the anchor exactly when no neighbour in between shares less.
Matches of adjacent anchors with one source (the same document, as many words apart)
join to one passage, which stands in its source word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, column, gram_hashes, hash_words, materialize, plain_words, tidy
from .repeats import Contexts, cleaned, covered, repeated_spans

WINDOW = 50


def _sorted_contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row of word numbers, and the words it shares with the row before it."""
    wide = np.ascontiguousarray(ids.astype(">u4"))
    order = np.argsort(wide.view(np.dtype((np.void, 4 * ids.shape[1]))).ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ordered = ids[order]
    same = (ordered[1:] == ordered[:-1]) & (ordered[1:] > 0)
    shares = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return rank, np.concatenate([[0], shares])


def first_contexts(own: Contexts) -> np.ndarray:
    """For every window the least rank of the contexts that agree with it around its anchor."""
    window, n = own.window, len(own.at)
    row, inner = own.windows()
    if not len(row):
        return np.empty(0, np.int64)
    at = own.at
    padded = np.concatenate([np.zeros(window, np.int64), own.ids, np.zeros(window, np.int64)])
    base = own.begin + window
    right_place = at[:, None] + np.arange(window)
    right = np.where(right_place < own.counts[:, None], padded[base[:, None] + np.minimum(right_place, own.counts[:, None])], 0)
    most = max(1, int(at.max()))
    left_place = at[:, None] - 1 - np.arange(most)
    left = np.where(left_place >= 0, padded[base[:, None] + np.maximum(left_place, 0)], 0)
    (rank_r, share_r), (rank_l, share_l) = _sorted_contexts(right), _sorted_contexts(left)
    out = np.empty(len(row), np.int64)
    offset = at[row] - inner
    by_offset = np.argsort(offset, kind="stable")
    cuts = np.searchsorted(offset[by_offset], np.arange(int(offset.min()), int(offset.max()) + 2))
    for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), int(offset.min())):
        here = by_offset[a:b]
        if not len(here):
            continue
        rows = row[here]
        agree_r = np.cumsum(share_r < window - o)[rank_r[rows]]
        agree_l = np.cumsum(share_l < o)[rank_l[rows]] if o else np.zeros(len(rows), np.int64)
        group = np.unique(agree_l * (n + 1) + agree_r, return_inverse=True)[1]
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, own.rank[rows])
        out[here] = least[group]
    return out


#: Words of the short runs that are looked at before whole windows of a document are.
_SHORT = 8


def inside_runs(words: list[bytes], hashes: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(start, stop, first): the windows of a document that start earlier in it, where they start
    first, those as many words apart joined. Suffixes are sorted by what they begin with."""
    short = min(_SHORT, window)
    if len(words) <= window:
        return []
    grams = np.sort(gram_hashes(hashes, short))
    if np.count_nonzero(grams[1:] == grams[:-1]) < window - short + 1:
        return []
    grams = gram_hashes(hashes, window)
    order = np.argsort(grams, kind="stable")
    new = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    at = np.flatnonzero(first < np.arange(len(first)))
    if not len(at):
        return []
    begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (first[at[1:]] != first[at[:-1]] + 1)])
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(at)) - 1
    found = zip(at[begin].tolist(), (at[end] + window).tolist(), first[at[begin]].tolist(), strict=True)
    return [(a, b, f) for a, b, f in found if words[a:b] == words[f : f + b - a]]


def _inside(documents: DataFrame, window: int) -> DataFrame:
    """Per document with repeats of its own: doc_id, tid, spans as those of repeated_spans()."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    span = pa.struct([(c, pa.int64()) for c in ("start", "stop", "first_doc_id", "first_start")])
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("spans", pa.list_(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch, "text")
            hashes, counts = hash_words(texts)
            out, at = [], 0
            for d, tid, raw, n in zip(column(batch, "doc_id"), column(batch, "tid"), texts, counts.tolist(), strict=True):
                own, at = hashes[at : at + n], at + n
                if n > window and (runs := inside_runs(plain_words(raw), own, window)):
                    out.append({"doc_id": d, "tid": tid, "spans": [{"start": a, "stop": b, "first_doc_id": d, "first_start": f} for a, b, f in runs]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    shape = "doc_id long, tid long, spans array<struct<start: long, stop: long, first_doc_id: long, first_start: long>>"
    return docs.filter("doc_id is not null").mapInArrow(tidy(scan), shape)


def find_repeats(documents: DataFrame, window: int = WINDOW, inside: bool = False) -> DataFrame:
    """Per document with any: doc_id, tid, spans (start, stop, first_doc_id, first_start).

    With inside also repeats inside a document, whose first_doc_id is its own.
    """
    across = repeated_spans(documents, window, first_contexts, "suffix")
    if not inside:
        return across
    both = across.unionByName(_inside(documents, window)).groupBy("doc_id", "tid")
    spans = F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans"))))
    return materialize(both.agg(spans.alias("spans")), "suffix-repeats")


def without_traced(spans: list[dict], doc_id: int, window: int) -> list[dict]:
    """Ascending spans in which those inside the document lack the windows that another document explains."""
    across = [s for s in spans if s["first_doc_id"] != doc_id]
    if len(across) == len(spans):
        return spans
    taken = covered([{"start": s["start"], "stop": s["stop"] - window + 1} for s in across])
    out = list(across)
    for s in spans:
        if s["first_doc_id"] != doc_id:
            continue
        at, last = s["start"], s["stop"] - window + 1
        for a, b in [*taken, (last, last)]:
            if b <= at and a < last:
                continue
            if at < (end := min(a, last)):
                out.append({"start": at, "stop": end + window - 1, "first_doc_id": doc_id, "first_start": s["first_start"] + at - s["start"]})
            at = max(at, b)
            if at >= last:
                break
    return sorted(out, key=lambda s: (s["start"], s["stop"], s["first_doc_id"], s["first_start"]))


def passages(spans: list[dict]) -> list[tuple[int, int, int, int]]:
    """(start, stop, first_doc_id, first_start) of ascending spans, those of one source joined."""
    out: list[list[int]] = []
    last: dict[tuple[int, int], list[int]] = {}
    for s in spans:
        source = (s["first_doc_id"], s["first_start"] - s["start"])
        open_ = last.get(source)
        if open_ is not None and s["start"] <= open_[1]:
            open_[1] = max(open_[1], s["stop"])
        else:
            last[source] = [s["start"], s["stop"], s["first_doc_id"], s["first_start"]]
            out.append(last[source])
    return [tuple(x) for x in out]


def report(documents: DataFrame, window: int = WINDOW, inside: bool = False) -> DataFrame:
    """One row for each repeated passage: doc_id, start, stop, n_words, first_doc_id, first_start.

    The words at places start to stop of the document are those from first_start on in
    the document first_doc_id. Each window of so many words is traced to the smallest
    doc_id below its own in which it starts, and to its first place there; a passage is
    a longest run of windows with one source. Where an even smaller doc_id has part of
    a passage, that part is a passage of its own, and the two may overlap; passages of
    different documents side by side stay apart. With inside, a window that no smaller
    doc_id has, but that starts earlier in its own document, is traced to its first place
    there, so first_doc_id is doc_id for repeats inside a document. Documents without a passage have no row; null and empty texts, texts
    shorter than a window, rows with a null doc_id and empty tables give none. Equal
    rows of one doc_id count once; other columns are not looked at.
    """
    names = ("doc_id", "start", "stop", "n_words", "first_doc_id", "first_start")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (d, a, b, b - a, first, place)
                for d, spans in zip(column(batch, "doc_id"), column(batch, "spans"), strict=True)
                for a, b, first, place in passages(without_traced(spans, d, window))
            ]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return find_repeats(documents, window, inside).mapInArrow(tidy(flat), ", ".join(f"{c} long" for c in names))


def remove_repeats(documents: DataFrame, window: int = WINDOW, inside: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text; every passage but its first goes, with inside also within a document."""
    return cleaned(documents, find_repeats(documents, window, inside))
