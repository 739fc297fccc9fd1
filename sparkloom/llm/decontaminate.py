"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard (a run of whole documents inside one task) gets a suffix array over its
words, of all suffixes that begin with a word of the benchmark; no other can match.
Each test suffix, i.e. each position of each benchmark item, is binary searched in it
word by word, which yields its longest verbatim match and all places of its window; the
words of those places are hit.

Cost: one pass over the documents and no shuffle. The benchmark travels to the tasks in
blocks whose size is bounded (``BLOCK_BYTES``); a larger benchmark takes one pass per
block and a merge by row, so nothing unbounded is broadcast. An item is held once, as
word numbers; its suffixes are places in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, binary_column, column, free_name, materialize, prepare, tidy

#: Text of benchmark items in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Words of documents in one shard's suffix array; as many as there are test suffixes, up to the second.
SHARD_WORDS, MOST_SHARD_WORDS = 200_000, 2_000_000
#: Words of the shortest match that counts as a longest one.
LEAST = 5
#: Test suffixes that are searched side by side.
_TOGETHER = 1 << 16


class TestSuffixes:
    """The benchmark's words as numbers, one item after another, and its suffixes.

    An item with a null id has windows like any other, but no id to be listed by.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int) -> None:
        self.window = window
        self.word_ids: dict[bytes, int] = {}
        flat: list[np.ndarray] = []
        places, owners, stops, whole = [], [], [], []
        at, behind = 0, np.zeros(window, np.int32)
        self.item_ids: list[str | None] = []
        for item_id, text in items:
            number = self.word_ids
            words = np.array([number.setdefault(w, len(number) + 1) for w in alnum_words(text)], np.int32)
            if not len(words):
                continue
            n, size = len(words), min(window, len(words))
            flat += [words, behind]
            places.append(np.arange(at, at + n))
            stops.append(np.full(n, at + n))
            owners.append(np.full(n, len(self.item_ids), np.int32))
            whole.append(np.arange(n) <= n - size)
            self.item_ids.append(item_id)
            at += n + window
        none = np.empty(0, np.int64)
        self.flat = np.concatenate(flat) if flat else behind
        self.places, self.stops, self.owners = (np.concatenate(x) if x else none for x in (places, stops, owners))
        self.is_window = np.concatenate(whole) if whole else none.astype(bool)
        self.sizes = np.minimum(self.stops - self.places, window)

    def __bool__(self) -> bool:
        return bool(self.item_ids)

    def rows(self, own: slice) -> np.ndarray:
        """The first words of some suffixes; zeros behind the end of an item."""
        return self.flat[self.places[own, None] + np.arange(self.window)]

    def shard_words(self) -> int:
        return min(MOST_SHARD_WORDS, max(SHARD_WORDS, len(self.places)))


def _order(flat: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at some places in the order of their first words, so many at least."""
    rank, far = flat.astype(np.int64), 1
    while far < depth:
        pair = rank[: len(rank) - far] * (int(rank.max(initial=0)) + 1) + rank[far:]
        found = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        rank, far = np.concatenate([found, np.zeros(far, np.int64)]), 2 * far
    return at[np.argsort(rank[at], kind="stable")]


def _within(value: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Where each wanted value is, or ends, in its own ascending run of the values."""
    a, b = low.copy(), high.copy()
    while True:
        live = np.flatnonzero(a < b)
        if not len(live):
            return a
        mid = (a[live] + b[live]) // 2
        beyond = value[mid] <= want[live] if right else value[mid] < want[live]
        a[live[beyond]] = mid[beyond] + 1
        b[live[~beyond]] = mid[~beyond]


class Shard:
    """Whole documents, their words as benchmark word numbers, and a suffix array."""

    def __init__(self, tests: TestSuffixes, docs: list[list[bytes]]) -> None:
        self.tests = tests
        window, get = tests.window, tests.word_ids.get
        self.sizes = np.array([len(d) for d in docs], np.int64)
        # A zero stands for a word no test has; zeros behind each document end its suffixes.
        self.shift = np.cumsum(self.sizes + window) - self.sizes - window
        flat = np.zeros(int((self.sizes + window).sum()), np.int32)
        for words, at in zip(docs, self.shift, strict=True):
            flat[at : at + len(words)] = [get(w, 0) for w in words]
        self.flat = flat
        self.places = _order(flat, np.flatnonzero(flat), window)
        padded = np.concatenate([flat, np.zeros(window, np.int32)])
        self.columns = [padded[self.places + c] for c in range(window)]
        #: By suffix in order: words of its longest match (0 below LEAST), and the test suffix.
        self.best = np.zeros(len(self.places), np.int64)
        self.best_of = np.zeros(len(self.places), np.int64)

    def matches(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of a test suffix with a whole window, places of the window in the shard)."""
        tests = self.tests
        for begin in range(0, len(tests.places) if len(self.places) else 0, _TOGETHER):
            rows = tests.rows(slice(begin, begin + _TOGETHER))
            live = np.arange(len(rows))
            low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.places), np.int64)
            depth = np.zeros(len(rows), np.int64)
            for c, value in enumerate(self.columns):
                live = live[rows[live, c] > 0]
                want = rows[live, c]
                a = _within(value, want, low[live], high[live], right=False)
                b = _within(value, want, a, high[live], right=True)
                some = a < b
                live, a, b = live[some], a[some], b[some]
                if not len(live):
                    break
                low[live], high[live], depth[live] = a, b, c + 1
                if c + 1 >= LEAST:
                    self._keep_longest(c + 1, begin + live, a, b)
            for q in np.flatnonzero(tests.is_window[begin : begin + len(rows)] & (depth == tests.sizes[begin : begin + len(rows)])):
                yield begin + int(q), self.places[low[q] : high[q]]

    def _keep_longest(self, depth: int, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Ranges of one depth are equal or apart; of equal ones the first test suffix counts."""
        at, first = np.unique(low, return_index=True)
        size = high[first] - at
        every = np.repeat(at, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        longer = self.best[every] < depth
        self.best[every[longer]] = depth
        self.best_of[every[longer]] = np.repeat(number[first], size)[longer]

    def longest(self) -> dict[int, tuple[int, int, int]]:
        """By document with a match of LEAST words: (words, test suffix, place), after matches()."""
        at = np.flatnonzero(self.best)
        out: dict[int, tuple[int, int, int]] = {}
        whole = self.best[at] == self.tests.window
        for k in at[whole]:  # a whole window goes on beyond it
            q, place = int(self.best_of[k]), int(self.places[k])
            self.best[k] = self._beyond(q, place)
        place = self.places[at]
        doc = self.document_of(place)
        order = np.lexsort((place, -self.best[at], doc))
        doc, new = doc[order], np.ones(len(order), bool)
        new[1:] = doc[1:] != doc[:-1]
        for d, k in zip(doc[new].tolist(), at[order][new].tolist(), strict=True):
            out[d] = int(self.best[k]), int(self.best_of[k]), int(self.places[k] - self.shift[d])
        return out

    def _beyond(self, q: int, place: int) -> int:
        """Words of the match of test suffix q at a place."""
        begin, stop, n = int(self.tests.places[q]), int(self.tests.stops[q]), self.tests.window
        while n < stop - begin:  # in strides, so that a short match of a long item stays cheap
            step = min(n, stop - begin - n)
            own, other = self.flat[place + n : place + n + step], self.tests.flat[begin + n : begin + n + step]
            differ = np.flatnonzero(own != other[: len(own)])
            if len(differ):
                return n + int(differ[0])
            n += len(own)
            if len(own) < step:
                break
        return n

    def hit_spans(self) -> dict[int, list[tuple[int, int]]]:
        """Merged spans of hit words by number of the document."""
        spans: dict[int, list] = {}
        for q, places in self.matches():
            size = int(self.tests.sizes[q])
            for k, place in zip(self.document_of(places), places, strict=True):
                start = int(place - self.shift[k])
                spans.setdefault(int(k), []).append((start, start + size))
        return {k: merge_spans(v) for k, v in spans.items()}

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.shift, places, side="right") - 1


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _read_benchmark(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in the order of their ids as strings, in blocks of bounded size, streamed to the driver partition by partition."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = bytes(row["text"]) if row["text"] is not None else None
        if block and size + len(text or b"") > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text or b"")
    yield block


_OUT = (
    "row_id long, doc_id long, n_words long, hits array<struct<start: long, stop: long>>, "
    "items array<string>, longest long, longest_item string, longest_at long"
)


def _scan(docs: DataFrame, tests: TestSuffixes) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, most = shared.value, shared.value.shard_words()

        def flush(held: list[tuple]) -> pa.RecordBatch:
            out: list[dict] = [
                {"row_id": r, "doc_id": d, "n_words": len(w), "longest": 0} for r, d, w in held
            ]
            spans: list[list] = [[] for _ in held]
            items: list[set] = [set() for _ in held]
            if known:
                shard = Shard(known, [w for _, _, w in held])
                for q, places in shard.matches():
                    size, item_id = int(known.sizes[q]), known.item_ids[known.owners[q]]
                    for k, place in zip(shard.document_of(places), places, strict=True):
                        start = int(place - shard.shift[k])
                        spans[k].append((start, start + size))
                        if item_id is not None:
                            items[k].add(item_id)
                for k, (n, q, at) in shard.longest().items():
                    out[k] |= {"longest": n, "longest_item": known.item_ids[known.owners[q]], "longest_at": at}
            for k, row in enumerate(out):
                row["hits"] = [{"start": a, "stop": b} for a, b in merge_spans(spans[k])]
                row["items"] = sorted(items[k])
            return pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

        held, size = [], 0
        for batch in batches:
            texts = binary_column(batch, "text")
            for r, d, t in zip(column(batch, "row_id"), column(batch, "doc_id"), texts, strict=True):
                words = alnum_words(t)
                held.append((r, d, words))
                size += len(words)
                if size >= most:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(tidy(scan), _OUT)


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_SCHEMA = pa.schema(
    [
        ("row_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("hits", pa.list_(_SPAN)),
        ("items", pa.list_(pa.string())),
        ("longest", pa.int64()),
        ("longest_item", pa.string()),
        ("longest_at", pa.int64()),
    ]
)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, ascending spans that cover the same places."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of documents: the hit word spans, items, and the longest match.

    Columns: doc_id, n_words, hits (disjoint spans of word places), items (ids as
    strings, sorted), longest, longest_item, longest_at (the longest verbatim match of any
    test suffix, in words, its item and its first place in the document; 0 and null where
    none has five words; of several items the one whose id is the first as a string).
    Ids may be of any type that casts to a string and back; longest_item has theirs.

    Null and empty texts have no words and no hits; repeated rows each get a row; an
    empty benchmark hits nothing; other columns are not looked at; items with equal ids
    count as one; windows of items with a null id hit words, but count as no item.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.lit(None).cast("long").alias("row_id"), F.col("doc_id").cast("long"), "text")
    item = F.col("longest_item").cast(benchmark.schema["item_id"].dataType)
    return _matches(docs, benchmark, window, block_bytes).drop("row_id").withColumn("longest_item", item)


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """docs: row_id, doc_id, text. row_id is kept where it is not null."""
    blocks = _read_benchmark(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(docs, TestSuffixes(first, window))
    # several passes need a key that stays the same
    row = F.coalesce("row_id", F.monotonically_increasing_id())
    docs = materialize(docs.withColumn("row_id", row), "decontaminate")
    parts = [materialize(_scan(docs, TestSuffixes(b, window)), "block") for b in (first, second)]
    parts += [materialize(_scan(docs, TestSuffixes(b, window)), "block") for b in blocks]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    best = F.min_by(F.struct("longest", "longest_item", "longest_at"), F.struct((-F.col("longest")).alias("l"), "longest_item", "longest_at"))
    merged = union.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        best.alias("best"),
    )
    spans = "array<struct<start: bigint, stop: bigint>>"
    joined = F.aggregate(
        "hits",
        F.expr(f"cast(array() as {spans})"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["stop"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.select(
        "row_id", "doc_id", "n_words", joined.alias("hits"), "items", "best.longest",
        "best.longest_item", "best.longest_at",
    )


def report(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: words, hit words, items, and whether it is contaminated.

    A document is contaminated when it has a hit and share * n_hit >= n_words.
    """
    return _judged(find_matches(documents, benchmark, window, block_bytes), share)


def _judged(found: DataFrame, share: int) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    row = ["row_id"] if "row_id" in found.columns else []
    return found.select(
        *row,
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def remove_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """documents without the contaminated rows; all columns and other rows stay.

    The decision is made where the row is read: nothing is shuffled or joined unless
    the benchmark needs several blocks.
    """
    prepare(documents.sparkSession)
    blocks = _read_benchmark(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        own = free_name(documents, "_row")
        keyed = materialize(documents.withColumn(own, F.monotonically_increasing_id()), "remove")
        docs = keyed.select(F.col(own).alias("row_id"), F.col("doc_id").cast("long"), "text")
        bad = _judged(_matches(docs, benchmark, window, block_bytes), share).filter("contaminated")
        return keyed.join(bad.select(F.col("row_id").alias(own)), own, "left_anti").drop(own)
    shared = documents.sparkSession.sparkContext.broadcast(TestSuffixes(first, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, most = shared.value, shared.value.shard_words()

        def flush(held: list[pa.RecordBatch], docs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            keep = np.ones(len(docs), bool)
            if known:
                shard = Shard(known, docs)
                for k, spans in shard.hit_spans().items():
                    n_hit = sum(b - a for a, b in spans)
                    keep[k] = share * n_hit < len(docs[k])
            at = 0
            for batch in held:
                yield batch.filter(pa.array(keep[at : at + batch.num_rows]))
                at += batch.num_rows

        held, docs, size = [], [], 0
        for batch in batches:
            held.append(batch)
            docs += [alnum_words(t) for t in binary_column(batch, "text")]
            size += sum(map(len, docs[len(docs) - batch.num_rows :]))
            if size >= most:
                yield from flush(held, docs)
                held, docs, size = [], [], 0
        if held:
            yield from flush(held, docs)

    return documents.mapInArrow(tidy(scan), documents.schema)
