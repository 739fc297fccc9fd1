"""N-gram Jaccard join: an exact similarity join of shingle sets by prefix trees.

1. Every document becomes the set of its distinct n-word shingles. Equal sets are one
   node from here on, so copies are never expanded into pairs. The same pass fills a
   count sketch of fixed size, which gives all shingles one global order, rare first.
2. Two sets can only link if their prefixes in that order (size - least overlap + 1
   shingles) meet. Prefix shingles are grouped; lone ones, nearly all, go at once.
3. Sets that meet are compared by parity bitmaps, which bound the size of their
   difference from below. What passes joins sets to blocks; only a spanning forest of
   each group is written, never its pairs. The sets of a shingle that more than
   ``HOT_TOKEN`` sets share are one block as they are, so no task holds them all.
4. The whole sets of one block meet in one task, in a radix trie over their globally
   ordered shingles. A set is looked up by one traversal, which shares the overlap of
   common paths and leaves out subtrees by their bounds on size and rest; subtrees
   that belong to its component already are left out too.
5. A block beyond ``BLOCK_KEYS`` is dealt out in parts, each with the same few pivots of
   the block. Near copies link with pivots, so nearly all of them end in one component.
   What does not is dealt into groups that meet one another and the groups of that
   component, two groups to a part, in a second round; sets of one component count as
   linked there, and a pair of which neither is left over is in that component already.

The result holds exactly the components of all pairs with Jaccard >= num / den.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build_bloom, split_by
from .common import (
    as_long,
    binary_column,
    column,
    free_name,
    gram_hashes,
    hash_words,
    materialize,
    mix64,
    prepare,
    tidy,
)
from .components import Forest, connected_components, edge_rows

#: Counters of the sketch; 16 slices.
SKETCH = 1 << 20
_SLICE = SKETCH // 16
#: 64-bit words of the smallest parity bitmap.
BITMAP = 8
#: Shingles of all sets of a block that meet in one task (8 bytes each).
BLOCK_KEYS = 4_000_000
#: Sets of a large block that go to all of its parts in the first round.
PIVOTS = 64
#: Sets of one prefix shingle that one task compares; those of a more frequent one form a block without that.
HOT_TOKEN = 20_000
#: Sets of such a shingle that are tied to one of them.
_TIED = 1_000
#: Set ids a task remembers so as not to emit the same set again.
_SEEN = 200_000
#: Sets of candidate pairs after which a task hands on what it has joined so far.
_HELD = 500_000


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """By text the hashes of its n-word shingles, with repeats and in no fixed order.

    A sequence of fewer words is one shingle; a text without words has none.
    """
    words, counts = hash_words(texts, lower=True)
    grams = gram_hashes(words, n)
    at = 0
    for count in counts.tolist():
        if count >= n:
            yield grams[at : at + count - n + 1]
        elif count:
            short = gram_hashes(words[at : at + count], count)
            yield mix64(short ^ np.uint64(count))
        else:
            yield grams[:0]
        at += count


_SET_SALTS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0xA0761D6478BD642F))


def set_id(own: np.ndarray) -> bytes:
    """A 128-bit name of the set from its distinct shingles, in whatever order."""
    parts = [mix64(own ^ salt).sum(dtype=np.uint64) ^ np.uint64(len(own)) for salt in _SET_SALTS]
    return mix64(np.array(parts, np.uint64)).tobytes()


def half_of(sid: bytes) -> int:
    """The first 64 bits of a name, by which sets are known where they also share a shingle."""
    return int.from_bytes(sid[:8], "little", signed=True)


def bitmap_words(n: int) -> int:
    """64-bit words of the parity bitmap of a set of n: half a bit a shingle at least."""
    words = BITMAP
    while 128 * words < n:
        words *= 2
    return words


def parity_bitmap(own: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that fall on i: |A - B| + |B - A| >= Hamming.

    Halves laid on each other by xor give the bitmap of half the size.
    """
    bits = 64 * bitmap_words(len(own))
    counts = np.bincount((own >> np.uint64(8)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - least_overlap(n, num, den) + 1


def order_keys(own: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Ascending keys of distinct shingles: the class of frequency, then 56 bits of the hash."""
    rank = sketch[(own >> np.uint64(8)) & np.uint64(SKETCH - 1)].astype(np.uint64)
    return np.unique((rank << np.uint64(56)) | (own >> np.uint64(8)))


class TrieJoin:
    """Sets in a radix trie, most frequent shingle first; components of linked sets."""

    class Node:
        __slots__ = ("children", "comp", "ends", "high", "low", "seg")

        def __init__(self, seg: np.ndarray) -> None:
            self.seg, self.children, self.ends = seg, {}, []
            self.low, self.high, self.comp = 1 << 60, 0, None

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.root = self.Node(np.empty(0, np.uint64))
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def linked(self, overlap: int, n: int, m: int) -> bool:
        return self.den * overlap >= self.num * (n + m - overlap)

    def add(self, keys: np.ndarray, linked_with: int | None = None) -> int:
        """keys: ascending. Links the set with all that came before, then stores it.

        linked_with: the number of an earlier set that is known to be in its component.
        """
        own = keys[::-1]
        i = len(self.parent)
        self.parent.append(i if linked_with is None else self.find(linked_with))
        self.sizes.append(len(keys))
        if len(keys):
            self._traverse(i, keys)
            self._insert(i, own)
        return i

    def _traverse(self, i: int, keys: np.ndarray) -> None:
        n, num, den = len(keys), self.num, self.den
        smallest, largest = least_overlap(n, num, den), den * n // num
        stack = [(child, 0, 0) for child in self.root.children.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if node.high < smallest or node.low > largest:
                continue
            if node.comp is not None and self.find(node.comp) == self.find(i):
                continue
            seg = node.seg
            at = np.searchsorted(keys, seg)
            # seg descends; at[-1] own shingles lie beyond its last key
            overlap += int(np.count_nonzero(keys[np.minimum(at, n - 1)] == seg))
            depth += len(seg)
            rest = min(int(at[-1]), node.high - depth)
            m = max(node.low, smallest)
            if (num + den) * (overlap + rest) < num * (n + m):
                continue
            for j in node.ends:
                if self.linked(overlap, n, self.sizes[j]):
                    a, b = self.find(i), self.find(j)
                    self.parent[max(a, b)] = min(a, b)
            stack.extend((child, depth, overlap) for child in node.children.values())

    def _insert(self, i: int, own: np.ndarray) -> None:
        node, at, n = self.root, 0, len(own)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if at == n:
                node.ends.append(i)
                return
            child = node.children.get(own[at])
            if child is None:
                child = node.children[own[at]] = self.Node(own[at:])
                child.low = child.high = n
                child.comp = i
                child.ends.append(i)
                return
            seg = child.seg
            k = min(len(seg), n - at)
            differ = np.flatnonzero(seg[:k] != own[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(seg):
                upper = self.Node(seg[:same])
                upper.low, upper.high, upper.comp = child.low, child.high, child.comp
                child.seg = seg[same:]
                upper.children[child.seg[0]] = child
                node.children[own[at]] = child = upper
            if child.comp is not None and self.find(child.comp) != self.find(i):
                child.comp = None
            node, at = child, at + same


def _scan_sets(docs: DataFrame, n: int) -> DataFrame:
    """A row per document, and per task the slices of its sketch."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("half", pa.int64()),
         ("bitmap", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint64)
        for batch in batches:
            sizes, sids, bitmaps, buckets = [], [], [], []
            for grams in shingle_sets(binary_column(batch, "text"), n):
                own = np.unique(grams)
                sizes.append(len(own))
                sids.append(set_id(own) if len(own) else None)
                bitmaps.append(parity_bitmap(own).tobytes() if len(own) else None)
                buckets.append(((own >> np.uint64(8)) & np.uint64(SKETCH - 1)).astype(np.uint32))
            if buckets:
                np.add.at(counts, np.concatenate(buckets), np.uint64(1))
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()),
                 batch.column(own_at) if (own_at := batch.schema.get_field_index("_own")) >= 0 else pa.nulls(k, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()),
                 pa.array([None if x is None else half_of(x) for x in sids], pa.int64()), pa.array(bitmaps, pa.binary()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema
            )
        if counts.any():
            parts = [zlib.compress(counts[i : i + _SLICE].tobytes(), 1) for i in range(0, SKETCH, _SLICE)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
                 pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())],
                schema=schema,
            )

    shape = "doc_id long, own long, n long, sid binary, half long, bitmap binary, slice int, counts binary"
    return docs.mapInArrow(tidy(scan), shape)


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(column(batch, "slice"), binary_column(batch, "counts"), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint64)
            held[k] = held[k] + part if k in held else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()),
         pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())],
        names=["slice", "counts"],
    )


def _sketch(found: DataFrame) -> np.ndarray:
    """Classes of frequency, one byte for each counter: as large at any input."""
    shape = "slice int, counts binary"
    parts = found.filter("slice is not null").select("slice", "counts")
    spread = parts.repartition("slice", F.substring(F.md5("counts"), 1, 1)).mapInArrow(tidy(_add_slices), shape)
    total = np.zeros(SKETCH, np.uint64)
    for row in spread.repartition(4, "slice").mapInArrow(tidy(_add_slices), shape).collect():  # 16 rows, 8 MB
        at = row["slice"] * _SLICE
        total[at : at + _SLICE] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint64)
    return np.minimum(255, np.round(4 * np.log2(1.0 + total))).astype(np.uint8)


def _prefixes(docs: DataFrame, sketch: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([("token", pa.int64()), ("half", pa.int64()), ("n", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            tokens, halves, sizes = [], [], []
            for grams in shingle_sets(binary_column(batch, "text"), n):
                own = np.unique(grams)
                if not len(own) or (sid := set_id(own)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sid)
                keys = order_keys(own, shared.value)
                first = keys[: prefix_size(len(keys), num, den)]
                tokens.append(first)
                halves.append(np.full(len(first), half_of(sid), np.int64))
                sizes.append(np.full(len(first), len(keys), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(tokens))), pa.array(np.concatenate(halves)),
                     pa.array(np.concatenate(sizes))], schema=schema
                )

    return docs.mapInArrow(tidy(scan), "token long, half long, n int")


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def by_run(
    batches: Iterator[pa.RecordBatch], key: str, rows: int = 65_536
) -> Iterator[pa.Table]:
    """Tables of about so many rows that hold whole runs of a sorted key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        differ = np.flatnonzero(keys != keys[-1])
        at = int(differ[-1]) + 1 if len(differ) else 0
        if at:
            yield table.slice(0, at)
            rest = table.slice(at)
            held, size = rest.combine_chunks().to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _without_lone(num: int, den: int, hot_token: int) -> Callable:
    """Rows sorted by token, n and half: those whose token is in another set of like size.

    If the nearest sizes of a token's sets are too far apart to link, all others are. Rows
    of a token wait until it is known whether there are more than hot_token; then, and
    from there on as they come, they are tied together two by two under tokens of their
    own, with n = -1: so they are spread over all tasks, and no task holds them all.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # token, half, n, whether it has met the one before
        held: list[np.ndarray] = []  # rows of the last token so far: token, half, n
        tied = 0  # rows of it that are tied already; 0 while they may still be few
        first = before = 0  # the row that others are tied to, and the one that it is tied to

        def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
            t = np.concatenate(parts, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1]), pa.array(t[2].astype(np.int32))], names=["token", "half", "n"])

        def tie(part: np.ndarray) -> np.ndarray:
            nonlocal tied, first, before
            out = []
            for token, half in zip(part[0].tolist(), part[1].tolist(), strict=True):
                if tied % _TIED == 0:
                    before, first = first, half
                    other = before
                else:
                    other = first
                if tied:
                    own = int(mix64(np.array([token ^ half], np.int64).view(np.uint64)).view(np.int64)[0])
                    out += [(own, other, -1), (own, half, -1)]
                tied += 1
            return np.array(out, np.int64).reshape(-1, 3).T

        def take(part: np.ndarray, ends: bool) -> Iterator[np.ndarray]:
            """Kept rows of one token; ends: no more of it come."""
            nonlocal tied, held
            if not tied:
                held.append(part)
                if sum(h.shape[1] for h in held) > hot_token:
                    part, held = np.concatenate(held, axis=1), []
                    yield tie(part)
                elif ends:
                    yield from held
            else:
                yield tie(part)
            if ends:
                held, tied = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            token, half, n = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("token", "half", "n"))
            met = False
            if last is not None:
                token, half, n = (np.concatenate([[x], y]) for x, y in zip(last, (token, half, n), strict=False))
                met = last[3]
            at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (half[1:] != half[:-1])]))
            token, half, n = token[at], half[at], n[at]
            meet = (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])
            keep = np.zeros(len(token), bool)
            keep[1:] |= meet
            keep[:-1] |= meet
            keep[0] |= met
            last = int(token[-1]), int(half[-1]), int(n[-1]), bool(keep[-1])
            whole = np.stack([token, half, n])[:, :-1]  # the last row waits
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            out: list[np.ndarray] = []
            if len(starts) == 1:
                out += take(whole[:, keep[:-1]], False)
            else:
                cut = starts[1]
                out += take(whole[:, :cut][:, keep[:cut]], True)
                lows, sizes = starts[1:-1], np.diff(starts[1:])
                middle = whole[:, cut : starts[-1]][:, keep[cut : starts[-1]]]
                if len(lows) and sizes.max() > hot_token:
                    for a, b in zip(lows, starts[2:], strict=True):
                        out += take(whole[:, a:b][:, keep[a:b]], True)
                elif len(lows):
                    out.append(middle)
                out += take(whole[:, starts[-1] :][:, keep[starts[-1] : -1]], False)
            out = [p for p in out if p.shape[1]]
            if out:
                yield rows(out)
        if last is not None:
            end = np.array([[x] for x in last[:3]], np.int64)[:, : int(last[3])]
            out = [p for p in take(end, True) if p.shape[1]]
            if out:
                yield rows(out)

    return scan


class Members:
    """Sets in rows: sizes and parity bitmaps, to tell which pairs may link."""

    def __init__(self, n: np.ndarray, bitmaps: list[bytes], num: int, den: int) -> None:
        self.n, self.num, self.den = n.astype(np.int64), num, den
        self.whole = [np.frombuffer(b, np.uint64) for b in bitmaps]
        self.short = np.stack([fold(b, BITMAP) for b in self.whole])
        self.long = np.array([len(b) > BITMAP for b in self.whole])

    def near(self, i, j) -> np.ndarray:
        """Whether the pairs may link, by their sizes and the distance of their bitmaps."""
        a, b = self.n[i], self.n[j]
        overlap = -(-self.num * (a + b) // (self.num + self.den))
        apart = np.bitwise_count(self.short[i] ^ self.short[j]).sum(axis=-1, dtype=np.int64)
        most = a + b - 2 * overlap
        ok = (overlap <= np.minimum(a, b)) & (apart <= most)
        i, j, most = np.broadcast_to(i, ok.shape), np.broadcast_to(j, ok.shape), np.broadcast_to(most, ok.shape)
        for k in np.flatnonzero(ok & self.long[i] & self.long[j]):
            x, y = self.whole[i[k]], self.whole[j[k]]
            words = min(len(x), len(y))
            ok[k] = np.bitwise_count(fold(x, words) ^ fold(y, words)).sum() <= most[k]
        return ok

    def forest(self, rest: np.ndarray) -> list[tuple[int, int]]:
        """Pairs that span the components of the rows' candidate pairs, breadth first."""
        out = []
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                found = np.full(len(rest), -1, np.int64)
                for f in front:
                    open_ = np.flatnonzero(found < 0)
                    if not len(open_):
                        break
                    found[open_[self.near(f, rest[open_])]] = f
                new = found >= 0
                out += zip(found[new].tolist(), rest[new].tolist(), strict=True)
                front, rest = rest[new], rest[~new]
        return out


def _candidates(num: int, den: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in by_run(batches, "token"):
            token, sid = table["token"].to_numpy(), table["sid"].to_pylist()
            members = Members(table["n"].to_numpy(), table["bitmap"].to_pylist(), num, den)
            starts = _runs(token)
            sizes = np.diff(starts)
            tied = table["n"].to_numpy()[starts[:-1]] < 0  # one block, whatever their bitmaps
            small = np.repeat((sizes <= 8) & ~tied, sizes)
            for k in np.flatnonzero(tied):
                for other in range(starts[k] + 1, starts[k + 1]):
                    forest.union(sid[starts[k]], sid[other])
            for lag in range(1, 8):
                i = np.flatnonzero((token[lag:] == token[:-lag]) & small[lag:])
                if not len(i):
                    break
                i = i[members.near(i, i + lag)]
                for k in i.tolist():
                    forest.union(sid[k], sid[k + lag])
            for k in np.flatnonzero((sizes > 8) & ~tied):
                for a, b in members.forest(np.arange(starts[k], starts[k + 1])):
                    forest.union(sid[a], sid[b])
            if len(forest.parent) > _HELD:
                yield edge_rows(forest.stars(), pa.binary())
                forest = Forest()
        yield edge_rows(forest.stars(), pa.binary())

    return scan


def _whole_sets(docs: DataFrame, wanted, sketch: np.ndarray, n: int) -> DataFrame:
    """(sid, keys) of the documents whose set may be in a block."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, sketch))
    schema = pa.schema([("sid", pa.binary()), ("keys", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        wanted, sketch = shared.value
        for batch in batches:
            ids = np.array([-1 if x is None else x for x in column(batch, "doc_id")], np.int64)
            sids, keys = [], []
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            texts = [texts[k].as_py() for k in np.flatnonzero(wanted.may_hold(ids))]
            for grams in shingle_sets(texts, n):
                own = np.unique(grams)
                if not len(own) or (sid := set_id(own)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sid)
                sids.append(sid)
                keys.append(order_keys(own, sketch).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sids, pa.binary()), pa.array(keys, pa.binary())], schema=schema
            )

    return docs.mapInArrow(tidy(scan), "sid binary, keys binary")


def _join_blocks(num: int, den: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(block: dict[bytes, tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
            trie, sids = TrieJoin(num, den), sorted(block, key=lambda s: (len(block[s][1]), s))
            first: dict[bytes, int] = {}
            for s in sids:
                comp, keys = block[s]
                i = trie.add(keys, first.get(comp))
                first.setdefault(comp, i)
            pairs = [(s, sids[trie.find(i)]) for i, s in enumerate(sids)]
            return edge_rows([(a, b) for a, b in pairs if a != b], pa.binary())

        now, block = None, {}
        for batch in batches:
            groups = zip(column(batch, "block"), column(batch, "part"), strict=True)
            rows = zip(groups, column(batch, "sid"), column(batch, "comp"), binary_column(batch, "keys"), strict=True)
            for key, sid, comp, raw in rows:
                if key != now:
                    if len(block) > 1:
                        yield finish(block)
                    now, block = key, {}
                block[sid] = comp, np.frombuffer(raw, np.uint64)
        if len(block) > 1:
            yield finish(block)

    return scan


def linked_sets(
    docs: DataFrame, n: int, num: int, den: int, block_keys: int = BLOCK_KEYS, hot_token: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, own, n, sid; links: u, v between set ids).

    The links span each component of the sets; sid is null without shingles, own is the
    column _own where docs have one.
    """
    hot_token = HOT_TOKEN if hot_token is None else hot_token
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    found = materialize(_scan_sets(docs.select(doc_id, "text", *(["_own"] if "_own" in docs.columns else [])), n), "sets")
    docs = docs.select(doc_id, "text")
    rows = found.filter("slice is null").select("doc_id", "own", "n", "sid")
    sketch = _sketch(found)
    first = _prefixes(docs, sketch, n, num, den)
    parts = first.repartition("token").sortWithinPartitions("token", "n", "half")
    met = parts.mapInArrow(tidy(_without_lone(num, den, hot_token)), "token long, half long, n int")
    maps = found.filter("sid is not null").groupBy("sid").agg(F.min("half").alias("half"), F.min("bitmap").alias("bitmap"))
    groups = met.join(maps, "half").select("token", "sid", "n", "bitmap")
    dealt = groups.repartition("token").sortWithinPartitions("token", "sid")
    edges = dealt.mapInArrow(tidy(_candidates(num, den)), "u binary, v binary")
    edges = materialize(edges.distinct(), "candidates")
    blocks = materialize(connected_components(edges), "blocks")
    sizes = rows.filter("sid is not null").groupBy("sid").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"))
    members = materialize(blocks.join(sizes, blocks["id"] == sizes["sid"]).select("sid", "root", "n", "doc_id"), "members")
    wanted = build_bloom(members.select(F.coalesce("doc_id", F.lit(-1))), members.count())
    whole = _whole_sets(docs, wanted, sketch, n)

    def joined(placed: DataFrame) -> DataFrame:
        """placed: sid, block, part, comp. Links of the sets that meet in a part."""
        dealt = whole.join(placed, "sid").select("block", "part", "sid", "comp", "keys")
        dealt = dealt.repartition("block", "part").sortWithinPartitions("block", "part", "sid")
        found = dealt.mapInArrow(tidy(_join_blocks(num, den)), "u binary, v binary")
        return materialize(found.distinct(), "links")

    weight = members.groupBy("root").agg(F.sum("n").alias("w"))
    parts = F.when(F.col("w") > block_keys, F.ceil(F.col("w") / F.lit(block_keys)) + 1).otherwise(1)
    placed = members.join(weight.select("root", parts.cast("long").alias("k")), "root")
    own = F.pmod(F.xxhash64("sid"), F.col("k"))
    placed = materialize(placed.select("sid", F.col("root").alias("block"), own.alias("part"), "k", "n"), "placed")
    alone = F.col("sid").alias("comp")
    large = placed.filter("k > 1")
    if not large.limit(1).count():
        return rows, joined(placed.select("sid", "block", "part", alone))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part")
    classes = large.groupBy("block", "k", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(PIVOTS)).alias("class"))
    pivots = classes.agg(F.min("sid").alias("sid")).select("sid", "block", everywhere)
    first_round = placed.select("sid", "block", "part").unionByName(pivots).distinct()
    links = joined(first_round.select("sid", "block", "part", alone))
    named = large.join(connected_components(links), large["sid"] == F.col("id"), "left")
    named = materialize(named.select("sid", "block", "n", F.coalesce("root", "sid").alias("comp")), "named")
    sizes = named.groupBy("block", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("w"))
    main = sizes.groupBy("block").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max_by("w", F.struct("n", "comp")).alias("main_w"), F.sum("w").alias("w"))
    return rows, links.unionByName(joined(left_over_parts(named.join(main, "block"), block_keys)))


def left_over_parts(named: DataFrame, block_keys: int) -> DataFrame:
    """(sid, block, part, comp) of the second round: every pair of sets of which one at least is
    left over meets in a part, and a part holds half of block_keys shingles on average.

    named: sid, block, n, comp, with main, the block's main component, main_w, its shingles, and
    w, those of the block. The sets left over and the others are dealt into groups of a quarter
    of block_keys; a part is two groups of the left over, or one of each kind.
    """
    fill = max(1, block_keys // 4)
    over = named.filter("main_w < w").withColumns(
        {"l": F.ceil((F.col("w") - F.col("main_w")) / fill), "m": F.ceil(F.col("main_w") / fill), "left": F.col("comp") != F.col("main")}
    )
    own = F.pmod(F.xxhash64("sid", F.lit(2)), F.when(F.col("left"), F.col("l")).otherwise(F.col("m")))
    over = over.withColumn("own", own)
    among = F.transform(F.sequence(F.lit(0).cast("long"), F.col("l") - 1), lambda i: F.least(i, F.col("own")) * F.col("l") + F.greatest(i, F.col("own")))
    beside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: F.col("l") * F.col("l") + F.col("own") * F.col("m") + j)
    waits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("l") - 1), lambda i: F.col("l") * F.col("l") + i * F.col("m") + F.col("own"))
    parts = F.when(F.col("left"), F.concat(among, beside)).otherwise(waits)
    return over.select("sid", "block", F.explode(parts).alias("part"), "comp")


def jaccard_components(
    documents: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_keys: int = BLOCK_KEYS
) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased. Two documents link when
    den * |A and B| >= num * |A or B|. component_id is the smallest doc_id reachable
    by links, itself included. Null or empty texts have no shingles and their own id.
    Repeated rows give repeated results; other columns are not looked at; an empty
    table gives no rows. A null doc_id is no smallest one unless all are null.
    """
    prepare(documents.sparkSession)
    rows, links = linked_sets(documents.select("doc_id", "text"), n, num, den, block_keys)
    roots = connected_components(links)
    least = rows.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, least["sid"] == roots["id"], "left")
    named = named.select("sid", "least", F.coalesce("root", "sid").alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(whole, "root").select("sid", "component_id")
    return rows.join(named, "sid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one_per_component(
    documents: DataFrame, n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """documents with one document of each component only; all columns stay.

    A document is a doc_id with its text. The smallest doc_id stays, null last, and of its
    texts the one with the smallest hash. Of rows that repeat a doc_id (or null) and its
    text one stays. Texts without shingles stay.
    """
    prepare(documents.sparkSession)
    mine = free_name(documents, "_own")
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    rows, links = linked_sets(documents.select("doc_id", "text", own.alias("_own")), n, num, den)
    rows = rows.filter("sid is not null")
    roots = connected_components(links)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", F.col("own").alias("h"))
    first = rows.groupBy("sid").agg(F.min(order).alias("first"))
    first = first.join(roots, first["sid"] == roots["id"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    best = first.groupBy("root").agg(F.min("first").alias("best"))
    named = first.join(best, "root").select("sid", F.col("best.h").alias("best"))
    judged = materialize(rows.join(named, "sid").select("doc_id", "own", "best"), "jaccard")
    gone = judged.filter("own <> best").select(F.col("own").alias("_gone")).distinct()
    spare = judged.filter("own = best").groupBy("own").agg(F.count("*").alias("n")).filter("n > 1")
    spare = spare.select(F.col("own").alias("_gone"))
    listed = materialize(gone.withColumn("_all", F.lit(True)).unionByName(spare.withColumn("_all", F.lit(False))), "gone")
    bloom = build_bloom(listed.select("_gone"), listed.count())
    stay, may_go = split_by(documents.withColumn(mine, own), bloom, mine)
    key, whole = free_name(may_go, "_gone"), free_name(may_go, "_all")
    listed = listed.select(F.col("_gone").alias(key), F.col("_all").alias(whole))
    met = may_go.join(listed, may_go[mine] == listed[key], "left")
    kept = met.filter(F.col(whole).isNull()).select(stay.columns)
    one = met.filter(~F.col(whole)).select(stay.columns).dropDuplicates([mine])
    return stay.unionByName(kept).unionByName(one).drop(mine)
