"""Token-ID output: byte or bit planes of fixed-size id blocks, each under zstandard.

Documents are ordered by a range partitioning and encoded where they land; a task
writes its own chunks, so nothing is gathered. Files are written by Spark's committed
writer: they can go to any store it knows and survive the loss of executors.

Format: a Parquet directory without page compression, one row for each chunk of whole
documents: shard, chunk (its place in the shard), n_ids, doc_ids, lengths, and data:

    magic "SLPB", then little-endian u8 version, u8 kind (8: byte planes, 1: bit
    planes), u32 ids in a block, u64 ids in the chunk, the chunk index: for every block
    and plane a u32 with the compressed size, then the planes, plane by plane.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, count, islice, repeat
from operator import not_
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_column, column, prepare, shared_path, tidy

MAGIC, VERSION = b"SLPB", 1
BLOCK = 1 << 15
CHUNK = 1 << 16
_HEAD = struct.Struct("<4sBBIQ")


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == 8:
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == 1:
        bits = np.stack([np.unpackbits(r, bitorder="little", count=n) for r in rows])
        rows = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def pack(ids: np.ndarray, kind: int = 8, block: int = BLOCK, level: int = 1) -> bytes:
    """One chunk of ids as bytes."""
    squeeze = zstandard.ZstdCompressor(level=level)
    planes = [squeeze.compress(p) for i in range(0, len(ids), block) for p in to_planes(ids[i : i + block], kind)]
    index = np.array([len(p) for p in planes], "<u4").tobytes()
    return b"".join([_HEAD.pack(MAGIC, VERSION, kind, block, len(ids)), index, *planes])


def unpack(data: bytes) -> np.ndarray:
    magic, version, kind, block, n = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of token ids")
    per, blocks = (4 if kind == 8 else 32), -(-n // block)
    sizes = np.frombuffer(data, "<u4", blocks * per, _HEAD.size).astype(np.int64)
    ends = np.cumsum(sizes) + _HEAD.size + 4 * len(sizes)
    begins = ends - sizes
    grow, out = zstandard.ZstdDecompressor(), []
    for b in range(blocks):
        here = range(b * per, (b + 1) * per)
        planes = [grow.decompress(data[begins[k] : ends[k]]) for k in here]
        out.append(from_planes(planes, min(block, n - b * block), kind))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def _byte_names() -> dict[int, str]:
    """How byte-level tokenizers write bytes: visible characters of Latin-1 as they are, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


class Encoder:
    """Encodes with the tokenizers library; pieces of known texts come from a table.

    For byte-level BPE the pieces of the split pattern are encoded one by one, so a
    text of plain characters is split here and only unseen pieces go to the library.
    Other tokenizers, texts with characters outside the safe ranges (on which versions
    of Unicode tables differ), and texts that hold a special token go to the library
    whole. As the library has it by default, the string of a special token in a text is
    that token; with plain_specials it is ordinary text.
    """

    #: The safe ranges: ASCII, and letters, digits and signs up to U+024F and in U+2010-2027.
    _UNSAFE = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027]")
    _LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    _DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    #: The byte-level split pattern on safe characters, the most common pieces first.
    _PIECE = re.compile(
        rf" ?[{_LETTERS}]+| ?[{_DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
    )
    _loaded: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, definition: str, known: int = 800_000, plain_specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = plain_specials
        self.known, self.table = known, {}
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and all(t.get("special") for t in spec.get("added_tokens", []))
        )
        added = [] if plain_specials else [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    @classmethod
    def load(cls, definition: str, plain_specials: bool = False) -> Encoder:
        """definition: the content of a tokenizer file, kept once by a worker."""
        key = hashlib.sha256(definition.encode()).hexdigest(), plain_specials
        if key not in cls._loaded:
            cls._loaded[key] = cls(definition, plain_specials=plain_specials)
        return cls._loaded[key]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids by piece, from the library's model alone: a piece is what its pre-tokenizer would hand to it."""
        tokens = self.model.tokenize
        names = ((p, p.encode().decode("latin-1").translate(_BYTE_NAMES)) for p in pieces)
        return {p: array("I", [x.id for x in tokens(name)]).tobytes() for p, name in names}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, by text."""
        if not self.by_piece:
            return self._whole(texts)
        out: list[bytes | None] = [None] * len(texts)
        odd = [k for k, t in enumerate(texts) if self._UNSAFE.search(t) or (self.added and self.added.search(t))]
        for k, ids in zip(odd, self._whole([texts[k] for k in odd]), strict=True):
            out[k] = ids
        table, find = self.table, self._PIECE.findall
        open_: list[tuple[int, list[bytes], list[int], list[str]]] = []
        unseen: set[str] = set()
        for k, t in enumerate(texts):
            if out[k] is not None:
                continue
            pieces = find(t)
            got = list(map(table.get, pieces, repeat(b"")))  # no piece is without ids
            if all(got):
                out[k] = b"".join(got)
                continue
            gaps = list(compress(count(), map(not_, got)))
            missing = [pieces[i] for i in gaps]
            unseen.update(missing)
            open_.append((k, got, gaps, missing))
        new = self._pieces(list(unseen))
        for k, got, gaps, missing in open_:
            for i, p in zip(gaps, missing, strict=True):
                got[i] = new[p]
            out[k] = b"".join(got)
        # what comes once the table is full is least likely to come again
        table.update(islice(new.items(), max(0, self.known - len(table))))
        return out


_SHAPE = "shard int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
_ROW = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()),
     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())]
)


def write_token_files(
    documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, kind: int = 8, chunk: int = CHUNK,
    plain_specials: bool = False,
) -> None:
    """Encode every whole text and write the ids, ascending by doc_id, to path.

    tokenizer: a file on the driver, whose content is sent to the workers. Null texts are empty; each row is a document of its own, ties go by a hash of the text; a null
    doc_id comes first. An empty table writes an empty directory. Other columns are
    not looked at.
    """
    spark = prepare(documents.sparkSession)
    definition = spark.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))  # as large at any input

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = Encoder.load(definition.value, plain_specials), np.array([end_id], "<u4").tobytes()
        shard, count = TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "chunk": count, "n_ids": len(flat), "doc_ids": ids,
                  "lengths": [len(h) // 4 for h in held], "data": pack(flat, kind)}], schema=_ROW
            )

        for batch in batches:
            texts = [t or "" for t in column(batch, "text")]
            for d, own in zip(column(batch, "doc_id"), encoder.encode(texts), strict=True):
                ids.append(d)
                held.append(own + stop)
                size += len(own) // 4 + 1
                if size >= chunk:
                    yield flush()
                    count, ids, held, size = count + 1, [], [], 0
        if held:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("own"))
    # one doc_id, or none, may have very many rows: the hash of the text splits them
    ordered = docs.repartitionByRange("doc_id", "own").sortWithinPartitions("doc_id", "own", "text")
    rows = ordered.mapInArrow(tidy(encode), _SHAPE)
    rows.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document: shard, chunk, doc_id, begin (in its chunk), ids (little-endian u32)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("shard", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()),
             ("ids", pa.binary())]
        )
        for batch in batches:
            for k, data in enumerate(binary_column(batch, "data")):
                ids = unpack(data)
                lengths = np.array(batch["lengths"][k].as_py(), np.int64)
                ends = np.cumsum(lengths)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["shard"][k].as_py()] * n, pa.int32()),
                     pa.array([batch["chunk"][k].as_py()] * n, pa.int32()),
                     pa.array(batch["doc_ids"][k].as_py(), pa.int64()), pa.array(ends - lengths),
                     pa.array([ids[b:e].tobytes() for b, e in zip(ends - lengths, ends, strict=True)], pa.binary())],
                    schema=schema,
                )

    shape = "shard int, chunk int, doc_id long, begin long, ids binary"
    return prepare(spark).read.schema(_SHAPE).parquet(path).mapInArrow(tidy(decode), shape)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: shard, chunk, doc_id, begin (in its chunk), n_tokens, ids_crc32; the
    ids are read and digested where the chunk is, and go no further."""
    schema = pa.schema(
        [("shard", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()),
         ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(binary_column(batch, "data")):
                raw = memoryview(unpack(data)).cast("B")
                lengths = np.array(batch["lengths"][k].as_py(), np.int64)
                ends = np.cumsum(lengths)
                n = len(lengths)
                cuts = zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["shard"][k].as_py()] * n, pa.int32()),
                     pa.array([batch["chunk"][k].as_py()] * n, pa.int32()),
                     pa.array(batch["doc_ids"][k].as_py(), pa.int64()), pa.array(ends - lengths), pa.array(lengths),
                     pa.array([zlib.crc32(raw[b:e]) for b, e in cuts], pa.int64())],
                    schema=schema,
                )

    shape = "shard int, chunk int, doc_id long, begin long, n_tokens long, ids_crc32 long"
    return prepare(spark).read.schema(_SHAPE).parquet(path).mapInArrow(tidy(decode), shape)


def chunk_starts(spark: SparkSession, path: str) -> DataFrame:
    """Per chunk (shard, chunk): ids of all chunks before it. Reads the index columns only."""
    index = spark.read.schema(_SHAPE).parquet(path).select("shard", "chunk", "n_ids")
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("shard_start"))
    own = F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    return index.select("shard", "chunk", own.alias("own")).join(shards, "shard").select(
        "shard", "chunk", (F.col("own") + F.col("shard_start")).alias("chunk_start")
    )


def report(
    documents: DataFrame, tokenizer: str, end_id: int = 2, kind: int = 8, plain_specials: bool = False
) -> DataFrame:
    """Per document, from the files read back: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    path = shared_path(spark, "token-ids")
    write_token_files(documents, path, tokenizer, end_id, kind, plain_specials=plain_specials)
    read = read_digests(spark, path)
    return read.join(chunk_starts(spark, path), ["shard", "chunk"]).select(
        "doc_id", (F.col("chunk_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )
