"""A Bloom filter of bounded size, filled by the tasks and merged in a tree.

It only saves work: what passes it is checked again exactly. Beyond ``MOST_BITS`` it
lets more through; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, column, mix64, prepare, tidy

MOST_BITS = 1 << 28
_SLICE = 1 << 20  # bits
_PARTS = pa.schema([("slice", pa.int64()), ("bits", pa.binary())])


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(keys.astype(np.int64).view(np.uint64))
    g = mix64(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return [(h + np.uint64(i) * g) & np.uint64(bits - 1) for i in range(4)]


class Bloom:
    def __init__(self, bits: int, packed: np.ndarray) -> None:
        self.bits, self.packed = bits, packed

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for at in _places(keys, self.bits):
            byte = self.packed[(at >> np.uint64(3)).astype(np.int64)]
            ok &= (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return ok


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(column(batch, "slice"), binary_column(batch, "bits"), strict=True):
            part = np.frombuffer(raw, np.uint8)
            held[k] = held[k] | part if k in held else part
    yield _rows(held)


def _rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
        schema=_PARTS,
    )


def build_bloom(keys: DataFrame, count: int) -> Bloom:
    """keys: one long column; count: about how many. Nulls are left out."""
    prepare(keys.sparkSession)
    bits = _SLICE
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    name = keys.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            at = np.concatenate(_places(own, bits)).astype(np.int64)
            for k in np.unique(at // _SLICE):
                part = held.setdefault(int(k), np.zeros(_SLICE // 8, np.uint8))
                inside = at[at // _SLICE == k] % _SLICE
                np.bitwise_or.at(part, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        yield _rows(held)

    shape = "slice long, bits binary"
    parts = keys.select(F.col(name).cast("long")).mapInArrow(tidy(fill), shape)
    slices = bits // _SLICE
    merged = parts.repartition(max(1, min(slices, 256)), "slice").mapInArrow(tidy(_merge), shape)
    packed = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # at most MOST_BITS, 32 MB
        packed[row["slice"] * _SLICE // 8 : (row["slice"] + 1) * _SLICE // 8] = np.frombuffer(
            bytes(row["bits"]), np.uint8
        )
    return Bloom(bits, packed)


def split_by(rows: DataFrame, bloom: Bloom, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in the filter, the others); nulls are not in it.

    Both read the rows where they are, so that only the others need a join.
    """
    sent = rows.sparkSession.sparkContext.broadcast(bloom)

    def held(batch: pa.RecordBatch) -> np.ndarray:
        keys = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
        return sent.value.may_hold(keys.fill_null(0).to_numpy(zero_copy_only=False)) & ~np.asarray(keys.is_null())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~held(batch)))

    def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(batch)))

    return rows.mapInArrow(tidy(out), rows.schema), rows.mapInArrow(tidy(into), rows.schema)
