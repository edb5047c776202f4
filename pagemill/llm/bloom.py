"""A distributed Bloom filter whose cells saturate at two.

Its size is a parameter and does not follow the data, so the driver may collect
and broadcast it. Beyond some rows per cell it fills up: it then passes more
rows on, and results stay right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells in a block: one row of the shuffle holds the cells of one block.
BLOCK = 1 << 15
PROBES = 4


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES cells of each 64-bit hash, by double hashing; ``bits`` is a power of two, BLOCK at least."""
    h = hashes.astype(np.uint64, copy=False)
    with np.errstate(over="ignore"):
        step = ((h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        probes = np.arange(PROBES, dtype=np.uint64)[:, None]
        return ((h[None, :] + probes * step[None, :]) >> np.uint64(7)) & np.uint64(bits - 1)


def _rows(block: np.ndarray, once: list[bytes], twice: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"]
    )


def repeated(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap (uint8, ``bits / 8`` bytes) of the cells that at least two rows hit.

    Each task sends the cells it hit, as 16-bit places in a block; blocks are then
    merged where they meet. A hash that two rows share has all its cells in here.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(bits, np.uint8)
        for batch in batches:
            for row in cells(batch.column(0).to_numpy(zero_copy_only=False), bits):
                # each probe has cells of its own counts: a row never counts twice in one probe
                place, n = np.unique(row.astype(np.int64), return_counts=True)
                hit[place] = np.minimum(2, hit[place] + np.minimum(n, 2))
        for name in range(0, bits, BLOCK):
            part = hit[name : name + BLOCK]
            if part.any():
                one, two = (np.flatnonzero(part == k).astype("<u2").tobytes() for k in (1, 2))
                yield _rows(np.array([name // BLOCK]), [one], [two])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit = seen.setdefault(block, np.zeros(BLOCK, np.uint8))
                hit[np.frombuffer(two, "<u2")] = 2
                place = np.frombuffer(one, "<u2")
                hit[place] = np.minimum(2, hit[place] + 1)
        for block, hit in seen.items():
            yield _rows(np.array([block]), [b""], [np.packbits(hit == 2, bitorder="little").tobytes()])

    schema = "block int, once binary, twice binary"
    blocks = hashes.select(column).mapInArrow(scan, schema).repartition("block").mapInArrow(merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.select("block", "twice").collect():
        at = row["block"] * (BLOCK // 8)
        out[at : at + BLOCK // 8] = np.frombuffer(row["twice"], np.uint8)
    return out


def members(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of the cells that any of ``keys`` hits: an ordinary Bloom filter."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(bits, bool)
        for batch in batches:
            for row in cells(batch.column(0).to_numpy(zero_copy_only=False), bits):
                hit[row.astype(np.int64)] = True
        for name in range(0, bits, BLOCK):
            if hit[name : name + BLOCK].any():
                yield _rows(np.array([name // BLOCK]), [np.flatnonzero(hit[name : name + BLOCK]).astype("<u2").tobytes()], [b""])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(block, np.zeros(BLOCK, bool))[np.frombuffer(one, "<u2")] = True
        for block, hit in seen.items():
            yield _rows(np.array([block]), [b""], [np.packbits(hit, bitorder="little").tobytes()])

    schema = "block int, once binary, twice binary"
    blocks = keys.select(column).mapInArrow(scan, schema).repartition("block").mapInArrow(merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.select("block", "twice").collect():
        at = row["block"] * (BLOCK // 8)
        out[at : at + BLOCK // 8] = np.frombuffer(row["twice"], np.uint8)
    return out


def lookup(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where all cells of a hash are set."""
    out = np.ones(len(hashes), bool)
    for row in cells(hashes, len(bitmap) * 8):
        out &= (bitmap[(row >> np.uint64(3)).astype(np.int64)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def test(df: DataFrame, bitmap: np.ndarray, hash_column):
    """Column expression: may the row's hash be in the filter? The bitmap is broadcast (fixed size)."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(lookup(sent.value, h.to_numpy()))

    return may(hash_column)
