"""Media columns as lossless WebP.

``to_media`` stores a binary payload of each row as a WebP image of 8-bit samples;
``from_media`` decodes any lossless WebP column into pixel arrays; ``features``
describes the samples read back. Payloads are made of whole texts.

Nulls: a null text is an empty payload, padded like any other; a null or broken
media value gives null pixels. Empty tables give empty results, equal texts equal
values; ties and repeated rows are coded each by itself. Extra columns stay in
``from_media`` and are not touched by the query. Payloads up to 256 MiB fit one image.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import webp, webp_writer, words
from pagemill.llm.common import table

BLOCK = 64
#: Bytes of payload coded, and decoded, at a time: each takes some fifty on the way.
CODED, DECODED = 2 << 20, 12 << 20


def padded(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of BLOCK."""
    return text + b"\0" * (-len(text) % BLOCK if text else BLOCK)


def to_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media): every text's padded UTF-8 as a WebP file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole, 1, CODED):
                raw = batch.column(1).fill_null("").cast(pa.large_binary()).to_pylist()
                payloads = [padded(t) for t in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(len, payloads)), pa.int64()), pa.array(webp_writer.encode_many(payloads), pa.binary())],
                    names=[id_col, "n_bytes", "payload_bytes", "media"],
                )

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, media binary")


def decode_all(media) -> list[tuple]:
    """(width, height, pixels as signed ARGB) of each WebP file; nulls for what is none."""
    found = webp.decode_many([bytes(v) if v is not None else b"" for v in media])
    return [(None, None, None) if x is None else (x[0], x[1], x[2].astype(np.uint32).view(np.int32)) for x in found]


def from_media(df: DataFrame, media: str = "media", into: str = "image") -> DataFrame:
    """``df`` with the struct column ``into``: width, height and pixels of each media value."""

    @F.pandas_udf("width int, height int, pixels array<int>")
    def decoded(column):
        import pandas as pd

        return pd.DataFrame(decode_all(column), columns=["width", "height", "pixels"])

    return df.withColumn(into, decoded(media))


def describe(payload: np.ndarray) -> str:
    """Features of the samples: mean in thousandths, 16-bin histogram in thousandths, average hash of 64 stretches."""
    n = len(payload)
    share = np.bincount(payload >> 4, minlength=16) * 1000 // n
    stretch = payload.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(stretch * 64 > stretch.sum()).tobytes().hex()
    return f"mean={int(payload.sum(dtype=np.int64)) * 1000 // n};hist={','.join(map(str, share))};ahash={bits}"


def _stretches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes, a row at least."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored bytes back and describes them."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = [], batch.column(2).to_pylist()
            for a, b in _stretches(sizes, DECODED):
                files = batch.column(3).slice(a, b - a).to_pylist()
                for n, data, (_, _, pixels) in zip(sizes[a:b], files, decode_all(files), strict=True):
                    payload = webp.samples(pixels.view(np.uint32))[:n].tobytes()
                    rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), describe(np.frombuffer(payload, np.uint8))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, "n_bytes", "payload_bytes", "media").mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    return features(to_media(table(spark, sf_dir, "documents")))
