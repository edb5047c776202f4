"""Vectorised words: hashes of all words of an Arrow batch of texts, a few passes over its bytes.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z are lowered, other characters stay. Words of
one batch keep the order of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)
#: Bytes hashed at a time.
SEGMENT = 1 << 19
#: Bytes of text in a slice of a batch that operators handle at a time.
SLICE = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_POW.get(name, ())) < n:
        _POW[name] = _powers(base, max(n, SEGMENT + 1))
    return _POW[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes; a bijection."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int = 0, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text, a row at least."""
    if not batch.num_rows:
        return
    offsets = raw(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; ``space`` marks the bytes between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~space[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte range (ordered, disjoint), A-Z lowered unless told otherwise."""
    out = np.zeros(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, at + SEGMENT, side="right")))
            part = data[at : int(ends[j - 1])]
            part = (_LOWER[part] if lower else part).astype(U64)
            part += U64(1)
            part *= _power("up", _M, len(part))
            run = np.zeros(len(part) + 1, U64)
            np.cumsum(part, out=run[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            h = (run[e] - run[s]) * _power("down", _M_INV, len(part) + 1)[s]
            out[i:j] = h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
            i = j
    return mix(out)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each text's first word and the end)."""
    data, offsets = raw(texts)
    starts, ends = bounds(data, offsets)
    return hashes(data, starts, ends), np.searchsorted(starts, offsets)


_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, wherever they start (also across texts); len(word) - k + 1 of them."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += word[j : j + n] * _ODD[j]
    return mix(out)


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of one text, sorted; a shorter text is one shingle, an empty one has none."""
    if not len(word):
        return np.zeros(0, U64)
    return np.unique(grams(word, min(k, len(word))))
