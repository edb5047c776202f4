"""Lossless WebP files of byte payloads, as grey images.

A payload is a grey image of 64 samples a row. Repeated words and runs of words become
back-references to where they last stood; what is left and the references get prefix
codes of their own for each image. Samples are coded after subtract-green, which leaves
red and blue empty; images of at most 16 sample values are coded by a palette, several
samples a pixel. A colour cache does not help where a pixel is one of 256 greys, and
predictors do not help text, so neither is written. Many payloads are coded at once.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from pagemill.llm import words
from pagemill.llm.webp import CODE_LENGTH_ORDER, MOST_SIDE, SHORT_DISTANCES, WebPError, _extra, reversal

ROW = 64
#: Longest code, longest copy of the format, farthest copy, shortest one that pays.
MOST_BITS, MOST_COPY, MOST_DISTANCE, LEAST_COPY = 12, 4096, (1 << 20) - 120, 6
GREEN, DISTANCE = 280, 40
#: Code lengths of the code for code lengths: symbols 0 to 15, 17 and 18, complete.
_LENGTHS = {s: 4 for s in range(14)} | {14: 5, 15: 5, 17: 5, 18: 5}


class Writer:
    """Collects bits from the lowest up."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> Writer:
        self.value |= value << self.n
        self.n += n
        return self

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most MOST_BITS; one for a single symbol."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        up = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            (v, a), (w, b) = heapq.heappop(heap), heap[0]
            heapq.heapreplace(heap, (v + w, node))
            up[a] = up[b] = node
        depth = [0] * len(up)
        for node in range(len(up) - 2, -1, -1):
            depth[node] = depth[up[node]] + 1
        if max(depth) <= MOST_BITS:
            out[used] = depth[: len(used)]
            return out
        # flatter weights until no code is too long
        weight = [(w + 1) // 2 for w in weight]


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, its first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order]
        most = int(n[-1])
        span = 1 << (most - n)
        out[order] = reversal(most)[np.cumsum(span) - span]
    return out


_SMALL = np.zeros(19, np.int64)
_SMALL[list(_LENGTHS)] = list(_LENGTHS.values())
_SMALL_CODES = [(int(c), int(n)) for c, n in zip(codes(_SMALL), _SMALL, strict=True)]


def put_code(w: Writer, lengths: np.ndarray) -> None:
    """Writes a prefix code: simple if it has one symbol, else normal with runs of zeros."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 2:
        symbol = used[0] if used else 0
        w.put(1, 1).put(0, 1).put(1, 1).put(symbol, 8)
        return
    value, n = 0, 0
    for symbol in CODE_LENGTH_ORDER:
        value |= int(_SMALL[symbol]) << n
        n += 3
    w.put(0, 1).put(len(CODE_LENGTH_ORDER) - 4, 4).put(value, n).put(0, 1)
    value = n = at = 0

    def zeros(times: int) -> None:
        nonlocal value, n
        while times:
            if times < 3:
                run, (code, size), extra, bits = 1, _SMALL_CODES[0], 0, 0
            elif times < 11:
                run, (code, size), extra, bits = times, _SMALL_CODES[17], times - 3, 3
            else:
                run, (code, size), bits = min(times, 138), _SMALL_CODES[18], 7
                extra = run - 11
            value |= (code | extra << size) << n
            n += size + bits
            times -= run

    for symbol, length in zip(used, lengths[used].tolist(), strict=True):
        zeros(symbol - at)
        code, size = _SMALL_CODES[length]
        value |= code << n
        n += size
        at = symbol + 1
    zeros(len(lengths) - at)
    w.put(value, n)


def prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, number of them) of lengths or distances."""
    v = value - 1
    high = np.maximum(np.frexp(v.astype(np.float64))[1] - 1, 1)
    symbol = np.where(value <= 4, v, 2 * high + (v >> (high - 1) & 1))
    bits, least = _extra(symbol)
    return symbol, value - least, bits


def _copies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of runs of words that stood in the same text before, none overlapping another."""
    none = (np.zeros(0, np.int64),) * 3
    start, _ = words.bounds(data, offsets)
    if len(start) < 2:
        return none
    text = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:], offsets[-1]), offsets[text + 1])
    h = words.hashes(data, start, end, lower=False)
    order = np.lexsort((h, text))
    again = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    back = np.zeros(len(start), np.int64)
    back[order[1:][again]] = start[order[1:][again]] - start[order[:-1][again]]
    own = np.flatnonzero((back > 0) & (back <= MOST_DISTANCE))
    if not len(own):
        return none
    new = np.append(True, (np.diff(own) != 1) | (back[own][1:] != back[own][:-1]) | (text[own][1:] != text[own][:-1]))
    first = np.flatnonzero(new)
    begin, size, distance = start[own][first], np.add.reduceat((end - start)[own], first), back[own][first]
    keep = size >= LEAST_COPY
    begin, size, distance = begin[keep], size[keep], distance[keep]
    if not len(begin):
        return none
    # hashes may be wrong, bytes are not
    ends = np.cumsum(size)
    place = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
    true = np.logical_and.reduceat(data[place] == data[place - np.repeat(distance, size)], ends - size)
    begin, size, distance = begin[true], size[true], distance[true]
    parts = -(-size // MOST_COPY)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, size, distance = np.repeat(begin, parts) + k * MOST_COPY, np.repeat(size, parts) - k * MOST_COPY, np.repeat(distance, parts)
    return begin, np.minimum(size, MOST_COPY), distance


def _palette(payload: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int]:
    """(bytes that hold the places in ``values``, several in each; how many in each, as a power of two)."""
    pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    index = np.searchsorted(values, payload).astype(np.uint8).reshape(-1, 1 << pack)
    return np.bitwise_or.reduce(index << (np.arange(1 << pack, dtype=np.uint8) * (8 >> pack)), axis=1).astype(np.uint8), pack


def _put_palette(w: Writer, values: np.ndarray) -> None:
    """The palette transform of grey ``values``: an image of one row, each pixel less the one before."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    w.put(1, 1).put(3, 2).put(len(values) - 1, 8).put(0, 1)
    grey = code_lengths(np.bincount(steps, minlength=256))
    opaque = code_lengths(np.bincount(np.where(np.arange(len(values)) == 0, 255, 0), minlength=256))
    put_code(w, np.append(grey, np.zeros(GREEN - 256, np.int64)))
    put_code(w, grey)
    put_code(w, grey)
    put_code(w, opaque)
    put_code(w, np.zeros(DISTANCE, np.int64))
    size = lambda n: n if (n > 0).sum() > 1 else np.zeros_like(n)  # noqa: E731  a single symbol takes no bits
    grey_code, opaque_code, grey, opaque = codes(grey), codes(opaque), size(grey), size(opaque)
    for k, v in enumerate(steps.tolist()):
        for _ in range(3):
            w.put(int(grey_code[v]), int(grey[v]))
        a = 0 if k else 255
        w.put(int(opaque_code[a]), int(opaque[a]))


def _riff(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


def side(n: int) -> tuple[int, int]:
    """Width and height of the image of ``n`` samples, a positive multiple of ROW."""
    width = ROW
    while -(-n // width) > MOST_SIDE:
        width *= 2
    if width > MOST_SIDE:
        raise WebPError("payload over 256 MiB")
    return width, -(-n // width)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A WebP file of each payload, whose length is a positive multiple of ROW."""
    if not payloads:
        return []
    images, heads = [], []
    for payload in payloads:
        width, height = side(len(payload))
        w = Writer().put(width - 1, 14).put(height - 1, 14).put(0, 1).put(0, 3)
        # the last row is filled up; the reader knows the length
        grey = np.frombuffer(payload + bytes(width * height - len(payload)), np.uint8)
        there = np.flatnonzero(np.bincount(grey, minlength=256))
        if len(there) <= 16:
            _put_palette(w, there)
            grey, _ = _palette(grey, there)
        else:
            w.put(1, 1).put(2, 2)  # subtract green
        images.append(grey)
        heads.append(w.put(0, 1).put(0, 1).put(0, 1))  # no more transforms, no colour cache, no meta codes
    m = len(images)
    offsets = np.cumsum([0, *map(len, images)])
    data = np.concatenate(images)
    begin, size, distance = _copies(data, offsets)

    # a copy has one item, where it begins
    literal = _covered(len(data), begin, size) == 0
    is_copy = np.zeros(len(data), bool)
    is_copy[begin] = True
    place = np.flatnonzero(literal | is_copy)
    text = np.searchsorted(offsets, place, side="right") - 1
    copy = np.flatnonzero(is_copy[place])
    symbol = data[place].astype(np.int64)
    length_symbol, length_extra, length_bits = prefix(size)
    far_symbol, far_extra, far_bits = prefix(distance + len(SHORT_DISTANCES))
    symbol[copy] = 256 + length_symbol

    green = np.bincount(text * GREEN + symbol, minlength=m * GREEN).reshape(m, GREEN)
    far = np.bincount(text[copy] * DISTANCE + far_symbol, minlength=m * DISTANCE).reshape(m, DISTANCE)
    tables = []
    for counts in (green, far):
        lengths = np.stack([code_lengths(c) for c in counts])
        tables.append((np.stack([codes(n) for n in lengths]), np.where((lengths > 0).sum(axis=1, keepdims=True) > 1, lengths, 0)))
        tables.append(lengths)
    (green_codes, green_bits), green_lengths, (far_codes, far_code_bits), far_lengths = tables
    for w, g, d in zip(heads, green_lengths, far_lengths, strict=True):
        put_code(w, g)
        w.put(1, 1).put(0, 1).put(0, 1).put(0, 1)  # red: always 0
        w.put(1, 1).put(0, 1).put(0, 1).put(0, 1)  # blue
        w.put(1, 1).put(0, 1).put(1, 1).put(255, 8)  # alpha
        put_code(w, d)

    # every item is one number of bits
    value, n = green_codes[text, symbol].astype(np.uint64), green_bits[text, symbol]
    for part, bits in ((length_extra, length_bits), (far_codes[text[copy], far_symbol], far_code_bits[text[copy], far_symbol]), (far_extra, far_bits)):
        value[copy] |= part.astype(np.uint64) << n[copy].astype(np.uint64)
        n[copy] += bits
    per_text = np.bincount(text, n, minlength=m).astype(np.int64)
    head_bits = np.array([w.n for w in heads])
    room = -(-(head_bits + per_text) // 64) + 1
    base = 64 * (np.cumsum(room) - room)
    before = np.cumsum(n) - n
    first = np.searchsorted(text, np.arange(m))
    at = before - before[first][text] + (base + head_bits)[text]
    stream = np.zeros(int(room.sum()) + 1, np.uint64)
    shift = (at & 63).astype(np.uint64)
    _add(stream, at >> 6, value << shift)
    _add(stream, (at >> 6) + 1, np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))
    raw = stream.view(np.uint8)
    out = []
    for w, b, total in zip(heads, (base // 8).tolist(), (head_bits + per_text).tolist(), strict=True):
        head = np.frombuffer(w.bytes(), np.uint8)
        raw[b : b + len(head)] |= head
        out.append(_riff(b"\x2f" + raw[b : b + (total + 7) // 8].tobytes()))
    return out


def _covered(n: int, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each place whether a copy covers it."""
    edge = np.zeros(n + 1, np.int32)
    edge[begin] += 1
    np.subtract.at(edge, begin + size, 1)
    return np.cumsum(edge[:-1])


def _add(stream: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Adds values to the words ``at``, which do not decrease; no two have a bit in common."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    stream[at[first]] += np.add.reduceat(value, first)


def encode(payload: bytes) -> bytes:
    """A WebP file of one payload."""
    return encode_many([payload])[0]
