"""Lossless WebP (VP8L): a decoder of the whole format, and reading of many images at once.

Pixels are uint32 in ARGB order. The decoder reads prefix codes (simple and
normal, with meta groups), literals, back-references with the short-distance
table, the colour cache, and the predictor, cross-colour, subtract-green and
palette transforms.

Codes are read by table. Images without meta groups and colour cache whose red, blue
and alpha codes have one symbol (grey ones after subtract-green, palette ones) are
decoded side by side: each step reads one symbol of every image that goes on, and
back-references are followed for all at the end.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

MOST_SIDE = 1 << 14
#: Pixels of an image that is decoded beside others, images that are worth it, and pixels decoded together.
MOST_PLAIN, FEW, TOGETHER = 1 << 24, 64, 12 << 20

#: Fixed values of the format: order in which lengths of code-length codes come.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (dx, dy) of the 120 short distance codes.
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
BLACK = 0xFF000000


class WebPError(ValueError):
    """The bytes are not a lossless WebP image."""


class Bits:
    """Reads bits from the lowest up."""

    def __init__(self, data: bytes) -> None:
        self.data, self.pos = data, 0

    def peek(self, n: int) -> int:
        at, shift = self.pos >> 3, self.pos & 7
        return (int.from_bytes(self.data[at : at + 5], "little") >> shift) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise WebPError("truncated")

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value


@lru_cache(maxsize=16)
def reversal(bits: int) -> np.ndarray:
    """For every number of so many bits the number with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class Code:
    """A canonical prefix code, from the lengths of all symbols: a table by the next ``bits`` bits of symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        self.single = len(used) < 2
        if self.single:
            self.bits, self.table = 0, np.array([int(used[0]) << 4 if len(used) else 0])
        else:
            order = used[np.argsort(lengths[used], kind="stable")]
            n = lengths[order].astype(np.int64)
            self.bits = int(n[-1])
            span = 1 << (self.bits - n)
            if span.sum() != 1 << self.bits:
                raise WebPError("not a complete code")
            self.table = np.repeat(order << 4 | n, span)[reversal(self.bits)]

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek(self.bits)])
        bits.skip(entry & 15)
        return entry >> 4


@lru_cache(maxsize=64)
def _small_code(lengths: tuple[int, ...]) -> Code:
    return Code(np.array(lengths))


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise WebPError("symbol out of range")
        simple = np.zeros(alphabet, np.int64)
        simple[symbols] = 1
        return Code(simple)
    first = [0] * len(CODE_LENGTH_ORDER)
    for k in range(4 + bits.read(4)):
        first[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = _small_code(tuple(first))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, last = [], 8
    while len(lengths) < alphabet and most:
        most -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths.append(symbol)
            last = symbol or last
        else:
            value, extra, least = {16: (last, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[symbol]
            lengths += [value] * (least + bits.read(extra))
    if len(lengths) > alphabet:
        raise WebPError("too many code lengths")
    return Code(np.array(lengths + [0] * (alphabet - len(lengths))))


def _prefixed(bits: Bits, symbol: int) -> int:
    """Value of a length or distance prefix."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(value: int, width: int) -> int:
    """Pixels back, of a distance that was read."""
    if value > len(SHORT_DISTANCES):
        return value - len(SHORT_DISTANCES)
    dx, dy = SHORT_DISTANCES[value - 1]
    return max(1, dx + dy * width)


def read_pixels(bits: Bits, width: int, height: int, top: bool, later: bool = False) -> np.ndarray | list[Code]:
    """One entropy-coded image; only the top one may have meta codes. With ``later``, of a plain one the codes, its body unread."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("colour cache too large")
    meta, tile = None, 0
    if top and bits.read(1):
        tile = bits.read(3) + 2
        wide, high = (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
        meta = (read_pixels(bits, wide, high, False) >> 8 & 0xFFFF).reshape(high, wide)
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[read_code(bits, a) for a in (256 + 24 + cache_size, 256, 256, 256, 40)] for _ in range(1 + (int(meta.max()) if meta is not None else 0))]
    n = width * height
    if later and meta is None and not cache_bits and n <= MOST_PLAIN and all(c.single for c in groups[0][1:4]):
        return groups[0]
    out = np.zeros(n, np.uint32)
    cache = [0] * cache_size
    at = cached = 0

    def remember(upto: int) -> None:
        for v in out[cached:upto].tolist():
            cache[(v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while at < n:
        y, x = divmod(at, width)
        group = groups[int(meta[y >> tile, x >> tile])] if meta is not None else groups[0]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 280:
            length = _prefixed(bits, symbol - 256)
            distance = _distance(_prefixed(bits, group[4].read(bits)), width)
            if distance > at or at + length > n:
                raise WebPError("back-reference out of range")
            for k in range(at, at + length):
                out[k] = out[k - distance]
            at += length
        else:
            remember(at)
            cached = at
            out[at] = cache[symbol - 280]
            at += 1
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) of int: alpha, red, green, blue."""
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _packed(ch: np.ndarray) -> np.ndarray:
    ch = (ch & 255).astype(np.uint32)
    return ch[..., 0] << 24 | ch[..., 1] << 16 | ch[..., 2] << 8 | ch[..., 3]


def _predict(mode: int, left, up, up_left, up_right) -> list[int]:
    """Predicted channels of one pixel by the format's mode."""
    mean = lambda a, b: [(p + q) >> 1 for p, q in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else min(v, 255)
    if mode == 11:
        by_left = sum(abs(u - c) for u, c in zip(up, up_left, strict=True))
        by_up = sum(abs(v - c) for v, c in zip(left, up_left, strict=True))
        return list(left) if by_left < by_up else list(up)
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, up, up_left, strict=True)]
    if mode == 13:
        half = mean(left, up)
        return [clamp(a + int((a - c) / 2)) for a, c in zip(half, up_left, strict=True)]
    return {
        0: lambda: [255, 0, 0, 0], 1: lambda: list(left), 2: lambda: list(up), 3: lambda: list(up_right), 4: lambda: list(up_left),
        5: lambda: mean(mean(left, up_right), up), 6: lambda: mean(left, up_left), 7: lambda: mean(left, up), 8: lambda: mean(up_left, up),
        9: lambda: mean(up, up_right), 10: lambda: mean(mean(left, up_left), mean(up, up_right)),
    }.get(mode, lambda: [255, 0, 0, 0])()


def undo_predictor(pixels: np.ndarray, width: int, height: int, tile: int, modes: np.ndarray) -> np.ndarray:
    rest = _channels(pixels).reshape(height, width, 4).tolist()
    out = rest
    for y in range(height):
        for x in range(width):
            if not y:
                guess = [255, 0, 0, 0] if not x else out[0][x - 1]
            elif not x:
                guess = out[y - 1][0]
            else:
                # past the right end, the pixel above right is the first of this row
                up_right = out[y - 1][x + 1] if x + 1 < width else out[y][0]
                guess = _predict(int(modes[y >> tile, x >> tile]), out[y][x - 1], out[y - 1][x], out[y - 1][x - 1], up_right)
            out[y][x] = [(r + g) & 255 for r, g in zip(rest[y][x], guess, strict=True)]
    return _packed(np.array(out).reshape(-1, 4))


def _signed(v: np.ndarray) -> np.ndarray:
    return (v & 255 ^ 128) - 128


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, tile: int, elements: np.ndarray) -> np.ndarray:
    ch = _channels(pixels).reshape(height, width, 4)
    e = _channels(elements)[np.arange(height)[:, None] >> tile, np.arange(width)[None, :] >> tile]
    red_to_blue, green_to_blue, green_to_red = (_signed(e[..., k]) for k in (1, 2, 3))
    green = _signed(ch[..., 2])
    red = (ch[..., 1] + (green_to_red * green >> 5)) & 255
    ch[..., 3] += (green_to_blue * green >> 5) + (red_to_blue * _signed(red) >> 5)
    ch[..., 1] = red
    return _packed(ch.reshape(-1, 4))


def _open(data: bytes) -> tuple[int, int, int, list, Bits]:
    """(width, height, width of the coded image, transforms to undo, bits from the image on) of a RIFF file, simple or extended."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("not a WebP file")
    at = 12
    # an extended file has VP8X, and maybe ICCP and others, before the image
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data) or data[at : at + 4] in (b"VP8 ", b"ALPH", b"ANIM", b"ANMF"):
            raise WebPError("not a lossless still image")
        size = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + size + (size & 1)
    if at + 8 > len(data):
        raise WebPError("cut off")
    size = struct.unpack_from("<I", data, at + 4)[0]
    body = data[at + 8 : at + 8 + size]
    if body[:1] != b"\x2f" or len(body) != size:
        raise WebPError("bad signature or size")
    bits = Bits(body[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    wide, undo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform came twice")
        seen.add(kind)
        if kind in (0, 1):
            tile = bits.read(3) + 2
            w, h = (wide + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            side = read_pixels(bits, w, h, False).reshape(h, w)
            if kind == 0:
                undo.append(lambda p, w=wide, t=tile, m=side: undo_predictor(p, w, height, t, m >> 8 & 255))
            else:
                undo.append(lambda p, w=wide, t=tile, m=side: undo_cross_colour(p, w, height, t, m))
        elif kind == 2:

            def add_green(p: np.ndarray) -> np.ndarray:
                ch = _channels(p)
                ch[:, 1] += ch[:, 2]
                ch[:, 3] += ch[:, 2]
                return _packed(ch)

            undo.append(add_green)
        else:
            colours = bits.read(8) + 1
            steps = _channels(read_pixels(bits, colours, 1, False))
            palette = np.zeros(256, np.uint32)
            palette[:colours] = _packed(np.cumsum(steps, axis=0))
            pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            full, wide = wide, (wide + (1 << pack) - 1) >> pack

            def paint(p: np.ndarray, full: int = full, narrow: int = wide, pack: int = pack, palette: np.ndarray = palette) -> np.ndarray:
                green = (p >> 8 & 255).reshape(height, narrow)
                x = np.arange(full)
                each = 8 >> pack
                index = green[:, x >> pack] >> ((x & ((1 << pack) - 1)) * each).astype(np.uint32) & ((1 << each) - 1)
                return palette[index].reshape(-1)

            undo.append(paint)
    return width, height, wide, undo, bits


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels) of one file; its first lossless image chunk counts."""
    width, height, wide, undo, bits = _open(data)
    pixels = read_pixels(bits, wide, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    return width, height, pixels


def decode_many(files: list[bytes]) -> list[tuple[int, int, np.ndarray] | None]:
    """``decode`` of every file, None for what is no lossless WebP; plain images side by side."""
    out: list[tuple[int, int, np.ndarray] | None] = [None] * len(files)
    plain, pending = [], 0

    def finish() -> None:
        for (k, width, height, _, undo, _, group), green in zip(plain, _side_by_side(plain), strict=True):
            if green is not None:
                red, blue, alpha = (int(c.table[0]) >> 4 for c in group[1:4])
                pixels = green.astype(np.uint32) << 8 | np.uint32(alpha << 24 | red << 16 | blue)
                for step in reversed(undo):
                    pixels = step(pixels)
                out[k] = width, height, pixels
        plain.clear()

    for k, data in enumerate(files):
        try:
            width, height, wide, undo, bits = _open(data)
            found = read_pixels(bits, wide, height, True, later=True)
        except (WebPError, TypeError, IndexError):
            continue
        if isinstance(found, list):
            plain.append((k, width, height, wide, undo, bits, found))
            pending += wide * height
            if pending >= TOGETHER:
                finish()
                pending = 0
        else:
            for step in reversed(undo):
                found = step(found)
            out[k] = width, height, found
    finish()
    return out


def _extra(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(extra bits, least value) of length or distance prefixes."""
    bits = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return bits, np.where(symbol < 4, symbol, (2 + (symbol & 1)) << bits) + 1


def _side_by_side(images: list[tuple]) -> list[np.ndarray | None]:
    """Green samples of plain images, None where the bits are broken."""
    if not images:
        return []
    bodies = [x[5].data for x in images]
    at = np.cumsum([0, *map(len, bodies)])
    data = np.frombuffer(b"".join(bodies) + bytes(16), np.uint8)
    word = np.ndarray((len(data) - 8,), "<i8", data.tobytes(), strides=(1,))
    tables, first, mask = [], [], []
    for k in (0, 4):
        codes = [x[6][k] for x in images]
        size = [len(c.table) for c in codes]
        tables.append(np.concatenate([c.table for c in codes]))
        first.append(np.cumsum(size) - size)
        mask.append(np.array(size) - 1)
    sizes = np.array([x[2] * x[3] for x in images])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    limit = 8 * at[1:]
    pos = 8 * at[:-1] + np.array([x[5].pos for x in images])
    out = np.zeros(int(ends[-1]), np.uint8)
    copies: list[tuple[np.ndarray, ...]] = []
    bad = np.zeros(len(images), bool)
    width = np.array([x[3] for x in images])
    short = np.array(SHORT_DISTANCES)
    top = len(word) - 1

    def peek(p: np.ndarray) -> np.ndarray:
        return word[np.minimum(p >> 3, top)] >> (p & 7)

    own = np.flatnonzero(sizes)
    p, o = pos[own], starts[own]
    end, base, cover = ends[own], first[0][own], mask[0][own]
    while len(own) >= FEW:
        entry = tables[0][base + (peek(p) & cover)]
        p += entry & 15
        entry >>= 4
        copy = np.flatnonzero(entry >= 256)
        if len(copy):
            literal = entry < 256
            out[o[literal]] = entry[literal]
            q, who = p[copy], own[copy]
            bits, least = _extra(entry[copy] - 256)
            length = least + (peek(q) & ((1 << bits) - 1))
            q += bits
            symbol = tables[1][first[1][who] + (peek(q) & mask[1][who])]
            q += symbol & 15
            bits, least = _extra(symbol >> 4)
            distance = least + (peek(q) & ((1 << bits) - 1))
            p[copy] = q + bits
            near = np.minimum(distance, len(short)) - 1
            distance = np.where(distance > len(short), distance - len(short), np.maximum(1, short[near, 0] + short[near, 1] * width[who]))
            wrong = (distance > o[copy] - starts[who]) | (o[copy] + length > end[copy])
            if wrong.any():
                bad[who[wrong]] = True
                length = np.where(wrong, end[copy] - o[copy], length)
                distance = np.where(wrong, 0, distance)
            copies.append((o[copy], length, distance))
            step = np.ones(len(own), np.int64)
            step[copy] = length
            o += step
        else:
            out[o] = entry
            o += 1
        more = o < end
        if not more.all():
            pos[own] = p
            own, p, o, end, base, cover = (x[more] for x in (own, p, o, end, base, cover))
    pos[own] = p
    for k, done in zip(own.tolist(), o.tolist(), strict=True):
        try:
            copies.append(_one_by_one(images[k], out[starts[k] : ends[k]], int(done - starts[k]), int(p[own == k][0] - 8 * at[k])))
            copies[-1] = (copies[-1][0] + starts[k], *copies[-1][1:])
        except WebPError:
            bad[k] = True
    bad |= pos > limit
    if copies:
        begin, length, distance = (np.concatenate(c) for c in zip(*copies, strict=True))
        _follow(out, begin, length, distance)
    return [None if b else out[x:y] for b, x, y in zip(bad.tolist(), starts.tolist(), ends.tolist(), strict=True)]


def _one_by_one(image: tuple, out: np.ndarray, at: int, pos: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reads on in one image: literals go to ``out``, copies (start, length, distance) are returned."""
    _, _, _, width, _, bits, group = image
    data, limit, n = bits.data, 8 * len(bits.data), len(out)
    green, mask = group[0].table.tolist(), len(group[0].table) - 1
    reader = Bits(data)
    copies, literals, places = [], [], []
    while at < n:
        entry = green[int.from_bytes(data[pos >> 3 : (pos >> 3) + 4], "little") >> (pos & 7) & mask]
        pos += entry & 15
        symbol = entry >> 4
        if symbol < 256:
            literals.append(symbol)
            places.append(at)
            at += 1
            continue
        reader.pos = pos
        length = _prefixed(reader, symbol - 256)
        distance = _distance(_prefixed(reader, group[4].read(reader)), width)
        pos = reader.pos
        if distance > at or at + length > n:
            raise WebPError("back-reference out of range")
        copies.append((at, length, distance))
        at += length
    if pos > limit:
        raise WebPError("truncated")
    out[places] = literals
    return tuple(np.array(c, np.int64) for c in zip(*copies, strict=True)) if copies else (np.zeros(0, np.int64),) * 3


def _follow(out: np.ndarray, begin: np.ndarray, length: np.ndarray, distance: np.ndarray) -> None:
    """Fills what copies cover: every place points back until it meets a literal; pointers are doubled."""
    total = int(length.sum())
    place = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(total)
    to = np.arange(len(out), dtype=np.int32 if len(out) < 1 << 31 else np.int64)
    to[place] = place - np.repeat(distance, length)
    left = place
    while len(left):
        further = to[to[left]]
        moved = further != to[left]
        to[left] = further
        left = left[moved]
    out[place] = out[to[place]]


def samples(pixels: np.ndarray) -> np.ndarray:
    """The 8-bit samples of a grey image: its green channel."""
    return (pixels >> 8).astype(np.uint8)
