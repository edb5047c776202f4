import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import op04_media, webp, webp_writer


def canonical(lengths):
    """{symbol: (bits as first-bit-lowest value, length)}."""
    out, value, before = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        value <<= n - before
        out[symbol] = (int(f"{value:0{n}b}"[::-1], 2), n)
        value, before = value + 1, n
    return out


def put_code(w, used, alphabet):
    """A code over ``used`` symbols; all of one length, found by padding to a power of two."""
    used = sorted(used)
    if len(used) == 1 and used[0] < 256:
        w.put(1, 1).put(0, 1).put(1, 1).put(used[0], 8)
        return {used[0]: (0, 0)}
    n = max(1, (len(used) - 1).bit_length())
    for s in range(alphabet):
        if len(used) == 1 << n:
            break
        if s not in used:
            used.append(s)
    # plain lengths: code-length symbols 0 and n, one bit each
    w.put(0, 1)
    order = webp.CODE_LENGTH_ORDER
    count = max(4, max(order.index(0), order.index(n)) + 1)
    w.put(count - 4, 4)
    for s in order[:count]:
        w.put(1 if s in (0, n) else 0, 3)
    w.put(0, 1)
    for s in range(alphabet):
        w.put(1 if s in used else 0, 1)
    return canonical(dict.fromkeys(used, n))


def prefix(value):
    """(symbol, extra bits, number of them) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def image(w, items, cache_bits=0, top=True):
    """Writes literals (ARGB int), ("copy", length, distance code) and ("cache", index)."""
    w.put(1, 1).put(cache_bits, 4) if cache_bits else w.put(0, 1)
    if top:
        w.put(0, 1)
    green, rest, dist = set(), [set(), set(), set()], set()
    for x in items:
        if isinstance(x, tuple) and x[0] == "copy":
            green.add(256 + prefix(x[1])[0])
            dist.add(prefix(x[2])[0])
        elif isinstance(x, tuple):
            green.add(280 + x[1])
        else:
            green.add(x >> 8 & 255)
            for k, shift in enumerate((16, 0, 24)):
                rest[k].add(x >> shift & 255)
    size = 280 + ((1 << cache_bits) if cache_bits else 0)
    codes = [put_code(w, green, size), *(put_code(w, r or {0}, 256) for r in rest), put_code(w, dist or {0}, 40)]
    for x in items:
        if isinstance(x, tuple) and x[0] == "copy":
            s, extra, n = prefix(x[1])
            w.put(*codes[0][256 + s]).put(extra, n)
            s, extra, n = prefix(x[2])
            w.put(*codes[4][s]).put(extra, n)
        elif isinstance(x, tuple):
            w.put(*codes[0][280 + x[1]])
        else:
            w.put(*codes[0][x >> 8 & 255])
            for k, shift in enumerate((16, 0, 24)):
                w.put(*codes[k + 1][x >> shift & 255])


def start(width, height):
    return webp_writer.Writer().put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)


def finish(w):
    return webp_writer._riff(b"\x2f" + w.bytes())


def plain(width, height, pixels):
    w = start(width, height).put(0, 1)
    image(w, pixels)
    return finish(w)


def random_pixels(n, seed=0, colours=None):
    rng = np.random.default_rng(seed)
    return [int(x) for x in (rng.choice(colours, n) if colours is not None else rng.integers(0, 1 << 32, n))]


@given(st.binary(min_size=1, max_size=3000))
@settings(max_examples=60, deadline=None)
def test_payload_round_trip(data):
    payload = op04_media.padded(data)
    stored = webp_writer.encode(payload)
    width, height, pixels = webp.decode(stored)
    assert webp.samples(pixels)[: len(payload)].tobytes() == payload and width * height >= len(payload)
    assert all((p == pixels).all() for _, _, p in webp.decode_many([stored] * 70))


def test_large_payload_is_wider():
    payload = bytes(range(256)) * 4 * (1 << 11)
    (width, height, pixels), *_ = webp.decode_many([webp_writer.encode(payload)])
    assert width > 64 and webp.samples(pixels)[: len(payload)].tobytes() == payload


def test_real_texts_take_the_codec(docs, spark, folder, monkeypatch):
    """Documents go through prefix codes and back-references, beside each other, and get smaller; scalar decoding agrees."""
    payloads = [op04_media.padded((r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    payloads += [op04_media.padded((r.text or "").encode()) for r in docs.collect()]
    files = webp_writer.encode_many(payloads)
    assert files == [webp_writer.encode(p) for p in payloads]
    followed = []
    inner = webp._follow
    monkeypatch.setattr(webp, "_follow", lambda out, begin, *rest: (followed.append(len(begin)), inner(out, begin, *rest)))
    got = webp.decode_many(files)
    assert sum(followed) > len(payloads)
    for payload, file, (_, _, pixels) in zip(payloads, files, got, strict=True):
        assert webp.samples(pixels)[: len(payload)].tobytes() == payload
        assert len(payload) < 600 or len(set(payload)) < 17 or len(file) < 0.8 * len(payload)
    for k in range(0, len(files), 9):
        if len(payloads[k]) < 20000:
            assert (webp.decode(files[k])[2] == got[k][2]).all()


def test_broken_files_beside_good_ones():
    rng = np.random.default_rng(6)
    good = [webp_writer.encode(op04_media.padded(bytes(rng.integers(97, 120, 900, np.uint8)) * 2)) for _ in range(80)]
    mixed = []
    for k, file in enumerate(good):
        bad = bytearray(file)
        if k % 3 == 1:
            for at in rng.integers(60, len(bad), 12):
                bad[at] ^= int(rng.integers(1, 256))
        mixed.append(bytes(bad) if k % 3 != 2 else file[: len(file) - 200] + b"\0" * 200)
    for file, found in zip(mixed, webp.decode_many([*mixed, b"", b"x" * 90]), strict=False):
        try:
            want = webp.decode(file)[2]
        except webp.WebPError:
            want = None
        assert (found is None) == (want is None) and (want is None or (found[2] == want).all())


def test_code_lengths():
    rng = np.random.default_rng(7)
    for counts in (rng.integers(0, 50, 280), 2 ** np.arange(30), np.array([0, 3, 0]), np.zeros(5, int), np.array([1, 1])):
        n = webp_writer.code_lengths(counts)
        assert ((n > 0) == (counts > 0)).all() and n.max(initial=0) <= webp_writer.MOST_BITS
        assert (counts > 0).sum() < 2 or sum(2.0 ** -x for x in n[n > 0].tolist()) == 1


def test_feature_by_hand(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op04_media.features(op04_media.to_media(docs)).collect():
        payload = op04_media.padded((texts[r.doc_id] or "").encode())
        n, total = len(payload), sum(payload)
        hist = ",".join(str(sum(b >> 4 == k for b in payload) * 1000 // n) for k in range(16))
        bits = "".join("1" if sum(payload[k * n // 64 : (k + 1) * n // 64]) * 64 > total else "0" for k in range(64))
        assert r.feature == f"mean={total * 1000 // n};hist={hist};ahash={int(bits, 2):016x}"


def test_prefix_codes():
    pixels = random_pixels(7 * 9)
    width, height, got = webp.decode(plain(7, 9, pixels))
    assert (width, height) == (7, 9) and got.tolist() == pixels


def test_back_references_and_cache():
    a, b, c = 0xFF112233, 0x80445566, 0x01020304
    bits = 4
    place = (b * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - bits)
    # distance codes: 2 is one to the left, 1 is one up, 120 + d is d pixels back
    items = [a, b, c, ("copy", 4, 2), ("copy", 3, 1), ("cache", place), ("copy", 5, 120 + 2)]
    w = start(8, 2).put(0, 1)
    image(w, items, cache_bits=bits)
    want = [a, b, c]
    want += [c] * 4  # one back
    for _ in range(3):
        want.append(want[-8] if len(want) >= 8 else want[-1])
    if len(want) > 10:
        want = want[:10]
    # the row above is only there from the eighth pixel on: built separately below
    w = start(4, 4).put(0, 1)
    image(w, [a, b, c, ("copy", 1, 2), ("copy", 4, 1), ("cache", place), ("copy", 7, 120 + 2)], cache_bits=bits)
    want = [a, b, c, c, a, b, c, c, b]
    for _ in range(7):
        want.append(want[-2])
    assert webp.decode(finish(w))[2].tolist() == want


def test_subtract_green():
    pixels = random_pixels(20, 3)
    stored = [(p & 0xFF00FF00) | ((p >> 16) - (p >> 8) & 255) << 16 | (p - (p >> 8) & 255) for p in pixels]
    w = start(5, 4).put(1, 1).put(2, 2).put(0, 1)
    image(w, stored)
    assert webp.decode(finish(w))[2].tolist() == pixels


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 40])
def test_palette(colours):
    palette = random_pixels(colours, 5)
    width, height = 13, 3
    index = np.random.default_rng(colours).integers(0, colours, (height, width))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, per = 8 >> pack, 1 << pack
    stored = []
    for row in index:
        for x in range(0, width, per):
            stored.append(0xFF000000 | sum(int(v) << (k * each) for k, v in enumerate(row[x : x + per])) << 8)
    ch = np.stack([np.array(palette, np.uint32) >> s & 255 for s in (24, 16, 8, 0)], axis=1).astype(int)
    steps = np.diff(ch, axis=0, prepend=np.zeros((1, 4), int)) & 255
    w = start(width, height).put(1, 1).put(3, 2).put(colours - 1, 8)
    image(w, [int(s[0] << 24 | s[1] << 16 | s[2] << 8 | s[3]) for s in steps], top=False)
    w.put(0, 1)
    image(w, stored)
    assert webp.decode(finish(w))[2].tolist() == [palette[i] for i in index.ravel()]


def reference_predict(mode, L, T, TL, TR):
    avg = lambda a, b: (a + b) // 2
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [l + t - c for l, t, c in zip(L, T, TL, strict=True)]
        return L if sum(abs(x - l) for x, l in zip(p, L, strict=True)) < sum(abs(x - t) for x, t in zip(p, T, strict=True)) else T
    one = {
        0: lambda l, t, c, r: 0, 1: lambda l, t, c, r: l, 2: lambda l, t, c, r: t, 3: lambda l, t, c, r: r, 4: lambda l, t, c, r: c, 5: lambda l, t, c, r: avg(avg(l, r), t), 6: lambda l, t, c, r: avg(l, c),
        7: lambda l, t, c, r: avg(l, t), 8: lambda l, t, c, r: avg(c, t), 9: lambda l, t, c, r: avg(t, r), 10: lambda l, t, c, r: avg(avg(l, c), avg(t, r)), 12: lambda l, t, c, r: clamp(l + t - c),
        13: lambda l, t, c, r: clamp(avg(l, t) + int((avg(l, t) - c) / 2)),
    }[mode]
    out = [one(*x) for x in zip(L, T, TL, TR, strict=True)]
    return [255, *out[1:]] if mode == 0 else out


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 9, 6
    ch = np.random.default_rng(mode).integers(0, 256, (height, width, 4)).tolist()
    stored = []
    for y in range(height):
        for x in range(width):
            if not y:
                guess = [255, 0, 0, 0] if not x else ch[0][x - 1]
            elif not x:
                guess = ch[y - 1][0]
            else:
                right = ch[y - 1][x + 1] if x + 1 < width else ch[y][0]
                guess = reference_predict(mode, ch[y][x - 1], ch[y - 1][x], ch[y - 1][x - 1], right)
            a, r, g, b = ((v - p) & 255 for v, p in zip(ch[y][x], guess, strict=True))
            stored.append(a << 24 | r << 16 | g << 8 | b)
    w = start(width, height).put(1, 1).put(0, 2).put(0, 3)
    image(w, [0xFF000000 | mode << 8] * (3 * 2), top=False)
    w.put(0, 1)
    image(w, stored)
    want = [a << 24 | r << 16 | g << 8 | b for row in ch for a, r, g, b in row]
    assert webp.decode(finish(w))[2].tolist() == want


def test_cross_colour():
    width, height = 6, 5
    ch = np.random.default_rng(1).integers(0, 256, (height * width, 4))
    red_to_blue, green_to_blue, green_to_red = 17, 200, 250
    s8 = lambda v: (v & 255 ^ 128) - 128
    stored = []
    for a, r, g, b in ch.tolist():
        nb = b - (s8(green_to_blue) * s8(g) >> 5) - (s8(red_to_blue) * s8(r) >> 5)
        nr = r - (s8(green_to_red) * s8(g) >> 5)
        stored.append(a << 24 | (nr & 255) << 16 | g << 8 | nb & 255)
    w = start(width, height).put(1, 1).put(1, 2).put(1, 3)
    image(w, [0xFF000000 | red_to_blue << 16 | green_to_blue << 8 | green_to_red], top=False)
    w.put(0, 1)
    image(w, stored)
    assert webp.decode(finish(w))[2].tolist() == [a << 24 | r << 16 | g << 8 | b for a, r, g, b in ch.tolist()]


def test_broken_files_are_errors():
    good = webp_writer.encode(bytes(range(64)) * 2)
    for bad in (b"", b"RIFF", good[:40], good[:20] + b"\0" + good[21:], b"JUNK" + good[4:]):
        with pytest.raises(webp.WebPError):
            webp.decode(bad)


def test_extended_files():
    simple = webp_writer.encode(b"payload " * 8)
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    riff = lambda body: b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body
    size = chunk(b"VP8X", bytes([0x3C, 0, 0, 0, 15, 0, 0, 0, 0, 0]))
    whole = riff(size + chunk(b"ICCP", b"odd") + simple[12:] + chunk(b"EXIF", b"x") + chunk(b"XMP ", b"<x/>"))
    got, want = op04_media.decode_all([whole])[0], op04_media.decode_all([simple])[0]
    assert got[:2] == want[:2] == (64, 1) and (got[2] == want[2]).all()
    for bad in (riff(size), riff(size + chunk(b"ANMF", simple[12:])), riff(size + chunk(b"VP8 ", b"lossy one")), whole[:47]):
        with pytest.raises(webp.WebPError):
            webp.decode(bad)


def test_query_reads_back_what_it_stored(spark, docs, empty):
    got = op04_media.features(op04_media.to_media(docs)).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), hashlib.sha256(op04_media.padded((r.text or "").encode())).hexdigest(), zlib.crc32(op04_media.padded((r.text or "").encode())[-64:])) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert op04_media.features(op04_media.to_media(empty)).count() == 0
    first = op04_media.from_media(op04_media.to_media(docs).filter("doc_id = 1")).first().image
    assert first.width == 64 and len(first.pixels) == first.width * first.height
    broken = op04_media.from_media(spark.createDataFrame([(None,), (b"junk",)], "media binary")).collect()
    assert [r.image.pixels for r in broken] == [None, None]
