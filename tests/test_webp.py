"""Lossless WebP streams that are put together here: transforms, prefix codes, colour cache, references."""

import numpy as np
import pytest

from pixelloom.errors import ImageError
from pixelloom.functions import codecs
from pixelloom.functions.codecs import info, webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, value, n):
        """A prefix code, from its highest bit."""
        self.bits += [value >> k & 1 for k in reversed(range(n))]

    def lengths(self, lengths):
        """Code lengths of up to 15, each as 4 bits."""
        self.put(0, 1)
        self.put(15, 4)
        for symbol in webp.LENGTH_ORDER:
            self.put(4 if symbol < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.code(n, 4)

    def image(self, pixels, top=False):
        """Literals of 8 bits; pixels: rows of alpha, red, green, blue."""
        self.put(0, 2 if top else 1)
        for more in (24, 0, 0, 0):
            self.lengths([8] * 256 + [0] * more)
        self.put(0b0001, 4)
        for p in pixels.reshape(-1, 4).tolist():
            for c in (2, 1, 3, 0):
                self.code(p[c], 8)

    def file(self):
        body = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        return b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBP" + webp.chunk(b"VP8L", body)


def header(width, height):
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def argb(data):
    return codecs.decode(data, "webp")[1][..., [3, 0, 1, 2]].astype(int)


def guess(mode, out, y, x):
    """The guess of a pixel by the format's definition."""
    width = out.shape[1]
    left, top, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
    right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
    half = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 13:
        a = half(left, top)
        return np.clip(a + np.trunc((a - corner) / 2).astype(int), 0, 255)
    return {
        0: np.array([255, 0, 0, 0]), 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right),
        10: half(half(left, corner), half(top, right)), 12: np.clip(left + top - corner, 0, 255),
    }[mode]


@pytest.mark.parametrize("shape", [(9, 10), (1, 5), (6, 1), (8, 16)])
def test_predictors(shape):
    rng = np.random.default_rng(sum(shape))
    height, width = shape
    across, down = -(-width // 4), -(-height // 4)
    for first in range(0, 14, 3):
        table = np.zeros((down, across, 4), int)
        table[..., 2] = (first + rng.permutation(down * across).reshape(down, across)) % 14
        noise = rng.integers(0, 256, (height, width, 4))
        w = header(width, height)
        w.put(0b001, 3)  # a transform: predictors
        w.put(0, 3)  # of 4 by 4 pixels
        w.image(table)
        w.put(0, 1)
        w.image(noise, top=True)
        want = np.zeros((height, width, 4), int)
        for y in range(height):
            for x in range(width):
                if y and x:
                    g = guess(int(table[y // 4, x // 4, 2]), want, y, x)
                else:
                    g = want[y - 1, x] if y else want[y, x - 1] if x else np.array([255, 0, 0, 0])
                want[y, x] = (noise[y, x] + g) % 256
        assert (argb(w.file()) == want).all()


def test_colors():
    rng = np.random.default_rng(5)
    factors, noise = rng.integers(0, 256, (2, 3, 4)), rng.integers(0, 256, (7, 9, 4))
    w = header(9, 7)
    w.put(0b011, 3)
    w.put(0, 3)
    w.image(factors)
    w.put(0b101, 3)  # then subtract green
    w.put(0, 1)
    w.image(noise, top=True)
    byte = lambda v: v - 256 if v > 127 else v
    want = noise.copy()
    for y in range(7):
        for x in range(9):
            a, r, g, b = noise[y, x].tolist()
            r, b = (r + g) % 256, (b + g) % 256
            _, rb, gb, gr = (byte(int(v)) for v in factors[y // 4, x // 4])
            r = (r + (gr * byte(g) >> 5)) % 256
            b = (b + (gb * byte(g) >> 5) + (rb * byte(r) >> 5)) % 256
            want[y, x] = a, r, g, b
    assert (argb(w.file()) == want).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(n):
    rng = np.random.default_rng(n)
    colors, index = rng.integers(0, 256, (n, 4)), rng.integers(0, n, (5, 11))
    index[0, 0] = n - 1
    bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    packed = np.zeros((5, -(-11 >> bundle), 4), int)
    for y in range(5):
        for x in range(11):
            packed[y, x >> bundle, 2] |= int(index[y, x]) << (x % (1 << bundle)) * (8 >> bundle)
    w = header(11, 5)
    w.put(0b111, 3)
    w.put(n - 1, 8)
    w.image(np.diff(colors, axis=0, prepend=np.zeros((1, 4), int))[None] % 256)
    w.put(0, 1)
    w.image(packed, top=True)
    assert (argb(w.file()) == colors[index]).all()


def test_cache_references_and_groups():
    """Two groups of codes; a literal, a colour from the cache, and copies by both kinds of distance."""
    w = header(8, 8)
    w.put(0, 1)
    w.put(1, 1)
    w.put(2, 4)  # a cache of four colours
    w.put(1, 1)
    w.put(0, 3)  # groups by 4 by 4 pixels
    kinds = np.zeros((2, 2, 4), int)
    kinds[1, :, 2] = 1
    w.image(kinds)
    color, other = (200, 10, 20, 30), (255, 1, 2, 3)
    slot = (webp.CACHE_FACTOR * (color[0] << 24 | color[1] << 16 | color[2] << 8 | color[3]) & 0xFFFFFFFF) >> 30
    for pixel in (color, other):
        lengths = [0] * (256 + 24 + 4)
        for symbol in (pixel[2], 256 + 3, 256 + 7, 280 + slot):  # a literal, lengths 4 and 13 to 16, the cache
            lengths[symbol] = 2
        w.lengths(lengths)
        for c in (1, 3, 0):
            w.put(0b101, 3)  # one symbol of 8 bits
            w.put(pixel[c], 8)
        w.lengths([int(s in (1, 13)) for s in range(40)])  # distance codes 2 (one to the left), and 97 to 128
    order = sorted((20, 259, 263, 280 + slot))
    put = lambda symbol: w.code(order.index(symbol), 2)
    put(20)  # pixel 0
    put(280 + slot)  # 1
    put(259), w.code(0, 1)  # 2 to 5: from the left
    put(263), w.put(3, 2), w.code(0, 1)  # 6 to 21, likewise
    put(263), w.put(1, 2), w.code(0, 1)  # 22 to 35, into the second group
    order = sorted((2, 259, 263, 280 + slot))
    put(2)  # 36: the other colour
    put(259), w.code(1, 1), w.put(24, 5)  # 37 to 40: distance code 121, so 1 to the left
    put(263), w.put(3, 2), w.code(1, 1), w.put(28, 5)  # 41 to 56: 5 to the left
    put(280 + slot)  # 57
    put(259), w.code(0, 1)  # 58 to 61
    put(2), put(280 + slot)  # 62, 63
    want = [color] * 36 + [other] * 21 + [color] * 5 + [other, color]
    assert (argb(w.file()).reshape(-1, 4) == np.array(want)).all()


def test_errors():
    p = np.arange(240, dtype=np.uint8).reshape(6, 10, 4)
    data = codecs.encode(p, "webp")
    assert info.describe(data) == {"format": "webp", "width": 10, "height": 6}
    for cut in range(0, len(data), 7):
        with pytest.raises(ImageError):
            codecs.decode(data[:cut], "webp")
    for kind in (b"VP8 ", b"ANMF"):
        with pytest.raises(ImageError, match="unsupported"):
            webp.decode(b"RIFF" + (4 + 18).to_bytes(4, "little") + b"WEBP" + webp.chunk(kind, bytes(10)))
    twice = header(2, 2)
    twice.put(0b101, 3), twice.put(0b101, 3)
    with pytest.raises(ImageError, match="twice"):
        codecs.decode(twice.file(), "webp")
    with pytest.raises(ImageError, match="complete"):
        webp.Prefix([1, 2, 0])


def test_equal_codes_are_made_once(monkeypatch):
    p = np.random.default_rng(8).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (codecs.decode(codecs.encode(p, "webp"))[1] == p).all()
    made = []
    monkeypatch.setattr(webp, "Prefix", lambda lengths, real=webp.Prefix: made.append(lengths) or real(lengths))
    assert (codecs.decode(codecs.encode(p[::-1], "webp"))[1] == p[::-1]).all()
    assert not made
    for n in range(2 * webp.MOST_KNOWN):  # others are made, and not all are kept
        w = Writer()
        w.lengths([3] * 4 + [4] * 8 + [0] * n)
        assert webp.read_prefix(webp.Bits(np.packbits(w.bits, bitorder="little").tobytes()), 12 + n).bits == 4
    assert len(made) >= 2 * webp.MOST_KNOWN and len(webp.KNOWN) <= webp.MOST_KNOWN


@pytest.mark.parametrize("size", [(1, 1), (9, 13)])
def test_codes_of_one_length_each(monkeypatch, size):
    """Greens of 3 bits, one red, blues of 1 bit and alphas of 8; cut in small parts and cut off."""
    monkeypatch.setattr(webp, "CUT", 10)
    rng = np.random.default_rng(9)
    want = np.stack([rng.integers(0, 256, size), np.full(size, 77), 40 + rng.integers(0, 8, size), rng.choice([3, 200], size)], axis=-1)
    w = header(size[1], size[0])
    w.put(0, 3)
    w.lengths([3 if 40 <= k < 48 else 0 for k in range(256 + 24)])
    w.put(0b101, 3)
    w.put(77, 8)
    w.lengths([int(k in (3, 200)) for k in range(256)])
    w.lengths([8] * 256)
    w.put(0b0001, 4)
    for a, _, g, b in want.reshape(-1, 4).tolist():
        w.code(g - 40, 3), w.code(int(b == 200), 1), w.code(a, 8)
    assert (argb(w.file()) == want).all()
    w.bits = w.bits[:-8]
    with pytest.raises(ImageError):
        argb(w.file())
