"""WebP, lossless: transforms, prefix codes, colour cache and back references are read; written without transforms, a byte a channel."""

from __future__ import annotations

import struct
from functools import cache, lru_cache

import numpy as np

from ...errors import invalid, unsupported
from . import checked

#: Fixed values of the format: the order of code length codes, and offsets (left, up) of the short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICT, CROSS, GREEN, INDEX = range(4)
LITERALS, LENGTHS, CACHE_FACTOR = 256, 24, 0x1E35A7BD
REVERSED = np.array([int(f"{k:08b}"[::-1], 2) for k in range(256)], np.uint8)
#: Prefix codes that were read last, by size of the alphabet and first bits, as (bits, their number, code); and how many, so that the largest tables take 16 MB.
KNOWN: dict[tuple[int, int], tuple[int, int, Prefix]] = {}
MOST_KNOWN = 64
#: Pixels that are cut from the bit stream at a time.
CUT = 2**16


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise invalid("RIFF header")
    end, at, out = min(len(data), 8 + int.from_bytes(data[4:8], "little")), 12, []
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise invalid("a chunk ends behind the file")
        out.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


class Bits:
    """Bits from the lowest of each byte; what lies behind the end is 0 to look at and an error to take."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + bytes(8), 0, 8 * len(data)

    def look(self) -> int:
        """The next 24 bits at least."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)

    def window(self, n: int) -> int:
        """The next n bits."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.size:
            raise invalid("the bit stream ends early")

    def take(self, n: int) -> int:
        found = self.look() & ((1 << n) - 1)
        self.skip(n)
        return found


class Prefix:
    """A canonical prefix code, as a table of (symbol, length) by the next bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise invalid("a prefix code without symbols")
        self.bits = max(n for n, _ in used) if len(used) > 1 else 0
        if sum(2 ** (self.bits - n) for n, _ in used if self.bits) not in (0, 2**self.bits):
            raise invalid("a prefix code isn't complete")
        self.mask, self.table = (1 << self.bits) - 1, [(used[0][1], 0)] * (1 << self.bits)
        #: Whether all symbols have codes of self.bits bits.
        self.even = len(used) == 1 << self.bits
        code = last = 0
        for n, s in sorted(used) if self.bits else ():
            code <<= n - last
            first = int(f"{code:0{n}b}"[::-1], 2)
            for k in range(first, 1 << self.bits, 1 << n):
                self.table[k] = (s, n)
            code, last = code + 1, n
        self.symbols = np.array([s for s, _ in self.table], np.int64) if self.even else None

    def read(self, bits: Bits) -> int:
        symbol, n = self.table[bits.look() & self.mask]
        bits.skip(n)
        return symbol


@lru_cache(MOST_KNOWN)
def few(size: int, symbols: tuple[int, ...]) -> Prefix:
    if max(symbols) >= size:
        raise invalid("a symbol isn't in its alphabet")
    return Prefix([int(s in symbols) for s in range(size)])


def read_prefix(bits: Bits, size: int) -> Prefix:
    """The code at these bits; one that was read before from the same bits is the same."""
    if bits.look() & 1:
        bits.skip(1)
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        return few(size, (first, *([bits.take(8)] if two else [])))
    key, start = (size, bits.window(32)), bits.at
    found = KNOWN.pop(key, None)
    if found and bits.window(found[1]) == found[0]:
        bits.skip(found[1])
    else:
        code = new_prefix(bits, size)
        bits.at, n = start, bits.at - start
        found = bits.window(n), n, code
        bits.at = start + n
    if len(KNOWN) >= MOST_KNOWN:
        KNOWN.pop(next(iter(KNOWN)))
    KNOWN[key] = found
    return found[2]


def new_prefix(bits: Bits, size: int) -> Prefix:
    """A code that is given by the lengths of all symbols."""
    bits.skip(1)
    lengths = [0] * size
    own = [0] * 19
    for k in range(4 + bits.take(4)):
        own[LENGTH_ORDER[k]] = bits.take(3)
    code = Prefix(own)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, before = 0, 8
    while at < size and left > 0:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at], at = symbol, at + 1
            before = symbol or before
            continue
        times = {16: (3, 2), 17: (3, 3), 18: (11, 7)}[symbol]
        n = times[0] + bits.take(times[1])
        if at + n > size:
            raise invalid("code lengths run over their alphabet")
        lengths[at : at + n] = [before if symbol == 16 else 0] * n
        at += n
    return Prefix(lengths)


def extended(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + bits.take(more) + 1


@cache
def weights(*lengths: int) -> np.ndarray:
    """A column a code: what each bit of a pixel counts in it."""
    out, left = np.zeros((sum(lengths), len(lengths)), np.int64), 0
    for k, n in enumerate(lengths):
        out[left : left + n, k] = 1 << np.arange(n)
        left += n
    return out


def literals(bits: Bits, total: int, codes: list[Prefix]) -> np.ndarray:
    """Pixels of literals only, whose codes (green, red, blue, alpha) have one length each, so that all pixels take equally many bits."""
    step, start = sum(c.bits for c in codes), bits.at
    bits.skip(step * total)
    data, out = np.frombuffer(bits.data, np.uint8), np.empty(total, np.int64)
    for at in range(0, total, CUT):
        n, first = min(CUT, total - at), start + at * step
        cut = np.unpackbits(data[first >> 3 : (first + n * step + 7) >> 3], bitorder="little")[first & 7 :][: n * step].reshape(n, step)
        green, red, blue, alpha = (code.symbols[k] for code, k in zip(codes, (cut @ weights(*(c.bits for c in codes))).T, strict=True))
        out[at : at + n] = alpha << 24 | red << 16 | green << 8 | blue
    return out


def entropy_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels as 32-bit numbers: alpha, red, green, blue."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise invalid("colour cache size")
    zoom, groups_of, groups = 0, None, 1
    if top and bits.take(1):
        zoom = 2 + bits.take(3)
        across = -(-width >> zoom)
        kinds = entropy_image(bits, across, -(-height >> zoom), False) >> 8 & 0xFFFF
        groups_of, groups = kinds.reshape(-1, across).tolist(), int(kinds.max()) + 1
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    total, at, known = width * height, 0, 0
    green, red, blue, alpha, far = codes[0]
    if groups == 1 and all(c.even for c in codes[0][:4]) and green.symbols.max() < LITERALS:
        return literals(bits, total, codes[0][:4])
    out, cache = [0] * total, [0] * (1 << cache_bits)
    while at < total:
        if groups_of:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[groups_of[y >> zoom][x >> zoom]]
        symbol = green.read(bits)
        if symbol < LITERALS:
            r, b = red.read(bits), blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < LITERALS + LENGTHS:
            n, code = extended(symbol - LITERALS, bits), extended(far.read(bits), bits)
            if code > len(NEAR):
                back = code - len(NEAR)
            else:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + n > total:
                raise invalid("a back reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - back]
            at += n
        else:
            while known < at:
                cache[(CACHE_FACTOR * out[known] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[known]
                known += 1
            out[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.int64)


def channels(pixels: np.ndarray, width: int) -> np.ndarray:
    """height, width, 4 of alpha, red, green, blue."""
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], axis=-1).reshape(-1, width, 4)


def average(a: list, b: list) -> list:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def selected(left: list, top: list, corner: list) -> list:
    """Whichever of left and top is nearer to left + top - corner."""
    to_left, to_top = (sum(abs(x - c) for x, c in zip(p, corner, strict=True)) for p in (top, left))
    return left if to_left < to_top else top


def clamped(v: list) -> list:
    return [min(255, max(0, x)) for x in v]


def predicted(mode: int, left: list, top: list, corner: list, right: list) -> list:
    if mode == 5:
        return average(average(left, right), top)
    if mode in (6, 7):
        return average(left, corner if mode == 6 else top)
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode == 11:
        return selected(left, top, corner)
    if mode == 12:
        return clamped([a + b - c for a, b, c in zip(left, top, corner, strict=True)])
    if mode == 13:
        return clamped([a + int((a - c) / 2) for a, c in zip(average(left, top), corner, strict=True)])
    raise invalid(f"predictor {mode}")


def unpredicted(image: np.ndarray, modes: np.ndarray, zoom: int) -> np.ndarray:
    """Adds each pixel's guess from its left, top, top left and top right neighbours; guesses without the left one are added to whole runs."""
    height, width = image.shape[:2]
    out = image.copy()
    out[0, 0] = (out[0, 0] + (255, 0, 0, 0)) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = (out[y, 0] + above[0]) & 255
        above = np.concatenate([above, out[y, :1]])  # the right neighbour of the last is the first of this row
        row = out[y]
        kinds = modes[y >> zoom]
        x = 1
        while x < width:
            mode, end = int(kinds[x >> zoom]), min(width, ((x >> zoom) + 1) << zoom)
            if mode in (0, 14, 15):
                row[x:end] = (row[x:end] + (255, 0, 0, 0)) & 255
            elif mode == 1:
                row[x:end] = (np.cumsum(row[x:end], axis=0) + row[x - 1]) & 255
            elif mode in (2, 3, 4, 8, 9):
                top, right, corner = above[x:end], above[x + 1 : end + 1], above[x - 1 : end - 1]
                guess = {2: top, 3: right, 4: corner, 8: (corner + top) >> 1, 9: (top + right) >> 1}[mode]
                row[x:end] = (row[x:end] + guess) & 255
            else:
                near, left, rest = above[x - 1 : end + 1].tolist(), row[x - 1].tolist(), row[x:end].tolist()
                for k, p in enumerate(rest):
                    left = [(a + b) & 255 for a, b in zip(p, predicted(mode, left, near[k + 1], near[k], near[k + 2]), strict=True)]
                    rest[k] = left
                row[x:end] = rest
            x = end
    return out


def spread(table: np.ndarray, zoom: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(table, 1 << zoom, axis=0), 1 << zoom, axis=1)[:height, :width]


def signed(v: np.ndarray) -> np.ndarray:
    return v - ((v & 128) << 1)


def uncrossed(image: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Adds to red what goes with green, and to blue what goes with green and red."""
    _, red_to_blue, green_to_blue, green_to_red = (signed(factors[..., k]) for k in range(4))
    out, green = image.copy(), signed(image[..., 2])
    out[..., 1] = (out[..., 1] + (green_to_red * green >> 5)) & 255
    out[..., 3] = (out[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(out[..., 1]) >> 5)) & 255
    return out


def unindexed(image: np.ndarray, table: np.ndarray, bundle: int, width: int) -> np.ndarray:
    """Colours by their number in green; several numbers are in one pixel if the table is small. Numbers behind the table are clear."""
    index, bits = image[..., 2], 8 >> bundle
    if bundle:
        index = (index[..., None] >> (bits * np.arange(1 << bundle))) & ((1 << bits) - 1)
        index = index.reshape(len(image), -1)[:, :width]
    full = np.zeros((256, 4), np.int64)
    full[: len(table)] = table
    return full[index]


def read_lossless(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise invalid("VP8L signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    checked(width, height)
    opaque = not bits.take(1)
    if bits.take(3):
        raise invalid("VP8L version")
    todo: list[tuple] = []
    across = width
    while bits.take(1):
        kind = bits.take(2)
        if any(t[0] == kind for t in todo):
            raise invalid("a transform comes twice")
        if kind in (PREDICT, CROSS):
            zoom = 2 + bits.take(3)
            table = channels(entropy_image(bits, -(-across >> zoom), -(-height >> zoom), False), -(-across >> zoom))
            todo.append((kind, across, zoom, table))
        elif kind == INDEX:
            n = bits.take(8) + 1
            table = np.cumsum(channels(entropy_image(bits, n, 1, False), n)[0], axis=0) & 255
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, across, bundle, table))
            across = -(-across >> bundle)
        else:
            todo.append((kind, across, 0, None))
    image = channels(entropy_image(bits, across, height, True), across)
    for kind, wide, zoom, table in reversed(todo):
        if kind == PREDICT:
            image = unpredicted(image, table[..., 2] & 15, zoom)
        elif kind == CROSS:
            image = uncrossed(image, spread(table, zoom, height, wide))
        elif kind == GREEN:
            image = (image + image[..., 2:3] * (0, 1, 0, 1)) & 255
        else:
            image = unindexed(image, table, zoom, wide)
    out = image[..., [1, 2, 3, 0]].astype(np.uint8)
    if opaque:
        out[..., 3] = 255
    return out


def decode(data: bytes) -> np.ndarray:
    for name, body in chunks(data):
        if name == b"VP8L":
            return read_lossless(body)
        if name in (b"VP8 ", b"ALPH", b"ANMF"):
            raise unsupported("lossy or animated WebP")
    raise invalid("no image chunk")


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


#: Bits before the prefix codes: signature, sides, alpha, version, no transforms, colour cache or groups.
HEAD_BITS = 8 + 14 + 14 + 1 + 3 + 3


@cache
def code_bits() -> tuple[int, int]:
    """The prefix codes of all written files, as bits and their number."""
    bits: list[int] = []
    put = lambda value, n: bits.extend(value >> k & 1 for k in range(n))
    for extra in (LENGTHS, 0, 0, 0):  # codes of 8 bits; the lengths are 8 (code 0) and runs of 11 to 138 zeros (code 1)
        put(0, 1)
        put(LENGTH_ORDER.index(8) + 1 - 4, 4)
        for symbol in LENGTH_ORDER[: LENGTH_ORDER.index(8) + 1]:
            put(int(symbol in (8, 18)), 3)
        put(0, 1 + 256)
        if extra:
            put(1, 1)
            put(extra - 11, 7)
    put(0b0001, 4)  # distances: the one symbol 0
    return sum(b << k for k, b in enumerate(bits)), len(bits)


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    if width > 2**14 or height > 2**14:
        raise unsupported("WebP of more than 16384 pixels a side")
    alpha = bool((pixels[..., 3] < 255).any())
    codes, n = code_bits()
    n += HEAD_BITS
    cells = REVERSED[pixels[..., [1, 0, 2, 3]]].tobytes()
    body = 0x2F | (width - 1) << 8 | (height - 1) << 22 | int(alpha) << 36 | codes << HEAD_BITS | int.from_bytes(cells, "little") << n
    image = chunk(b"VP8L", body.to_bytes((n + 8 * len(cells) + 7) >> 3, "little"))
    if metadata:
        head = struct.pack("<I", (0x10 if alpha else 0) | 0x08) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
        image = chunk(b"VP8X", head) + image + chunk(b"EXIF", metadata)
    return b"RIFF" + struct.pack("<I", 4 + len(image)) + b"WEBP" + image
