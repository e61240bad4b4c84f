"""JPEG: baseline and progressive Huffman files of one or three components; written as baseline without subsampling."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ...errors import INVALID_DIMENSIONS, ImageError, invalid, unsupported
from . import checked

#: Fixed values of the standard: quantizers at quality 50 in rows, and the four example Huffman tables as code counts by length, then symbols.
LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMINANCE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
DC_LUMINANCE = bytes.fromhex("00010501010101010100000000000000" "000102030405060708090a0b")
DC_CHROMINANCE = bytes.fromhex("00030101010101010101010000000000" "000102030405060708090a0b")
AC_LUMINANCE = bytes.fromhex(
    "0002010303020403050504040000017d"
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
AC_CHROMINANCE = bytes.fromhex(
    "00020102040403040705040400010277"
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
)


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


ZIGZAG = zigzag()
ANGLES = (2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16
COSINES = np.cos(ANGLES) * np.where(np.arange(8)[:, None] == 0, np.sqrt(1 / 8), 0.5)


def codes(table: bytes) -> dict[tuple[int, int], int]:
    """Symbol of each (length, code)."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            if at >= len(table) or code >> length:
                raise invalid("Huffman table")
            out[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class Bits:
    """Bits of a scan's data, without stuffed bytes; data past the end reads as zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.left = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.left < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if self.at > len(self.data) + 64:
                raise invalid("JPEG scan ends early")
            self.at += 1
            self.held = (self.held << 8 | byte) & 0xFFFFFFFFFF
            self.left += 8

    def take(self, n: int) -> int:
        self.need(n)
        self.left -= n
        return self.held >> self.left & (1 << n) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise invalid("Huffman code")

    def value(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> n - 1 else v - (1 << n) + 1


@dataclass
class Component:
    key: int
    h: int
    v: int
    quant: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0))
    across: int = 0
    down: int = 0
    last: int = 0


@dataclass
class Scan:
    """What decodes a block: bounds of the coefficients, successive approximation, and blocks left of an end-of-band run."""

    start: int
    end: int
    high: int
    low: int
    progressive: bool
    run: int = 0

    def block(self, bits: Bits, part: Component, dc: dict, ac: dict, out: np.ndarray) -> None:
        if self.start == 0:
            if self.high:
                out[0] |= bits.take(1) << self.low
            else:
                part.last += bits.value(bits.symbol(dc))
                out[0] = part.last << self.low
        if self.progressive and self.start:
            (self.refine if self.high else self.first)(bits, ac, out)
        elif not self.progressive:
            self.first(bits, ac, out, 1)

    def first(self, bits: Bits, ac: dict, out: np.ndarray, start: int = 0) -> None:
        if self.run:
            self.run -= 1
            return
        k = max(self.start, start)
        while k <= self.end:
            skip, size = divmod(bits.symbol(ac), 16)
            if size:
                k += skip
                if k > self.end:
                    raise invalid("JPEG coefficient beyond the block")
                out[ZIGZAG[k]] = bits.value(size) << self.low
                k += 1
            elif skip == 15:
                k += 16
            else:
                self.run = (1 << skip) + (bits.take(skip) if skip else 0) - 1
                return

    def refine(self, bits: Bits, ac: dict, out: np.ndarray) -> None:
        one, k = 1 << self.low, self.start

        def correct(at: int) -> None:
            if bits.take(1) and not abs(out[at]) & one:
                out[at] += one if out[at] > 0 else -one

        if not self.run:
            while k <= self.end:
                skip, size = divmod(bits.symbol(ac), 16)
                new = 0
                if size:
                    new = one if bits.take(1) else -one
                elif skip < 15:
                    self.run = (1 << skip) + (bits.take(skip) if skip else 0)
                    break
                while k <= self.end:
                    at = ZIGZAG[k]
                    k += 1
                    if out[at]:
                        correct(at)
                    elif skip:
                        skip -= 1
                    else:
                        out[at] = new
                        break
        if self.run:
            for k in range(k, self.end + 1):
                if out[ZIGZAG[k]]:
                    correct(ZIGZAG[k])
            self.run -= 1


def split_scan(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Unstuffed data between restart markers, and where the next marker is."""
    parts, now = [], bytearray()
    while True:
        mark = data.find(b"\xff", at)
        if mark < 0 or mark + 1 >= len(data):
            raise invalid("JPEG scan without an end")
        now += data[at:mark]
        kind = data[mark + 1]
        if kind == 0:
            now.append(0xFF)
        elif 0xD0 <= kind <= 0xD7:
            parts.append(bytes(now))
            now = bytearray()
        elif kind == 0xFF:
            at = mark + 1
            continue
        else:
            return [*parts, bytes(now)], mark
        at = mark + 2


def decode(data: bytes) -> np.ndarray:
    if data[:3] != b"\xff\xd8\xff":
        raise invalid("no JPEG header")
    quants: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], dict] = {}
    parts: list[Component] = []
    at, interval, progressive, size = 2, 0, False, (0, 0)
    while True:
        while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise invalid("JPEG marker")
        kind = data[at + 1]
        at += 2
        if kind == 0xD9:
            break
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            continue
        n = int.from_bytes(data[at : at + 2], "big")
        content = data[at + 2 : at + n]
        if n < 2 or len(content) < n - 2:
            raise invalid("JPEG segment ends early")
        at += n
        if kind == 0xDB:
            while content:
                wide = content[0] >> 4
                cells = np.frombuffer(content[1 : 65 + 64 * wide], ">u2" if wide else "u1")
                if len(cells) < 64 or not cells.all():
                    raise invalid("quantizer table")
                quants[content[0] & 15] = cells.astype(np.int64)
                content = content[65 + 64 * wide :]
        elif kind == 0xC4:
            while content:
                used = 17 + sum(content[1:17])
                tables[content[0] >> 4, content[0] & 15] = codes(content[1:used])
                content = content[used:]
        elif kind == 0xDD and len(content) >= 2:
            interval = int.from_bytes(content[:2], "big")
        elif kind in (0xC0, 0xC1, 0xC2):
            if parts:
                raise unsupported("several frames")
            if len(content) < 6 or len(content) < 6 + 3 * content[5]:
                raise invalid("JPEG frame")
            progressive, size = kind == 0xC2, (int.from_bytes(content[3:5], "big"), int.from_bytes(content[1:3], "big"))
            if content[0] != 8 or content[5] not in (1, 3):
                raise unsupported("samples or components of this JPEG")
            checked(*size)
            parts = [Component(content[i], content[i + 1] >> 4, content[i + 1] & 15, content[i + 2]) for i in range(6, 6 + 3 * content[5], 3)]
            if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in parts):
                raise invalid("JPEG sampling")
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            wide, high = -(-size[0] // (8 * hmax)), -(-size[1] // (8 * vmax))
            if wide * high * sum(c.h * c.v for c in parts) > 8 * len(data):
                raise invalid("more blocks than the data can hold")
            for c in parts:
                c.across, c.down = wide * c.h, high * c.v
                c.blocks = np.zeros((c.down, c.across, 64), np.int32)
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise unsupported("this kind of JPEG coding")
        elif kind == 0xDA:
            by_key = {c.key: c for c in parts}
            count = content[0] if content else 0
            if not 1 <= count <= len(parts) or len(content) < 4 + 2 * count or any(content[1 + 2 * k] not in by_key for k in range(count)):
                raise invalid("JPEG scan header")
            chosen = [(by_key[content[1 + 2 * k]], content[2 + 2 * k]) for k in range(count)]
            start, end, approx = content[1 + 2 * count : 4 + 2 * count]
            scan = Scan(start, end if progressive else 63, approx >> 4, approx & 15, progressive) if progressive else Scan(0, 63, 0, 0, False)
            if scan.end > 63 or scan.start > scan.end or scan.start and count > 1:
                raise invalid("JPEG scan bounds")
            segments, at = split_scan(data, at)
            if count > 1:
                units = [[(c, ids, y * c.v + j, x * c.h + i) for c, ids in chosen for j in range(c.v) for i in range(c.h)] for y in range(high) for x in range(wide)]
            else:
                c, ids = chosen[0]
                units = [[(c, ids, y, x)] for y in range(-(-size[1] * c.v // (8 * vmax))) for x in range(-(-size[0] * c.h // (8 * hmax)))]
            step = interval or len(units)
            for k, segment in enumerate(segments[: -(-len(units) // step)]):
                bits, scan.run = Bits(segment), 0
                for c, _ in chosen:
                    c.last = 0
                for unit in units[k * step : (k + 1) * step]:
                    for c, ids, y, x in unit:
                        try:
                            scan.block(bits, c, tables.get((0, ids >> 4), {}), tables.get((1, ids & 15), {}), c.blocks[y, x])
                        except OverflowError:
                            raise invalid("JPEG coefficient") from None
    if not parts:
        raise invalid("JPEG without a frame")
    planes = []
    for c in parts:
        if c.quant not in quants:
            raise invalid("missing quantizer table")
        row_major = np.empty(64, np.int64)
        row_major[ZIGZAG] = quants[c.quant]
        cells = (c.blocks * row_major).reshape(c.down, c.across, 8, 8)
        pixels = np.einsum("ui,yxuv,vj->yixj", COSINES, cells, COSINES, optimize=True).reshape(c.down * 8, c.across * 8)
        plane = np.clip(np.floor(pixels + 128.5), 0, 255).astype(np.int64)
        planes.append(plane[np.arange(size[1])[:, None] * c.v // vmax, np.arange(size[0])[None, :] * c.h // hmax])
    out = np.full((size[1], size[0], 4), 255, np.uint8)
    if len(planes) == 1:
        out[..., :3] = planes[0][..., None]
    else:
        y, u, v = planes[0], planes[1] - 128, planes[2] - 128
        rgb = y + (91881 * v + 32768 >> 16), y - (22554 * u + 46802 * v + 32768 >> 16), y + (116131 * u + 32768 >> 16)
        out[..., :3] = np.clip(np.stack(rgb, axis=2), 0, 255)
    return out


def quantizers(quality: int) -> list[np.ndarray]:
    quality = max(1, min(100, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    if max(width, height) > 65535:
        raise ImageError(INVALID_DIMENSIONS, "JPEG sides")
    quants = quantizers(quality)
    rgb = np.pad(pixels[..., :3].astype(float), ((0, -height % 8), (0, -width % 8), (0, 0)), "edge")
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    coefficients = []
    for k, p in enumerate(planes):
        blocks = p.reshape(p.shape[0] // 8, 8, -1, 8)
        freq = np.einsum("ui,yixj,vj->yxuv", COSINES, blocks, COSINES, optimize=True).reshape(-1, 64) / quants[min(k, 1)]
        coefficients.append(np.clip(np.sign(freq) * np.floor(np.abs(freq) + 0.5), -1023, 1023).astype(int)[:, ZIGZAG])
    tables = [{s: code for code, s in codes(t).items()} for t in (DC_LUMINANCE, AC_LUMINANCE, DC_CHROMINANCE, AC_CHROMINANCE)]
    held = bits = 0
    data, last = bytearray(), [0, 0, 0]

    def put(n: int, value: int) -> None:
        nonlocal held, bits
        held, bits = held << n | value, bits + n
        while bits >= 8:
            byte = held >> bits - 8 & 255
            data.append(byte)
            if byte == 255:
                data.append(0)
            bits -= 8
            held &= (1 << bits) - 1

    def number(v: int, n: int) -> None:
        if n:
            put(n, v if v > 0 else v + (1 << n) - 1)

    for block in range(len(coefficients[0])):
        for k in range(3):
            cells = coefficients[k][block].tolist()
            dc, ac = tables[2 * min(k, 1) : 2 * min(k, 1) + 2]
            diff, last[k] = cells[0] - last[k], cells[0]
            n = abs(diff).bit_length()
            put(*dc[n])
            number(diff, n)
            zeros = 0
            for v in cells[1:]:
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    put(*ac[0xF0])
                    zeros -= 16
                n = abs(v).bit_length()
                put(*ac[zeros << 4 | n])
                number(v, n)
                zeros = 0
            if zeros:
                put(*ac[0])
    if bits:
        put(8 - bits, (1 << 8 - bits) - 1)
    segment = lambda kind, content: bytes([0xFF, kind]) + struct.pack(">H", len(content) + 2) + content
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    if metadata and len(metadata) <= 65527:
        out += segment(0xE1, b"Exif\0\0" + metadata)
    for k, q in enumerate(quants):
        out += segment(0xDB, bytes([k]) + bytes(q[ZIGZAG].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x11\0\x02\x11\1\x03\x11\1")
    for head, table in ((0x00, DC_LUMINANCE), (0x10, AC_LUMINANCE), (0x01, DC_CHROMINANCE), (0x11, AC_CHROMINANCE)):
        out += segment(0xC4, bytes([head]) + table)
    return out + segment(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0") + bytes(data) + b"\xff\xd9"
