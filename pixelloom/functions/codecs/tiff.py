"""TIFF: strips of 8- or 16-bit unsigned samples; written as one uncompressed RGBA strip."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ...errors import invalid, unsupported
from . import checked

#: Bytes of a value by field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I"}


def fields(data: bytes) -> tuple[str, dict[int, tuple[int, ...]]]:
    """Byte order and the integer fields of the first directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise invalid("no TIFF header")
    at = struct.unpack(order + "I", data[4:8])[0]
    if at + 2 > len(data):
        raise invalid("TIFF directory")
    n = struct.unpack(order + "H", data[at : at + 2])[0]
    out = {}
    for k in range(n):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            raise invalid("TIFF directory ends early")
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind in CODES and count < 2**24:
            size = SIZES[kind] * count
            where = 0 if size <= 4 else struct.unpack(order + "I", entry[8:])[0]
            value = entry[8 : 8 + size] if size <= 4 else data[where : where + size]
            if len(value) < size:
                raise invalid("a TIFF value ends early")
            out[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", value)
    return order, out


def unpack_bits(data: bytes, n: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < n and at < len(data):
        k = data[at]
        at += 1
        if k < 128:
            out += data[at : at + k + 1]
            at += k + 1
        elif k > 128 and at < len(data):
            out += data[at : at + 1] * (257 - k)
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes, n: int) -> bytes:
    """Most-significant-bit-first codes whose width grows one code early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out = list(base), 9, None, bytearray()
    held = bits = 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFFFF
        bits += 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            if code == 256:
                table, width, last = list(base), 9, None
                continue
            if code == 257 or len(out) >= n:
                return bytes(out)
            if last is None:
                if code > 255:
                    raise invalid("first LZW code")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise invalid("LZW code beyond the table")
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
            out += entry
            last = entry
    return bytes(out)


def decode(data: bytes) -> np.ndarray:
    order, tags = fields(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height = one(256), one(257)
    if width is None or height is None:
        raise invalid("TIFF without dimensions")
    checked(width, height)
    if 322 in tags or 324 in tags:
        raise unsupported("tiled TIFF")
    samples, packing, photometric, predictor = one(277, 1), one(259, 1), one(262, 1), one(317, 1)
    depths = set(tags.get(258, (1,)))
    if one(284, 1) != 1 or len(depths) != 1 or not depths <= {8, 16} or set(tags.get(339, (1,))) != {1} or predictor not in (1, 2) or packing not in (1, 5, 8, 32946, 32773):
        raise unsupported("TIFF layout")
    if photometric not in (0, 1, 2, 3):
        raise unsupported(f"TIFF colours {photometric}")
    base = 3 if photometric == 2 else 1
    if samples < base:
        raise invalid("TIFF samples a pixel")
    wide = depths.pop() // 8
    per_strip, row = min(one(278, height) or height, height), width * samples * wide
    raw = bytearray()
    for k, (start, size) in enumerate(zip(tags.get(273, ()), tags.get(279, (len(data),)), strict=False)):
        need = row * min(per_strip, max(height - k * per_strip, 0))
        strip = data[start : start + size]
        try:
            part = {1: lambda: strip, 32773: lambda: unpack_bits(strip, need), 5: lambda: unpack_lzw(strip, need)}.get(packing, lambda: zlib.decompressobj().decompress(strip, need))()
        except zlib.error as e:
            raise invalid(f"TIFF strip: {e}") from None
        if len(part) < need:
            raise invalid("a TIFF strip ends early")
        raw += part[:need]
    if len(raw) < row * height:
        raise invalid("TIFF strips are missing")
    cells = np.frombuffer(bytes(raw), order + "u2" if wide == 2 else "u1").astype(np.uint16 if wide == 2 else np.uint8).reshape(height, width, samples)
    if predictor == 2:
        cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
    out = np.full((height, width, 4), 255, np.uint8)
    if photometric == 3:
        colors = np.array(tags.get(320, ()), np.int64)
        n = len(colors) // 3
        if not n or int(cells[..., 0].max()) >= n:
            raise invalid("TIFF palette")
        out[..., :3] = (colors.reshape(3, n) >> 8).T[cells[..., 0]]
    else:
        eight = (cells >> 8 if wide == 2 else cells).astype(np.uint8)
        out[..., :3] = 255 - eight[..., :1] if photometric == 0 else eight[..., :base]
        if samples > base and tags.get(338, (0,))[0] in (1, 2):
            out[..., 3] = eight[..., base]
    return out


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    n, start = 4 * width * height, 8 + 2 + 12 * 11 + 4
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 4, start), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, start + 8), (277, 3, 1, 4), (278, 4, 1, height), (279, 4, 1, n), (284, 3, 1, 1), (338, 3, 1, 2)]
    body = b"".join(struct.pack("<HHII", *e) for e in entries)
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + body + struct.pack("<I4H", 0, 8, 8, 8, 8) + pixels.tobytes()
