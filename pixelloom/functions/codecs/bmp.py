"""Windows bitmaps: 8-bit palettes, 24 and 32 bits."""

from __future__ import annotations

import struct

import numpy as np

from ...errors import invalid, unsupported
from . import checked


def decode(data: bytes) -> np.ndarray:
    if len(data) < 54 or data[:2] != b"BM":
        raise invalid("no bitmap header")
    start, header, width, height, _, depth, packing = struct.unpack("<IIiiHHI", data[10:34])
    if header < 40:
        raise unsupported("bitmap header of an old kind")
    if depth not in (8, 24, 32) or packing not in ((0, 3) if depth == 32 else (0,)):
        raise unsupported(f"bitmaps of {depth} bits, packing {packing}")
    rows = abs(height)
    checked(width, rows)
    stride = (width * depth // 8 + 3) // 4 * 4
    if start + stride * rows > len(data):
        raise invalid("bitmap data ends early")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * depth // 8]
    out = np.full((rows, width, 4), 255, np.uint8)
    if depth == 8:
        used = struct.unpack("<I", data[46:50])[0] or 256
        colors = np.frombuffer(data[14 + header : 14 + header + 4 * used], np.uint8)
        colors = colors[: len(colors) // 4 * 4].reshape(-1, 4)
        if lines.size and int(lines.max()) >= len(colors):
            raise invalid("an index beyond the palette")
        out[..., :3] = colors[lines][..., 2::-1]
    else:
        cells = lines.reshape(rows, width, depth // 8)
        out[..., :3] = cells[..., 2::-1]
        if depth == 32 and cells[..., 3].any():
            out[..., 3] = cells[..., 3]
    return out if height < 0 else out[::-1].copy()


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    stride = (3 * width + 3) // 4 * 4
    lines = np.zeros((height, stride), np.uint8)
    lines[:, : 3 * width] = pixels[::-1, :, 2::-1].reshape(height, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()
