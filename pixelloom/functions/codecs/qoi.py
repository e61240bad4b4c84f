"""QOI, by its published specification."""

from __future__ import annotations

import struct

import numpy as np

from ...errors import invalid
from . import checked

END = b"\0" * 7 + b"\1"


def slot(p: tuple[int, int, int, int]) -> int:
    return (3 * p[0] + 5 * p[1] + 7 * p[2] + 11 * p[3]) % 64


def decode(data: bytes) -> np.ndarray:
    if len(data) < 14 or data[:4] != b"qoif":
        raise invalid("no QOI header")
    width, height, channels, space = struct.unpack(">IIBB", data[4:14])
    if channels not in (3, 4) or space > 1:
        raise invalid("QOI header fields")
    checked(width, height)
    seen, last, at, out = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, []
    n = width * height
    try:
        while len(out) < n:
            tag = data[at]
            at += 1
            count = 1
            if tag >= 0xFE:
                size = 3 if tag == 0xFE else 4
                if at + size > len(data):
                    raise IndexError
                last = (*data[at : at + 3], data[at + 3] if size == 4 else last[3])
                at += size
            elif tag >> 6 == 0:
                last = seen[tag]
            elif tag >> 6 == 1:
                last = tuple((c + d) % 256 for c, d in zip(last, ((tag >> 4 & 3) - 2, (tag >> 2 & 3) - 2, (tag & 3) - 2, 0), strict=True))
            elif tag >> 6 == 2:
                green, more = (tag & 63) - 32, data[at]
                at += 1
                last = tuple((c + d) % 256 for c, d in zip(last, (green + (more >> 4) - 8, green, green + (more & 15) - 8, 0), strict=True))
            else:
                count = (tag & 63) + 1
                if len(out) + count > n:
                    raise invalid("a run beyond the image")
            seen[slot(last)] = last
            out += [last] * count
    except IndexError:
        raise invalid("QOI data ends early") from None
    if data[at : at + 8] != END:
        raise invalid("no QOI end marker")
    return np.array(out, np.uint8).reshape(height, width, 4)


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    out = bytearray(b"qoif" + struct.pack(">IIBB", width, height, 4, 0))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for p in map(tuple, pixels.reshape(-1, 4).tolist()):
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        if seen[slot(p)] == p:
            out.append(slot(p))
        else:
            seen[slot(p)] = p
            r, g, b = ((x - y + 128) % 256 - 128 for x, y in zip(p[:3], last[:3], strict=True))
            if p[3] != last[3]:
                out += bytes([0xFF, *p])
            elif max(abs(2 * d + 1) for d in (r, g, b)) <= 3:
                out.append(0x40 | r + 2 << 4 | g + 2 << 2 | b + 2)
            elif -32 <= g < 32 and -8 <= r - g < 8 and -8 <= b - g < 8:
                out += bytes([0x80 | g + 32, r - g + 8 << 4 | b - g + 8])
            else:
                out += bytes([0xFE, *p[:3]])
        last = p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + END
