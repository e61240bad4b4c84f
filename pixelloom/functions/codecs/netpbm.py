"""Binary gray maps and pixel maps."""

from __future__ import annotations

import re

import numpy as np

from ...errors import invalid
from . import checked

HEADER = re.compile(rb"P([56])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")


def decode(data: bytes) -> np.ndarray:
    m = HEADER.match(data)
    if not m:
        raise invalid("no header of a binary map")
    width, height, most = (int(x) for x in m.groups()[1:])
    if not 0 < most < 65536:
        raise invalid("largest sample value")
    checked(width, height)
    channels = 3 if m[1] == b"6" else 1
    kind = np.dtype(">u2" if most > 255 else "u1")
    n = width * height * channels
    if len(data) - m.end() < n * kind.itemsize:
        raise invalid("samples end early")
    samples = np.frombuffer(data, kind, n, m.end()).astype(np.int64).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = np.minimum(samples, most) * 255 // most
    return out


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    return f"P6\n{width} {height}\n255\n".encode() + pixels[..., :3].tobytes()
