"""PNG: every colour type and depth, both interlace methods; written as 8-bit RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ...errors import invalid
from . import checked

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type, and the depths that each allows.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column, first row and steps of the passes of Adam7.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """Type and content up to IEND, all with right checksums."""
    if data[:8] != SIGNATURE:
        raise invalid("no PNG signature")
    out, at = [], 8
    while True:
        if at + 12 > len(data):
            raise invalid("PNG chunks end early")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        content = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + content) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise invalid("PNG chunk checksum or length")
        out.append((kind, content))
        at += 12 + n
        if kind == b"IEND":
            return out


def unfilter(data: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    """Undo the filter of each row; rows are bytes."""
    lines = data.reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + step), np.uint8)
    for y in range(rows):
        kind, line, above = int(lines[y, 0]), lines[y, 1:], out[y, step:]
        if kind == 0:
            out[y + 1, step:] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            out[y + 1, step:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            out[y + 1, step:] = line + above
        elif kind in (3, 4):
            now, up = [0] * step + line.tolist(), out[y].tolist()
            for i in range(step, step + stride):
                a, b, c = now[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = (now[i] + guess) & 255
            out[y + 1] = now
        else:
            raise invalid(f"PNG filter {kind}")
    return out[1:, step:]


def samples_of(lines: np.ndarray, width: int, per_pixel: int, depth: int) -> np.ndarray:
    if depth == 16:
        return lines.view(">u2").reshape(len(lines), width, per_pixel).astype(np.int64)
    if depth < 8:
        lines = (np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth) * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, : width * per_pixel]
    return lines.reshape(len(lines), width, per_pixel).astype(np.int64)


def decode(data: bytes) -> np.ndarray:
    parts = chunks(data)
    if parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise invalid("no IHDR")
    width, height, depth, color, packing, filtering, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth not in DEPTHS.get(color, ()) or packing or filtering or interlace > 1:
        raise invalid("IHDR fields")
    checked(width, height)
    by_kind = {k: v for k, v in reversed(parts)}
    per_pixel = SAMPLES[color]
    step = max(1, per_pixel * depth // 8)
    areas = [(0, 0, 1, 1)] if not interlace else [p for p in PASSES if p[0] < width and p[1] < height]
    shapes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in areas]
    sizes = [h * ((w * per_pixel * depth + 7) // 8 + 1) for w, h in shapes]
    try:
        inflater = zlib.decompressobj()
        raw = inflater.decompress(b"".join(v for k, v in parts if k == b"IDAT"), sum(sizes) + 1)
    except zlib.error as e:
        raise invalid(f"PNG data: {e}") from None
    if len(raw) != sum(sizes):
        raise invalid("PNG data of a wrong length")
    samples, at = np.zeros((height, width, per_pixel), np.int64), 0
    for (x, y, dx, dy), (w, h), size in zip(areas, shapes, sizes, strict=True):
        lines = unfilter(np.frombuffer(raw, np.uint8, size, at), h, size // h - 1, step)
        samples[y::dy, x::dx] = samples_of(np.ascontiguousarray(lines), w, per_pixel, depth)
        at += size
    clear = by_kind.get(b"tRNS", b"")
    out = np.full((height, width, 4), 255, np.uint8)
    eight = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
    if color == 3:
        colors = np.frombuffer(by_kind.get(b"PLTE", b""), np.uint8)
        if not len(colors) or len(colors) % 3 or int(samples.max()) >= len(colors) // 3:
            raise invalid("PNG palette")
        alpha = np.full(len(colors) // 3, 255, np.uint8)
        alpha[: min(len(clear), len(alpha))] = np.frombuffer(clear, np.uint8)[: len(alpha)]
        out[..., :3], out[..., 3] = colors.reshape(-1, 3)[samples[..., 0]], alpha[samples[..., 0]]
        return out
    out[..., :3] = eight[..., :3] if per_pixel >= 3 else eight[..., :1]
    if color in (4, 6):
        out[..., 3] = eight[..., -1]
    elif len(clear) >= 2 * per_pixel:
        out[..., 3] = np.where((samples == np.frombuffer(clear, ">u2", per_pixel)).all(axis=2), 0, 255)
    return out


def row_filters(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows under each filter, and for each row the filter with the least sum of distances to 0 (the lower one on ties) and that sum; all rows at once."""
    height, width = pixels.shape[:2]
    now = np.zeros((height + 1, width + 1, 4), np.int16)
    now[1:, 1:] = pixels
    x, a, b, c = now[1:, 1:], now[1:, :-1], now[:-1, 1:], now[:-1, :-1]
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    ways = np.stack([x, x - a, x - b, x - (a + b) // 2, x - paeth]) & 255
    scores = np.minimum(ways, 256 - ways).sum(axis=(2, 3), dtype=np.int64)
    return ways, scores.argmin(axis=0), scores.min(axis=0)


def filtered(pixels: np.ndarray) -> bytes:
    """The rows, each after its filter type."""
    ways, best, _ = row_filters(pixels)
    lines = ways[best, np.arange(len(pixels))].astype(np.uint8).reshape(len(pixels), -1)
    return np.hstack([best.astype(np.uint8)[:, None], lines]).tobytes()


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    chunk = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))]
    if metadata:
        parts.append(chunk(b"eXIf", metadata))
    return SIGNATURE + b"".join([*parts, chunk(b"IDAT", zlib.compress(filtered(pixels), 6)), chunk(b"IEND", b"")])
