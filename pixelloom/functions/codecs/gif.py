"""GIF: the first frame on its transparent screen; written with up to 256 colours."""

from __future__ import annotations

import struct

import numpy as np

from ...errors import INVALID_DIMENSIONS, ImageError, invalid
from . import checked


def unpack_lzw(data: bytes, size: int, n: int) -> list[int]:
    """n indices from least-significant-bit-first codes that start with size + 1 bits."""
    clear, end = 1 << size, (1 << size) + 1
    base: list[bytes] = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last, out = list(base), size + 1, None, bytearray()
    held = bits = 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == clear:
                table, width, last = list(base), size + 1, None
                continue
            if code == end or len(out) >= n:
                return list(out[:n])
            if last is None:
                if code >= clear:
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
            if len(table) == 1 << width and width < 12:
                width += 1
            out += entry
            last = entry
    return list(out[:n])


def pack_lzw(indices: list[int], size: int) -> bytes:
    clear, end = 1 << size, (1 << size) + 1
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    table, width = {(i,): i for i in range(clear)}, size + 1
    free, prefix = end + 1, ()
    put(clear, width)
    for i in indices:
        longer = (*prefix, i)
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        if free < 4096:
            table[longer] = free
            free += 1
            if free > 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table, width, free = {(k,): k for k in range(clear)}, size + 1, end + 1
        prefix = (i,)
    if prefix:
        put(table[prefix], width)
        if free < 4096 and free + 1 > 1 << width and width < 12:
            width += 1
    put(end, width)
    if bits:
        out.append(held & 255)
    return bytes(out)


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise invalid("GIF blocks end early")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


def decode(data: bytes) -> np.ndarray:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise invalid("no GIF header")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    checked(width, height)
    at, shared, clear = 13, None, None

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << (flags & 7) + 1
        colors = np.frombuffer(data[at : at + n], np.uint8)
        if len(colors) < n:
            raise invalid("GIF palette ends early")
        at += n
        return colors.reshape(-1, 3)

    if flags & 0x80:
        shared = palette(flags)
    while at < len(data):
        mark = data[at]
        at += 1
        if mark == 0x21:
            label = data[at] if at < len(data) else 0
            content, at = blocks(data, at + 1)
            if label == 0xF9 and len(content) >= 4 and content[0] & 1:
                clear = content[3]
        elif mark == 0x2C:
            if at + 9 > len(data):
                break
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at : at + 9])
            at += 9
            checked(w, h)
            colors = palette(flags) if flags & 0x80 else shared
            if colors is None or left + w > width or top + h > height or at >= len(data):
                raise invalid("GIF frame")
            size = data[at]
            if not 2 <= size <= 11:
                raise invalid("LZW code size")
            packed, at = blocks(data, at + 1)
            indices = unpack_lzw(packed, size, w * h)
            if len(indices) < w * h:
                raise invalid("GIF pixels end early")
            if max(indices) >= len(colors):
                raise invalid("an index beyond the palette")
            frame = np.array(indices).reshape(h, w)
            if flags & 0x40:  # interlaced rows
                order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
                frame = frame[np.argsort(order)]
            out = np.zeros((height, width, 4), np.uint8)
            cell = np.dstack([colors[frame], np.where(frame == clear, 0, 255)]).astype(np.uint8) if clear is not None else np.dstack([colors[frame], np.full((h, w), 255)]).astype(np.uint8)
            if clear is not None:
                cell[frame == clear] = 0
            out[top : top + h, left : left + w] = cell
            return out
        elif mark == 0x3B:
            break
        else:
            raise invalid("GIF block")
    raise invalid("no GIF frame")


def median_cut(colors: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Palette of at most `most` colours and the index of each of the sorted distinct colours: the box with the widest channel is halved until there are enough."""
    boxes = [np.arange(len(colors))]
    while len(boxes) < most:
        spans = [np.ptp(colors[b], axis=0) for b in boxes]
        widest = max(range(len(boxes)), key=lambda k: (int(spans[k].max()) if len(boxes[k]) > 1 else -1, -k))
        if len(boxes[widest]) < 2 or not spans[widest].max():
            break
        box = boxes[widest]
        box = box[np.lexsort((box, colors[box, int(spans[widest].argmax())]))]
        boxes[widest] = box[: len(box) // 2]
        boxes.append(box[len(box) // 2 :])
    index = np.empty(len(colors), np.int64)
    for k, box in enumerate(boxes):
        index[box] = k
    means = np.stack([(colors[b].astype(np.int64) * counts[b, None]).sum(axis=0) // counts[b].sum() for b in boxes])
    return means.astype(np.uint8), index


def encode(pixels: np.ndarray, quality: int = 90, metadata: bytes | None = None) -> bytes:
    height, width = pixels.shape[:2]
    if max(width, height) > 65535:
        raise ImageError(INVALID_DIMENSIONS, "GIF sides")
    solid = pixels[..., 3] >= 128
    clear = not solid.all()
    colors, place, counts = np.unique(pixels[solid][:, :3], axis=0, return_inverse=True, return_counts=True)
    most = 255 if clear else 256
    if len(colors) > most:
        colors, index = median_cut(colors, counts, most)
        place = index[place.reshape(-1)]
    n = len(colors) + clear
    bits = max(1, (n - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(colors)] = colors
    indices = np.full((height, width), len(colors), np.int64)
    indices[solid] = place.reshape(-1)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | bits - 1, 0, 0), table.tobytes()]
    if clear:
        out.append(b"\x21\xf9\x04\x01\0\0" + bytes([len(colors)]) + b"\0")
    out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + bytes([max(2, bits)]))
    packed = pack_lzw(indices.reshape(-1).tolist(), max(2, bits))
    out += [bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)]
    return b"".join(out) + b"\0\x3b"
