"""EXIF blocks: where files keep them, lenient parsing, serializing, orientation, and places on Earth."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Bytes of a value by field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Tag numbers.
ORIENTATION, PHOTO_POINTER, GPS_POINTER = 274, 34665, 34853
NAMES = {"make": 271, "model": 272, "software": 305, "date_time": 306}
PHOTO_NAMES = {"exposure_time": 33434, "f_number": 33437, "iso": 34855, "date_time_original": 36867, "focal_length": 37386, "lens_model": 42036}
LATITUDE_REF, LATITUDE, LONGITUDE_REF, LONGITUDE, ALTITUDE_REF, ALTITUDE = 1, 2, 3, 4, 5, 6
#: Tags that say how a TIFF image is stored, not what it shows.
STRUCTURAL = frozenset([254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322, 323, 324, 325, 338, 339, 513, 514])
MOST_ENTRIES, MOST_VALUES = 512, 65536
#: A value: field type, then ints, floats, (numerator, denominator) pairs, text or bytes.
Value = tuple[int, object]


@dataclass
class Exif:
    tags: dict[int, Value] = field(default_factory=dict)
    photo: dict[int, Value] = field(default_factory=dict)
    gps: dict[int, Value] = field(default_factory=dict)


def directory(data: bytes, at: int, order: str) -> dict[int, Value]:
    """The entries that can be read; bad ones are skipped."""
    out: dict[int, Value] = {}
    if at + 2 > len(data):
        return out
    for k in range(min(struct.unpack(order + "H", data[at : at + 2])[0], MOST_ENTRIES)):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in SIZES or count > MOST_VALUES:
            continue
        size = SIZES[kind] * count
        where = struct.unpack(order + "I", entry[8:])[0]
        value = entry[8 : 8 + size] if size <= 4 else data[where : where + size]
        if len(value) < size:
            continue
        if kind == 2:
            out[tag] = (kind, value.split(b"\0")[0].decode("utf-8", "replace"))
        elif kind == 7:
            out[tag] = (kind, bytes(value))
        elif kind in (5, 10):
            flat = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", value)
            out[tag] = (kind, list(zip(flat[::2], flat[1::2], strict=True)))
        else:
            out[tag] = (kind, list(struct.unpack(f"{order}{count}{CODES[kind]}", value)))
    return out


def parse(block: bytes) -> Exif | None:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
    if order is None or len(block) < 8:
        return None
    tags = directory(block, struct.unpack(order + "I", block[4:8])[0], order)
    below = lambda tag: directory(block, int(tags[tag][1][0]), order) if tag in tags and tags[tag][0] in (3, 4) and tags[tag][1] else {}
    photo, gps = below(PHOTO_POINTER), below(GPS_POINTER)
    return Exif({k: v for k, v in tags.items() if k not in (PHOTO_POINTER, GPS_POINTER)}, photo, gps)


def value_bytes(kind: int, value: object) -> tuple[int, bytes]:
    if kind == 2:
        text = value.encode() + b"\0"
        return len(text), text
    if kind == 7:
        return len(value), value
    if kind in (5, 10):
        flat = [x for pair in value for x in pair]
        return len(value), struct.pack(f"<{len(flat)}{'I' if kind == 5 else 'i'}", *flat)
    return len(value), struct.pack(f"<{len(value)}{CODES[kind]}", *value)


def serialize(exif: Exif) -> bytes:
    """A little-endian block: tags sorted, values of over 4 bytes after their directory at even places, orientation 1."""
    tags = dict(exif.tags)
    if ORIENTATION in tags:
        tags[ORIENTATION] = (3, [1])
    room = lambda d: 2 + 12 * len(d) + 4 + sum((n + 1) // 2 * 2 for k, v in d.values() if (n := len(value_bytes(k, v)[1])) > 4)
    if exif.photo:
        tags[PHOTO_POINTER] = (4, [0])
    if exif.gps:
        tags[GPS_POINTER] = (4, [0])
    start = 8 + room(tags)
    if exif.photo:
        tags[PHOTO_POINTER], start = (4, [start]), start + room(exif.photo)
    if exif.gps:
        tags[GPS_POINTER] = (4, [start])

    def put(entries: dict[int, Value], at: int) -> bytes:
        head, tail = struct.pack("<H", len(entries)), b""
        far = at + 2 + 12 * len(entries) + 4
        for tag in sorted(entries):
            kind, value = entries[tag]
            count, data = value_bytes(kind, value)
            if len(data) <= 4:
                head += struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, kind, count, far + len(tail))
                tail += data + b"\0" * (len(data) % 2)
        return head + b"\0\0\0\0" + tail

    out = b"II*\0" + struct.pack("<I", 8) + put(tags, 8)
    for part in (exif.photo, exif.gps):
        if part:
            out += put(part, len(out))
    return out


def locate(data: bytes) -> bytes | None:
    """The EXIF block of a JPEG, PNG, WebP or TIFF file."""
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # a fill byte, markers without a length
                at += 1 if kind == 0xFF else 2
                continue
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + n]
            if kind == 0xDA:
                return None
            at += 2 + n
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + n]
            at += 12 + n
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            kind, n = struct.unpack("<4sI", data[at : at + 8])
            if kind == b"EXIF":
                block = data[at + 8 : at + 8 + n]
                return block[6:] if block[:6] == b"Exif\0\0" else block
            at += 8 + n + n % 2
    elif data[:4] in (b"II*\0", b"MM\0*"):
        return data
    return None


def read(data: bytes) -> Exif | None:
    """EXIF of a file; of TIFF files without what says how the image is stored."""
    block = locate(data)
    found = parse(block) if block else None
    if found and block is data:
        found.tags = {k: v for k, v in found.tags.items() if k not in STRUCTURAL}
    return found if found and (found.tags or found.photo or found.gps) else None


def orientation_of(data: bytes) -> int:
    found = read(data)
    kind, value = (found.tags if found else {}).get(ORIENTATION, (0, None))
    return value[0] if kind in (3, 4) and value and 1 <= value[0] <= 8 else 1


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    if orientation in (5, 6, 7):
        pixels = np.rot90(pixels, -1)
    elif orientation == 8:
        pixels = np.rot90(pixels)
    elif orientation == 3:
        pixels = pixels[::-1, ::-1]
    if orientation in (2, 5):
        pixels = pixels[:, ::-1]
    elif orientation in (4, 7):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def degrees(value: Value | None, reference: Value | None) -> float | None:
    """Degrees, minutes and seconds as one number, negative in the south and west."""
    if value is None or value[0] != 5 or len(value[1]) < 3 or any(d == 0 for _, d in value[1][:3]):
        return None
    d, m, s = (n / k for n, k in value[1][:3])
    total = d + m / 60 + s / 3600
    return -total if reference and reference[0] == 2 and reference[1][:1] in ("S", "W") else total


def altitude(value: Value | None, reference: Value | None) -> float | None:
    if value is None or value[0] != 5 or not value[1] or value[1][0][1] == 0:
        return None
    meters = value[1][0][0] / value[1][0][1]
    return -meters if reference and reference[0] == 1 and reference[1][:1] == [1] else meters
