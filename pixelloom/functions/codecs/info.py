"""Format and size of an image from its header, without its pixels."""

from __future__ import annotations

import re
import struct

from ...errors import UNKNOWN_FORMAT, ImageError, invalid
from . import checked, detect, heic, heif, svg, webp


def jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            raise invalid("JPEG marker")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise invalid("no JPEG frame")


def tiff_size(data: bytes) -> tuple[int, int]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    found = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, _, value = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H2x" if kind == 3 else "I"), value)[0]
    return found[256], found[257]


def webp_size(data: bytes) -> tuple[int, int]:
    for name, body in webp.chunks(data):
        if name == b"VP8X":
            return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        if name == b"VP8L":
            bits = int.from_bytes(body[1:5], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if name == b"VP8 ":
            return tuple(v & 0x3FFF for v in struct.unpack("<HH", body[6:10]))
    raise invalid("no image chunk")


def netpbm_size(data: bytes) -> tuple[int, int]:
    found = re.match(rb"P[56](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)", data)
    if not found:
        raise invalid("Netpbm header")
    return int(found[1]), int(found[2])


def size_of(data: bytes, name: str) -> tuple[int, int]:
    """Width and height from the header."""
    try:
        return header_size(data, name)
    except (struct.error, KeyError):
        raise invalid("the header ends early") from None


def header_size(data: bytes, name: str) -> tuple[int, int]:
    if name == "png":
        return struct.unpack(">II", data[16:24])
    if name == "bmp":
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if name == "gif":
        return struct.unpack("<HH", data[6:10])
    if name == "qoi":
        return struct.unpack(">II", data[4:12])
    if name == "heic":
        return heic.size_of(data)
    if name == "svg":
        return svg.pixel_size(svg.root_of(data))
    return {"jpeg": jpeg_size, "tiff": tiff_size, "webp": webp_size, "netpbm": netpbm_size}[name](data)


def describe(data: bytes) -> dict:
    """format, width, height as stored, and for containers what heif.describe says."""
    name = detect(data)
    if name is None:
        raise ImageError(UNKNOWN_FORMAT, "no signature matches")
    if name in ("heic", "avif"):
        return {"format": name} | heif.describe(data)
    width, height = size_of(data, name)
    checked(width, height)
    return {"format": name, "width": width, "height": height}
