"""Image formats: one module each, with decode(data) -> array of height, width, 4 and, if there is an encoder, encode(pixels, options) -> bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

from ...errors import INVALID_DIMENSIONS, UNKNOWN_FORMAT, ImageError, unsupported

#: Pixels of a valid image at most.
MOST_PIXELS = 2**28
#: Brands of the two box formats.
HEIC_BRANDS = frozenset([b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1"])
AVIF_BRANDS = frozenset([b"avif", b"avis"])
FORMATS = ("png", "jpeg", "gif", "tiff", "webp", "heic", "avif", "bmp", "qoi", "netpbm", "svg")


def checked(width: int, height: int, most: int = MOST_PIXELS) -> None:
    if width <= 0 or height <= 0 or width * height > most:
        raise ImageError(INVALID_DIMENSIONS, f"{width} x {height}")


def brands(data: bytes) -> set[bytes]:
    """Major and compatible brands of a leading ftyp box, in its first 64 bytes."""
    if data[4:8] != b"ftyp":
        return set()
    end = min(int.from_bytes(data[:4], "big"), 64, len(data))
    return {data[8:12], *(data[i : i + 4] for i in range(16, end - 3, 4))}


def detect(data: bytes) -> str | None:
    """The first format, in order, whose signature the bytes have."""
    marks = brands(data)
    tests = {
        "png": data[:8] == b"\x89PNG\r\n\x1a\n",
        "jpeg": data[:3] == b"\xff\xd8\xff",
        "gif": data[:4] == b"GIF8",
        "tiff": data[:4] in (b"II*\0", b"MM\0*"),
        "webp": data[:4] == b"RIFF" and data[8:12] == b"WEBP",
        "heic": bool(marks & HEIC_BRANDS) and not marks & AVIF_BRANDS,
        "avif": bool(marks & AVIF_BRANDS),
        "bmp": data[:2] == b"BM",
        "qoi": data[:4] == b"qoif",
        "netpbm": data[:2] in (b"P5", b"P6"),
        "svg": b"<svg" in data[:1024],
    }
    return next((f for f in FORMATS if tests[f]), None)


@cache
def module(name: str):
    from . import bmp, gif, heic, jpeg, netpbm, png, qoi, svg, tiff, webp

    return {"bmp": bmp, "gif": gif, "heic": heic, "jpeg": jpeg, "netpbm": netpbm, "png": png, "qoi": qoi, "svg": svg, "tiff": tiff, "webp": webp}.get(name)


def decode(data: bytes, name: str | None = None, most: int = MOST_PIXELS) -> tuple[str, np.ndarray]:
    """Format and pixels; EXIF orientation is applied."""
    from .. import exif

    name = name or detect(data)
    if name is None:
        raise ImageError(UNKNOWN_FORMAT, "no signature matches")
    codec = module(name)
    if codec is None:
        raise unsupported(f"decoding {name}")
    if most < MOST_PIXELS:  # a lower bound than the formats' own is checked before pixels are made
        from . import info

        checked(*info.size_of(data, name), most)
    pixels = codec.decode(data)
    checked(pixels.shape[1], pixels.shape[0], most)
    return name, exif.oriented(pixels, exif.orientation_of(data))


def encode(pixels: np.ndarray, name: str, quality: int = 90, metadata: bytes | None = None) -> bytes:
    codec = module(name)
    if codec is None or not hasattr(codec, "encode"):
        raise unsupported(f"encoding {name}")
    return codec.encode(pixels, quality=quality, metadata=metadata)
