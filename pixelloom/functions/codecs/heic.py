"""HEIC: an HEVC picture, or a grid of them, out of a HEIF container, as RGB; alpha is 255. Turns and mirroring are those of the primary item."""

from __future__ import annotations

import numpy as np

from ...errors import invalid, unsupported
from . import checked, heif, hevc

#: Weights of red and blue in luma by matrix coefficients; others are as BT.601.
WEIGHTS = {1: (0.2126, 0.0722), 9: (0.2627, 0.0593), 10: (0.2627, 0.0593)}
BT601 = (0.299, 0.114)


def nal_units(c: heif.Container, item: int) -> list[bytes]:
    """Units of the item's configuration, then those of its data."""
    if c.types.get(item) != "hvc1":
        raise unsupported(f"HEIF item type {c.types.get(item)}")
    body, data = c.property(item, "hvcC"), c.item(item)
    if body is None or data is None:
        raise invalid("HEIC item without configuration or data")
    size, found = hevc.configuration(body)
    return found + hevc.units(data, size)


def shown(c: heif.Container, item: int, window: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """x, y, width and height of what is shown of the coded picture: the clean aperture inside the sequence's window."""
    left, top, width, height = window
    x, y, width, height = heif.clean_aperture(width, height, c.property(item, "clap"))
    return left + x, top + y, width, height


def colours(c: heif.Container, item: int) -> tuple[int, bool]:
    """Matrix coefficients and whether samples use the full range."""
    body = c.property(item, "colr") or b""
    if body[:4] != b"nclx" or len(body) < 11:
        return 6, False
    return int.from_bytes(body[8:10], "big"), bool(body[10] & 0x80)


def to_rgb(planes: list[np.ndarray], window: tuple[int, int, int, int], matrix: int, full: bool) -> np.ndarray:
    """Chroma lies on even luma columns and halfway between two luma rows; it is interpolated inside the window, in eighths, and mixed in 16-bit fractions."""
    left, top, width, height = window
    red, blue = WEIGHTS.get(matrix, BT601)
    green, unit = 1 - red - blue, 65536 * (1 if full else 255 / 224) / 8
    fixed = lambda v: int(np.floor(v + 0.5))
    rows, columns = np.arange(top, top + height), np.arange(left, left + width)
    low, high, right = top >> 1, (top + height - 1) >> 1, (left + width - 1) >> 1
    upper = np.clip((2 * rows - 1) >> 2, low, high)
    lower, share = np.minimum(upper + 1, high), np.clip(2 * rows - 1 - 4 * upper, 0, 4)[:, None]
    here = columns >> 1
    beside = np.where(columns & 1, np.minimum(here + 1, right), here)

    def chroma(plane: np.ndarray) -> np.ndarray:
        mixed = (4 - share) * plane[upper].astype(np.int64) + share * plane[lower]
        return mixed[:, here] + mixed[:, beside] - 1024

    cb, cr = chroma(planes[1]), chroma(planes[2])
    luma = planes[0][top : top + height, left : left + width].astype(np.float64)
    luma = (luma if full else (luma - 16) * 255 / 219) * 65536
    luma = (np.sign(luma) * np.floor(np.abs(luma) + 0.5)).astype(np.int64)
    out = np.full((height, width, 4), 255, np.uint8)
    channels = (
        luma + fixed(2 * (1 - red) * unit) * cr,
        luma - fixed(2 * (1 - blue) * blue / green * unit) * cb - fixed(2 * (1 - red) * red / green * unit) * cr,
        luma + fixed(2 * (1 - blue) * unit) * cb,
    )
    for k, value in enumerate(channels):
        out[..., k] = np.clip((value + 32768) >> 16, 0, 255)
    return out


def picture(c: heif.Container, item: int) -> np.ndarray:
    s, planes = hevc.decode(nal_units(c, item))
    return to_rgb(planes, shown(c, item, s.window), *colours(c, item))


def grid(c: heif.Container, item: int) -> np.ndarray:
    body, tiles = c.item(item) or b"", c.linked(item, "dimg")
    wide = 4 if len(body) > 1 and body[1] & 1 else 2
    if len(body) < 4 + 2 * wide:
        raise invalid("grid")
    rows, columns = body[2] + 1, body[3] + 1
    width, height = (int.from_bytes(body[4 + k * wide : 4 + (k + 1) * wide], "big") for k in (0, 1))
    checked(width, height)
    if len(tiles) != rows * columns:
        raise invalid("tiles of the grid")
    out = None
    for k, tile in enumerate(tiles):
        made = picture(c, tile)
        h, w = made.shape[:2]
        if out is None:
            if rows * h < height or columns * w < width:
                raise invalid("tiles don't cover the grid")
            out, size = np.zeros((height, width, 4), np.uint8), (h, w)
        if (h, w) != size:
            raise invalid("tiles differ in size")
        y, x = k // columns * h, k % columns * w
        if y < height and x < width:
            out[y : y + h, x : x + w] = made[: height - y, : width - x]
    return out


def oriented(pixels: np.ndarray, turns: int, mirror: int | None) -> np.ndarray:
    """Quarter turns against the clock, then the mirror: 0 swaps left and right, 1 top and bottom."""
    pixels = np.rot90(pixels, turns)
    return pixels if mirror is None else pixels[::-1] if mirror else pixels[:, ::-1]


def decode(data: bytes) -> np.ndarray:
    c = heif.parse(data)
    if c.primary is None:
        raise invalid("no primary item")
    made = grid(c, c.primary) if c.types.get(c.primary) == "grid" else picture(c, c.primary)
    turns, mirror = (c.property(c.primary, "irot") or b"\0")[0] & 3, c.property(c.primary, "imir")
    return np.ascontiguousarray(oriented(made, turns, mirror[0] & 1 if mirror else None))


def size_of(data: bytes) -> tuple[int, int]:
    """Width and height of the coded picture or grid, from headers alone."""
    c = heif.parse(data)
    if c.primary is None:
        raise invalid("no primary item")
    if c.types.get(c.primary) == "grid":
        body = c.item(c.primary) or b""
        wide = 4 if len(body) > 1 and body[1] & 1 else 2
        return tuple(int.from_bytes(body[4 + k * wide : 4 + (k + 1) * wide], "big") for k in (0, 1))
    return hevc.headers(nal_units(c, c.primary))[0].window[2:]
