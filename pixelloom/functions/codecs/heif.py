"""HEIF containers: boxes, items, their properties, data and references. Pixels of HEVC and AV1 items aren't decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from ...errors import invalid, unsupported

DEPTH, ITEM_BYTES = 10, 2**28
#: Boxes that only hold others, with the bytes before the first of these.
HOLDERS = {b"meta": 4, b"iprp": 0, b"ipco": 0}


@dataclass
class Reader:
    data: bytes
    at: int
    end: int

    def take(self, n: int) -> int:
        if n < 0 or self.at + n > self.end:
            raise invalid("a box ends early")
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")

    def bytes(self, n: int) -> bytes:
        self.take(n)
        return self.data[self.at - n : self.at]


@dataclass
class Container:
    data: bytes
    primary: int | None = None
    types: dict[int, str] = field(default_factory=dict)
    #: Item to (construction method, base offset, [(offset, length)]).
    places: dict[int, tuple[int, int, list[tuple[int, int]]]] = field(default_factory=dict)
    properties: list[tuple[str, bytes]] = field(default_factory=list)
    associations: dict[int, list[int]] = field(default_factory=dict)
    references: list[tuple[str, int, list[int]]] = field(default_factory=list)
    held: bytes = b""

    def property(self, item: int, kind: str) -> bytes | None:
        """The first property of a kind that is associated with the item; an item without associations sees those of the whole file."""
        own = self.associations.get(item)
        found = self.properties if own is None else [self.properties[k - 1] for k in own if 1 <= k <= len(self.properties)]
        return next((body for name, body in found if name == kind), None)

    def linked(self, item: int, kind: str) -> list[int]:
        return [to for name, source, many in self.references if name == kind and source == item for to in many]

    def item(self, item: int) -> bytes | None:
        if item not in self.places:
            return None
        method, base, extents = self.places[item]
        if method not in (0, 1):
            raise unsupported(f"construction method {method}")
        source, out = self.data if method == 0 else self.held, bytearray()
        for offset, n in extents:
            start = base + offset
            n = len(source) - start if n == 0 and len(extents) == 1 else n
            if start > len(source) or n < 0 or start + n > len(source):
                raise invalid("item data outside of the file")
            if len(out) + n > ITEM_BYTES:
                raise invalid("item data is too long")
            out += source[start : start + n]
        return bytes(out)

    def alpha_of(self, item: int) -> int | None:
        """The lowest auxiliary item that is the alpha of the given one."""
        found = [source for name, source, to in self.references if name == "auxl" and item in to and b"alpha" in (self.property(source, "auxC") or b"")]
        return min(found, default=None)


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, first byte and byte after the body of each box."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = at + 8
        if size == 1:
            if body + 8 > end or data[body : body + 4] != b"\0\0\0\0":
                raise invalid("size of a box")
            size, body = int.from_bytes(data[body : body + 8], "big"), body + 8
        after = end if size == 0 else at + size
        if after < body or after > end:
            raise invalid("size of a box")
        yield kind, body, after
        at = after


def parse(data: bytes) -> Container:
    out = Container(data)
    walk(out, 0, len(data), False, 0)
    return out


def walk(out: Container, at: int, end: int, in_ipco: bool, depth: int) -> None:
    if depth > DEPTH:
        raise invalid("boxes are nested too deeply")
    for kind, body, after in boxes(out.data, at, end):
        r = Reader(out.data, body, after)
        if in_ipco:
            out.properties.append((kind.decode("latin-1"), out.data[body:after]))
        elif kind in HOLDERS:
            walk(out, body + HOLDERS[kind], after, kind == b"ipco", depth + 1)
        elif kind == b"pitm":
            out.primary = r.take(2 if r.take(4) >> 24 == 0 else 4)
        elif kind == b"iinf":
            r.take(2 if r.take(4) >> 24 == 0 else 4)
            walk(out, r.at, after, False, depth + 1)
        elif kind == b"infe":
            version = r.take(4) >> 24
            if version >= 2:
                item = r.take(2 if version == 2 else 4)
                r.take(2)
                out.types[item] = r.bytes(4).decode("latin-1")
        elif kind == b"iloc":
            locations(out, r)
        elif kind == b"iref":
            wide = 2 if r.take(4) >> 24 == 0 else 4
            for name, first, last in boxes(out.data, r.at, after):
                q = Reader(out.data, first, last)
                source = q.take(wide)
                out.references.append((name.decode("latin-1"), source, [q.take(wide) for _ in range(q.take(2))]))
        elif kind == b"ipma":
            flags = r.take(4)
            for _ in range(r.take(4)):
                item = r.take(2 if flags >> 24 == 0 else 4)
                index = (lambda: r.take(2) & 0x7FFF) if flags & 1 else (lambda: r.take(1) & 0x7F)
                out.associations.setdefault(item, []).extend([index() for _ in range(r.take(1))])
        elif kind == b"idat":
            out.held = out.data[body:after]


def locations(out: Container, r: Reader) -> None:
    version = r.take(4) >> 24
    sizes = r.take(2)
    offset, length, base, index = (sizes >> s & 15 for s in (12, 8, 4, 0))
    index = index if version in (1, 2) else 0
    if version > 2 or any(n not in (0, 4, 8) for n in (offset, length, base, index)):
        raise invalid("item locations")
    for _ in range(r.take(2 if version < 2 else 4)):
        item = r.take(2 if version < 2 else 4)
        method = r.take(2) & 15 if version else 0
        r.take(2)
        start, extents = r.take(base), []
        for _ in range(r.take(2)):
            r.take(index)
            extents.append((r.take(offset), r.take(length)))
        out.places[item] = (method, start, extents)


def whole(n: int, d: int) -> int:
    """Division that drops the fraction, of either sign."""
    return abs(n) // d * (1 if n >= 0 else -1)


def clean_aperture(width: int, height: int, body: bytes | None) -> tuple[int, int, int, int]:
    """x, y, width and height of what is shown: a centred part that is moved by fractions, inside the image."""
    if not body or len(body) < 32:
        return 0, 0, width, height
    wn, wd, hn, hd = struct.unpack(">4I", body[:16])
    xn, xd, yn, yd = struct.unpack(">iIiI", body[16:32])
    w, h = (n // d if d else 0 for n, d in ((wn, wd), (hn, hd)))
    if not (0 < w <= width and 0 < h <= height):
        return 0, 0, width, height
    place = lambda free, n, d: min(max(whole(free * max(d, 1) + 2 * n, 2 * max(d, 1)), 0), free)
    return place(width - w, xn, xd), place(height - h, yn, yd), w, h


def describe(data: bytes) -> dict:
    """What the primary item is: its type, shown size, quarter turns against the clock, mirror axis, grid, tiles and alpha item."""
    c = parse(data)
    if c.primary is None:
        raise invalid("no primary item")
    ispe = c.property(c.primary, "ispe") or b""
    width, height = struct.unpack(">II", ispe[4:12]) if len(ispe) >= 12 else (None, None)
    found = {"item_type": c.types.get(c.primary), "tiles": c.linked(c.primary, "dimg"), "alpha": c.alpha_of(c.primary), "columns": None, "rows": None}
    if found["item_type"] == "grid":
        body = c.item(c.primary) or b""
        if len(body) < 8:
            raise invalid("grid")
        found["rows"], found["columns"] = body[2] + 1, body[3] + 1
        width, height = struct.unpack(">II", body[4:12]) if body[1] & 1 else struct.unpack(">HH", body[4:8])
        if found["rows"] * found["columns"] != len(found["tiles"]):
            raise invalid("tiles of the grid")
    if width:
        _, _, width, height = clean_aperture(width, height, c.property(c.primary, "clap"))
    turns = (c.property(c.primary, "irot") or b"\0")[0] & 3
    mirror = c.property(c.primary, "imir")
    if turns % 2 and width:
        width, height = height, width
    return found | {"width": width, "height": height, "turns": turns, "mirror": mirror[0] & 1 if mirror else None}
