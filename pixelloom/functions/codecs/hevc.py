"""HEVC still pictures, 8 bits, 4:2:0: parameter sets, slice headers, entropy decoding and the walk over coding units.

Samples are made by `hevc_samples` while the walk goes on. Not read, `unsupportedFeature`: other depths and chroma formats, tiles, PCM units, dependent and inter slices, reference
picture sets in the sequence, extensions.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

from ...errors import invalid, unsupported
from . import checked
from . import hevc_samples as samples

SPS, PPS = 33, 34
#: Kinds of units that hold intra pictures, and those of them that carry no picture order.
INTRA_UNITS, IDR_UNITS = range(16, 22), (19, 20)

#: Initial context values of intra slices, by syntax element.
CONTEXTS = {
    "sao_merge": [153],
    "sao_type": [200],
    "split_cu": [139, 141, 157],
    "bypass_cu": [154],
    "part_mode": [184],
    "prev_mode": [184],
    "chroma_mode": [63],
    "split_transform": [153, 138, 138],
    "cbf_luma": [111, 141],
    "cbf_chroma": [94, 138, 182, 154],
    "qp_delta": [154, 154],
    "transform_skip": [139, 139],
    "last_x": [110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63],
    "last_y": [110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63],
    "coded_group": [91, 171, 134, 141],
    "significant": [
        111, 111, 125, 110, 110, 94, 124, 108, 124, 107, 125, 141, 179, 153, 125, 107, 125, 141, 179, 153, 125,
        107, 125, 141, 179, 153, 125, 140, 139, 182, 182, 152, 136, 152, 136, 153, 136, 139, 111, 136, 139, 111,
    ],
    "greater1": [140, 92, 137, 138, 140, 152, 138, 139, 153, 74, 149, 92, 139, 107, 122, 152, 140, 179, 166, 182, 140, 227, 122, 197],
    "greater2": [138, 153, 136, 167, 152, 152],
}
AT = {}
for _name, _values in CONTEXTS.items():
    AT[_name] = sum(len(CONTEXTS[n]) for n in AT)

#: Range of the less probable symbol, by state and by quarter of the range.
LPS = [
    (128, 176, 208, 240), (128, 167, 197, 227), (128, 158, 187, 216), (123, 150, 178, 205), (116, 142, 169, 195), (111, 135, 160, 185), (105, 128, 152, 175), (100, 122, 144, 166),
    (95, 116, 137, 158), (90, 110, 130, 150), (85, 104, 123, 142), (81, 99, 117, 135), (77, 94, 111, 128), (73, 89, 105, 122), (69, 85, 100, 116), (66, 80, 95, 110),
    (62, 76, 90, 104), (59, 72, 86, 99), (56, 69, 81, 94), (53, 65, 77, 89), (51, 62, 73, 85), (48, 59, 69, 80), (46, 56, 66, 76), (43, 53, 63, 72),
    (41, 50, 59, 69), (39, 48, 56, 65), (37, 45, 54, 62), (35, 43, 51, 59), (33, 41, 48, 56), (32, 39, 46, 53), (30, 37, 43, 50), (29, 35, 41, 48),
    (27, 33, 39, 45), (26, 31, 37, 43), (24, 30, 35, 41), (23, 28, 33, 39), (22, 27, 32, 37), (21, 26, 30, 35), (20, 24, 29, 33), (19, 23, 27, 31),
    (18, 22, 26, 30), (17, 21, 25, 28), (16, 20, 23, 27), (15, 19, 22, 25), (14, 18, 21, 24), (14, 17, 20, 23), (13, 16, 19, 22), (12, 15, 18, 21),
    (12, 14, 17, 20), (11, 14, 16, 19), (11, 13, 15, 18), (10, 12, 15, 17), (10, 12, 14, 16), (9, 11, 13, 15), (9, 11, 12, 14), (8, 10, 12, 14),
    (8, 9, 11, 13), (7, 9, 11, 12), (7, 9, 10, 12), (7, 8, 10, 11), (6, 8, 9, 11), (6, 7, 9, 10), (6, 7, 8, 9), (2, 2, 2, 2),
]
#: The state after the less probable symbol.
AFTER_LPS = [
    0, 0, 1, 2, 2, 4, 4, 5, 6, 7, 8, 9, 9, 11, 11, 12, 13, 13, 15, 15, 16, 16, 18, 18, 19, 19, 21, 21, 22, 22, 23, 24,
    24, 25, 26, 26, 27, 27, 28, 29, 29, 30, 30, 30, 31, 32, 32, 33, 33, 33, 34, 34, 35, 35, 35, 36, 36, 36, 37, 37, 37, 38, 38, 63,
]
#: Context of a coefficient of a 4x4 block, by place.
SMALL = [0, 1, 4, 5, 2, 3, 4, 5, 6, 6, 8, 8, 7, 7, 8, 8]
#: Default 8x8 scaling factors of intra blocks, in diagonal order.
DEFAULT_FACTORS = [
    16, 16, 16, 16, 16, 16, 16, 16, 16, 16, 17, 16, 17, 16, 17, 18, 17, 18, 18, 17, 18, 21, 19, 20, 21, 20, 19, 21, 24, 22, 22, 24,
    24, 22, 22, 24, 25, 25, 27, 30, 27, 25, 25, 29, 31, 35, 35, 31, 29, 36, 41, 44, 41, 36, 47, 54, 54, 47, 65, 70, 65, 88, 88, 115,
]


def diagonal(size: int) -> list[tuple[int, int]]:
    return [(d - y, y) for d in range(2 * size - 1) for y in range(d, -1, -1) if y < size and d - y < size]


#: x and y by scan (diagonal, by rows, by columns) and base-two logarithm of the size.
SCANS = [
    [diagonal(1 << k) for k in range(4)],
    [[(x, y) for y in range(1 << k) for x in range(1 << k)] for k in range(4)],
    [[(x, y) for x in range(1 << k) for y in range(1 << k)] for k in range(4)],
]


class Bits:
    """Reads a unit's bits, escapes removed, most significant first."""

    def __init__(self, data: bytes):
        self.value, self.length, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def u(self, n: int) -> int:
        self.at += n
        if self.at > self.length:
            raise invalid("a unit ends early")
        return self.value >> (self.length - self.at) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 31:
                raise invalid("a number of a unit is too long")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        n = self.ue()
        return (n + 1) // 2 if n % 2 else -(n // 2)


def units(data: bytes, length_size: int) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + length_size], "big")
        at += length_size
        if n < 2 or at + n > len(data):
            raise invalid("length of a unit")
        out.append(data[at : at + n])
        at += n
    return out


def configuration(body: bytes) -> tuple[int, list[bytes]]:
    """Bytes of a length, and the units of a decoder configuration."""
    if len(body) < 23:
        raise invalid("decoder configuration")
    at, found = 23, []
    for _ in range(body[22]):
        many = int.from_bytes(body[at + 1 : at + 3], "big")
        at += 3
        for _ in range(many):
            n = int.from_bytes(body[at : at + 2], "big")
            if n < 2 or at + 2 + n > len(body):
                raise invalid("decoder configuration")
            found.append(body[at + 2 : at + 2 + n])
            at += 2 + n
    return (body[21] & 3) + 1, found


def kind_of(unit: bytes) -> int:
    return unit[0] >> 1 & 63


def unescaped(unit: bytes) -> bytes:
    return unit.replace(b"\0\0\3", b"\0\0")


def scaling_factors(r: Bits | None) -> dict[tuple[int, int], np.ndarray]:
    """Factors by logarithm of the size and component, the defaults without a reader. Those of inter blocks are read and not kept."""
    lists = {(s, m): ([16] * 16 if s == 0 else DEFAULT_FACTORS, 16) for s in range(4) for m in range(6)}
    if r is not None:
        for s in range(4):
            for m in range(0, 6, 3 if s == 3 else 1):
                if not r.u(1):
                    back = r.ue() * (3 if s == 3 else 1)
                    if back > m:
                        raise invalid("scaling list")
                    if back:
                        lists[s, m] = lists[s, m - back]
                    continue
                last = dc = 8 + r.se() if s > 1 else 8
                found = []
                for _ in range(16 if s == 0 else 64):
                    last = (last + r.se()) % 256
                    found.append(last)
                lists[s, m] = (found, dc if s > 1 else 16)
    out = {}
    for s in range(4):
        for m in range(3):
            found, dc = lists[s, m]
            base = 4 if s == 0 else 8
            square = np.zeros((base, base), np.int64)
            for (x, y), v in zip(SCANS[0][2 if s == 0 else 3], found):
                square[y, x] = v
            if s > 1:
                square = square.repeat(1 << s - 1, 0).repeat(1 << s - 1, 1)
                square[0, 0] = dc
            out[s + 2, m] = square
    return out


def sequence(unit: bytes) -> SimpleNamespace:
    r, s = Bits(unescaped(unit)[2:]), SimpleNamespace()
    r.u(4)
    layers = r.u(3)
    r.u(1 + 96)
    present = [(r.u(1), r.u(1)) for _ in range(layers)]
    if layers:
        r.u(2 * (8 - layers))
    for profile, level in present:
        r.u(88 * profile + 8 * level)
    r.ue()
    if r.ue() != 1:
        raise unsupported("HEVC chroma format")
    s.width, s.height = r.ue(), r.ue()
    checked(s.width, s.height)
    left, right, top, bottom = (2 * r.ue() for _ in range(4)) if r.u(1) else (0, 0, 0, 0)
    if left + right >= s.width or top + bottom >= s.height:
        raise invalid("conformance window")
    s.window = (left, top, s.width - left - right, s.height - top - bottom)
    if (r.ue(), r.ue()) != (0, 0):
        raise unsupported("HEVC bit depth")
    s.order_bits = 4 + r.ue()
    for _ in range(layers + 1 if r.u(1) else 1):
        r.ue(), r.ue(), r.ue()
    s.min_cb = 3 + r.ue()
    s.ctb = s.min_cb + r.ue()
    s.min_tb = 2 + r.ue()
    s.max_tb = s.min_tb + r.ue()
    r.ue()
    s.depth = r.ue()
    if not (4 <= s.ctb <= 6 and s.min_tb < s.min_cb and s.max_tb <= min(s.ctb, 5) and s.depth <= 4) or s.width % (1 << s.min_cb) or s.height % (1 << s.min_cb):
        raise invalid("block sizes")
    s.factors = None
    if r.u(1):
        s.factors = scaling_factors(r if r.u(1) else None)
    r.u(1)
    s.sao, s.pcm = r.u(1), None
    if r.u(1):
        r.u(8)
        smallest = 3 + r.ue()
        s.pcm = (smallest, smallest + r.ue())
        r.u(1)
    if r.ue():
        raise unsupported("HEVC reference picture sets")
    s.long_term = r.u(1)
    if s.long_term:
        r.u(r.ue() * (s.order_bits + 1))
    s.temporal, s.strong = r.u(1), r.u(1)
    return s


def picture_set(unit: bytes) -> SimpleNamespace:
    r, p = Bits(unescaped(unit)[2:]), SimpleNamespace()
    r.ue(), r.ue()
    p.dependent, p.output_flag, p.extra = r.u(1), r.u(1), r.u(3)
    p.sign_hiding = r.u(1)
    r.u(1), r.ue(), r.ue()
    p.qp = 26 + r.se()
    r.u(1)
    p.transform_skip, p.qp_delta = r.u(1), r.u(1)
    p.qp_depth = r.ue() if p.qp_delta else 0
    p.chroma_qp = (r.se(), r.se())
    p.slice_chroma = r.u(1)
    r.u(2)
    p.bypass, tiles, p.wavefront = r.u(1), r.u(1), r.u(1)
    if tiles:
        raise unsupported("HEVC tiles")
    p.across = r.u(1)
    p.override, p.no_deblock, p.beta, p.tc = 0, 0, 0, 0
    if r.u(1):
        p.override, p.no_deblock = r.u(1), r.u(1)
        if not p.no_deblock:
            p.beta, p.tc = 2 * r.se(), 2 * r.se()
    p.factors = scaling_factors(r) if r.u(1) else None
    r.u(1), r.ue()
    p.header_extension = r.u(1)
    if r.u(1) and r.u(8) >> 7:
        raise unsupported("HEVC range extension")
    if any(abs(n) > 12 for n in (*p.chroma_qp, p.beta, p.tc)) or not 0 <= p.qp <= 51:
        raise invalid("picture parameters")
    return p


def slice_header(unit: bytes, s: SimpleNamespace, p: SimpleNamespace) -> SimpleNamespace:
    data = unescaped(unit)
    r, h, kind = Bits(data[2:]), SimpleNamespace(), kind_of(unit)
    columns, rows = -(-s.width // (1 << s.ctb)), -(-s.height // (1 << s.ctb))
    first = r.u(1)
    r.u(1), r.ue()
    if not first and p.dependent and r.u(1):
        raise unsupported("HEVC dependent slices")
    h.start = 0 if first else r.u((columns * rows - 1).bit_length())
    if h.start >= columns * rows:
        raise invalid("address of a slice")
    r.u(p.extra)
    if r.ue() != 2:
        raise unsupported("HEVC inter slices")
    if p.output_flag:
        r.u(1)
    if kind not in IDR_UNITS:
        r.u(s.order_bits)
        if r.u(1):
            raise invalid("reference picture set")
        for _ in range(r.ue() + r.ue()):
            r.ue(), r.u(1)
        if s.long_term:
            raise unsupported("HEVC long-term references")
        if s.temporal:
            r.u(1)
    h.sao = (r.u(1), r.u(1)) if s.sao else (0, 0)
    h.qp = p.qp + r.se()
    h.chroma_qp = p.chroma_qp
    if p.slice_chroma:
        h.chroma_qp = tuple(n + r.se() for n in p.chroma_qp)
    h.no_deblock, h.beta, h.tc, h.across = p.no_deblock, p.beta, p.tc, p.across
    if p.override and r.u(1):
        h.no_deblock = r.u(1)
        if not h.no_deblock:
            h.beta, h.tc = 2 * r.se(), 2 * r.se()
    if p.across and (any(h.sao) or not h.no_deblock):
        h.across = r.u(1)
    if not 0 <= h.qp <= 51 or any(abs(n) > 12 for n in (*h.chroma_qp, h.beta, h.tc)):
        raise invalid("slice header")
    if p.wavefront:
        many = r.ue()
        if many > 65536:
            raise invalid("entry points")
        if many:
            size = r.ue() + 1
            for _ in range(many):
                r.u(size)
    if p.header_extension:
        r.u(8 * r.ue())
    if not r.u(1):
        raise invalid("end of a slice header")
    h.data = data[2 + -(-r.at // 8) :]
    return h


class Arithmetic:
    """The arithmetic decoder. `value` holds nine bits of the standard's offset and seven more; `short` counts from -8 to the next byte."""

    def __init__(self, data: bytes):
        self.data, self.at, self.states = data, 0, []

    def start(self) -> None:
        self.range, self.short, self.value = 510, -8, self.byte() << 8 | self.byte()

    def byte(self) -> int:
        at, self.at = self.at, self.at + 1
        if at < len(self.data):
            return self.data[at]
        if at > len(self.data) + 2:
            raise invalid("slice data end early")
        return 0

    def bin(self, k: int) -> int:
        state = self.states[k]
        low = LPS[state >> 1][self.range >> 6 & 3]
        self.range -= low
        edge = self.range << 7
        if self.value < edge:
            if state < 124:
                self.states[k] = state + 2
            if edge < 256 << 7:
                self.range, self.value = edge >> 6, self.value << 1
                self.short += 1
                if self.short == 0:
                    self.short, self.value = -8, self.value | self.byte()
            return state & 1
        n = 9 - low.bit_length()
        self.value, self.range = (self.value - edge) << n, low << n
        self.short += n
        if self.short >= 0:
            self.value |= self.byte() << self.short
            self.short -= 8
        self.states[k] = AFTER_LPS[state >> 1] << 1 | (state & 1 if state > 1 else 1 - state)
        return 1 - (state & 1)

    def bypass(self) -> int:
        self.value <<= 1
        self.short += 1
        if self.short == 0:
            self.short, self.value = -8, self.value | self.byte()
        edge = self.range << 7
        if self.value < edge:
            return 0
        self.value -= edge
        return 1

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bypass()
        return out

    def terminate(self) -> int:
        """After a one the next byte not yet read begins what follows."""
        self.range -= 2
        edge = self.range << 7
        if self.value >= edge:
            return 1
        if edge < 256 << 7:
            self.range, self.value = edge >> 6, self.value << 1
            self.short += 1
            if self.short == 0:
                self.short, self.value = -8, self.value | self.byte()
        return 0


def initial_states(qp: int) -> list[int]:
    out = []
    for values in CONTEXTS.values():
        for v in values:
            first = min(max(((v >> 4) * 5 - 45) * qp // 16 + ((v & 15) << 3) - 16, 1), 126)
            out.append((first - 64) << 1 | 1 if first > 63 else (63 - first) << 1)
    return out


class Picture:
    """A picture in the making: planes, and for each 4x4 luma samples the slice (from 1, 0 before it is made), depth, mode, QP, bypass and transform edges."""

    def __init__(self, s: SimpleNamespace, p: SimpleNamespace):
        self.s, self.p, self.slices = s, p, []
        self.columns, self.rows = -(-s.width // (1 << s.ctb)), -(-s.height // (1 << s.ctb))
        self.planes = [np.zeros((s.height >> k, s.width >> k), np.int32) for k in (0, 1, 1)]
        grid = (s.height // 4, s.width // 4)
        self.owner, self.depth, self.mode, self.qp, self.bypass, self.left_edge, self.top_edge = (np.zeros(grid, np.int32) for _ in range(7))
        self.sao = {}
        self.factors = (p.factors or s.factors) if s.factors else None

    def decode(self, h: SimpleNamespace, engine=None) -> None:
        """All blocks of a slice; another engine may stand for the arithmetic decoder."""
        self.slices.append(h)
        self.h, self.me, self.c = h, len(self.slices), engine or Arithmetic(h.data)
        c, saved, here, total = self.c, None, h.start, self.columns * self.rows
        c.states = initial_states(h.qp)
        c.start()
        self.last_qp = h.qp
        while True:
            cx, cy = here % self.columns, here // self.columns
            if (cx, cy) in self.sao:
                raise invalid("slices overlap")
            if self.p.wavefront and cx == 0 and here != h.start:
                c.start()
                self.last_qp = h.qp
                above = here - self.columns + 1
                c.states = list(saved) if saved and self.columns > 1 and above >= h.start else initial_states(h.qp)
            self.sao[cx, cy] = self.read_sao(cx, cy, here)
            self.quadtree(cx << self.s.ctb, cy << self.s.ctb, self.s.ctb, 0)
            if self.p.wavefront and cx == 1:
                saved = list(c.states)
            here += 1
            if c.terminate():
                break
            if here == total:
                raise invalid("a slice is too long")
            if self.p.wavefront and here % self.columns == 0 and not c.terminate():
                raise invalid("end of a row")

    def read_sao(self, cx: int, cy: int, here: int) -> list[tuple]:
        """By component: kind (0 none, 1 bands, 2 edges), band or direction, four offsets."""
        c, none = self.c, (0, 0, (0, 0, 0, 0))
        if not any(self.h.sao):
            return [none] * 3
        if cx and here > self.h.start and c.bin(AT["sao_merge"]):
            return self.sao[cx - 1, cy]
        if cy and here - self.columns >= self.h.start and c.bin(AT["sao_merge"]):
            return self.sao[cx, cy - 1]
        out, kind, way = [], 0, 0
        for k in range(3):
            if not self.h.sao[min(k, 1)]:
                out.append(none)
                continue
            if k < 2:
                kind = (1 + c.bypass()) if c.bin(AT["sao_type"]) else 0
            if not kind:
                out.append(none)
                continue
            offsets = []
            for _ in range(4):
                n = 0
                while n < 7 and c.bypass():
                    n += 1
                offsets.append(n)
            if kind == 1:
                offsets = [-n if n and c.bypass() else n for n in offsets]
                place = c.bits(5)
            else:
                if k < 2:
                    way = c.bits(2)
                place, offsets = way, [offsets[0], offsets[1], -offsets[2], -offsets[3]]
            out.append((kind, place, tuple(offsets)))
        return out

    def mine(self, x: int, y: int) -> bool:
        """Is the luma place made, by this slice?"""
        return 0 <= x < self.s.width and 0 <= y < self.s.height and self.owner[y >> 2, x >> 2] == self.me

    def quadtree(self, x: int, y: int, log2: int, depth: int) -> None:
        s, size = self.s, 1 << log2
        if x + size <= s.width and y + size <= s.height and log2 > s.min_cb:
            deeper = sum(self.mine(a, b) and self.depth[b >> 2, a >> 2] > depth for a, b in ((x - 1, y), (x, y - 1)))
            split = self.c.bin(AT["split_cu"] + int(deeper))
        else:
            split = log2 > s.min_cb
        if log2 >= s.ctb - self.p.qp_depth:
            self.group(x, y)
        if not split:
            self.coding_unit(x, y, log2, depth)
            return
        half = size >> 1
        for b, a in ((0, 0), (0, half), (half, 0), (half, half)):
            if x + a < s.width and y + b < s.height:
                self.quadtree(x + a, y + b, log2 - 1, depth + 1)

    def group(self, x: int, y: int) -> None:
        """A quantization group begins: its predicted QP comes from left and above in the same tree block, else from the unit before."""
        inside = (1 << self.s.ctb) - 1
        a = int(self.qp[y >> 2, (x - 1) >> 2]) if x & inside else self.last_qp
        b = int(self.qp[(y - 1) >> 2, x >> 2]) if y & inside else self.last_qp
        self.predicted, self.delta, self.delta_read = (a + b + 1) >> 1, 0, False

    def unit_qp(self) -> int:
        return (self.predicted + self.delta + 52) % 52

    def coding_unit(self, x: int, y: int, log2: int, depth: int) -> None:
        c, s, size = self.c, self.s, 1 << log2
        self.lossless = self.p.bypass and c.bin(AT["bypass_cu"])
        parts = 1 if log2 > s.min_cb or c.bin(AT["part_mode"]) else 4
        if parts == 1 and s.pcm and s.pcm[0] <= log2 <= s.pcm[1] and c.terminate():
            raise unsupported("HEVC PCM units")
        block = np.s_[y >> 2 : (y + size) >> 2, x >> 2 : (x + size) >> 2]
        self.depth[block], self.bypass[block] = depth, self.lossless
        n = size if parts == 1 else size >> 1
        places = [(x + (k & 1) * n, y + (k >> 1) * n) for k in range(parts)]
        given = [c.bin(AT["prev_mode"]) for _ in places]
        made = {}  # modes of this unit's parts, whose samples aren't made yet
        for (a, b), likely in zip(places, given):
            self.luma_mode(a, b, n, likely, made)
        wanted = c.bits(2) if c.bin(AT["chroma_mode"]) else 4
        first = int(self.mode[y >> 2, x >> 2])
        chroma = first if wanted == 4 else (0, 26, 10, 1)[wanted]
        self.chroma_mode = 34 if wanted != 4 and chroma == first else chroma
        self.transform_tree(x, y, x, y, log2, 0, 0, parts == 4, True, True)
        self.qp[block] = self.last_qp = self.unit_qp()

    def luma_mode(self, x: int, y: int, n: int, likely: int, made: dict) -> None:
        c, near = self.c, []
        for a, b in ((x - 1, y), (x, y - 1)):
            same_row = a < x or b >= y >> self.s.ctb << self.s.ctb
            known = (a >> 2, b >> 2) in made or self.mine(a, b)
            near.append(int(self.mode[b >> 2, a >> 2]) if known and same_row else 1)
        a, b = near
        if a != b:
            third = 0 if 0 not in near else 1 if 1 not in near else 26
            candidates = [a, b, third]
        elif a < 2:
            candidates = [0, 1, 26]
        else:
            candidates = [a, 2 + (a + 29) % 32, 2 + (a - 1) % 32]
        if likely:
            mode = candidates[1 + c.bypass() if c.bypass() else 0]
        else:
            mode = c.bits(5)
            for other in sorted(candidates):
                mode += mode >= other
        self.mode[y >> 2 : (y + n) >> 2, x >> 2 : (x + n) >> 2] = mode
        made.update({((x >> 2) + i, (y >> 2) + j): mode for j in range(n >> 2) for i in range(n >> 2)})

    def transform_tree(self, x, y, base_x, base_y, log2, depth, k, parted, cb, cr) -> None:
        c, s = self.c, self.s
        if s.min_tb < log2 <= s.max_tb and depth < s.depth + parted and not (parted and depth == 0):
            split = c.bin(AT["split_transform"] + 5 - log2)
        else:
            split = log2 > s.max_tb or (parted and depth == 0)
        if log2 > 2:
            cb = cb and c.bin(AT["cbf_chroma"] + depth)
            cr = cr and c.bin(AT["cbf_chroma"] + depth)
        if split:
            half = 1 << (log2 - 1)
            for i in range(4):
                self.transform_tree(x + (i & 1) * half, y + (i >> 1) * half, x, y, log2 - 1, depth + 1, i, parted, cb, cr)
            return
        luma = c.bin(AT["cbf_luma"] + (depth == 0))
        if (luma or cb or cr) and self.p.qp_delta and not self.delta_read:
            self.read_delta()
        size = 1 << log2
        area = np.s_[y >> 2 : (y + size) >> 2, x >> 2 : (x + size) >> 2]
        self.left_edge[area][:, 0] = 1
        self.top_edge[area][0] = 1
        self.block(x, y, log2, 0, int(self.mode[y >> 2, x >> 2]), luma)
        self.owner[area] = self.me
        if log2 > 2:
            for component, coded in ((1, cb), (2, cr)):
                self.block(x >> 1, y >> 1, log2 - 1, component, self.chroma_mode, coded)
        elif k == 3:
            for component, coded in ((1, cb), (2, cr)):
                self.block(base_x >> 1, base_y >> 1, 2, component, self.chroma_mode, coded)

    def read_delta(self) -> None:
        c, n = self.c, 0
        while n < 5 and c.bin(AT["qp_delta"] + (n > 0)):
            n += 1
        if n == 5:
            k = 0
            while c.bypass():
                n += 1 << k
                k += 1
                if k > 16:
                    raise invalid("QP difference")
            n += c.bits(k)
        self.delta, self.delta_read = -n if n and c.bypass() else n, True
        if not -26 <= self.delta <= 25:
            raise invalid("QP difference")

    def block(self, x: int, y: int, log2: int, component: int, mode: int, coded: int) -> None:
        """Predicts a block and adds its residual; x and y in samples of the component."""
        n, plane = 1 << log2, self.planes[component]
        line = samples.border(plane, self.owner, self.me, x, y, n, component)
        made = samples.predict(line, n, mode, component == 0, self.s.strong)
        if coded:
            levels, skipped = self.residual(log2, component, mode)
            if self.lossless:
                made = made + levels
            else:
                qp = self.unit_qp() if component == 0 else samples.chroma_qp(min(max(self.unit_qp() + self.h.chroma_qp[component - 1], 0), 57))
                factors = self.factors[log2, component] if self.factors else 16
                made = made + samples.residual(levels, qp, factors, log2, skipped, component == 0 and log2 == 2)
            made = np.clip(made, 0, 255)
        plane[y : y + n, x : x + n] = made

    def last_place(self, name: str, log2: int, component: int) -> int:
        at, shift = (3 * (log2 - 2) + (log2 - 1 >> 2), log2 + 1 >> 2) if component == 0 else (15, log2 - 2)
        n = 0
        while n < 2 * log2 - 1 and self.c.bin(AT[name] + at + (n >> shift)):
            n += 1
        return n

    def suffixed(self, prefix: int) -> int:
        if prefix < 4:
            return prefix
        n = (prefix >> 1) - 1
        return ((2 + (prefix & 1)) << n) + self.c.bits(n)

    def remaining(self, rice: int) -> int:
        c, n = self.c, 0
        while c.bypass():
            n += 1
            if n > 32:
                raise invalid("coefficient")
        if n < 4:
            return (n << rice) + c.bits(rice)
        return ((1 << n - 3) + 2 << rice) + c.bits(n - 3 + rice)

    def residual(self, log2: int, component: int, mode: int) -> tuple[np.ndarray, int]:
        """Levels of a block, and whether it skips the transform."""
        c, chroma = self.c, component > 0
        skipped = 0
        if log2 == 2 and self.p.transform_skip and not self.lossless:
            skipped = c.bin(AT["transform_skip"] + chroma)
        px, py = self.last_place("last_x", log2, component), self.last_place("last_y", log2, component)
        last_x, last_y = self.suffixed(px), self.suffixed(py)
        scan = 0
        if log2 == 2 or (log2 == 3 and not chroma):
            scan = 2 if 6 <= mode <= 14 else 1 if 22 <= mode <= 30 else 0
        if scan == 2:
            last_x, last_y = last_y, last_x
        groups, inner = SCANS[scan][log2 - 2], SCANS[scan][2]
        if last_x >> log2 or last_y >> log2:
            raise invalid("last coefficient")
        final = groups.index((last_x >> 2, last_y >> 2))
        levels, flags, slope = np.zeros((1 << log2, 1 << log2), np.int64), {}, 1
        for g in range(final, -1, -1):
            gx, gy = groups[g]
            right, below = flags.get((gx + 1, gy), 0), flags.get((gx, gy + 1), 0)
            infer = False
            if 0 < g < final:
                flags[gx, gy] = c.bin(AT["coded_group"] + (right | below) + 2 * chroma)
                if not flags[gx, gy]:
                    continue
                infer = True
            else:
                flags[gx, gy] = 1
            found = []
            top = 15
            if g == final:
                top = inner.index((last_x & 3, last_y & 3))
                found.append(top)
                top -= 1
            for n in range(top, -1, -1):
                if n == 0 and infer:
                    found.append(0)
                elif c.bin(AT["significant"] + self.significance(inner[n], gx, gy, log2, chroma, scan, right + 2 * below)):
                    found.append(n)
                    infer = False
            if found:
                slope = self.levels_of(levels, found, inner, gx, gy, g, chroma, slope, g == final)
        return levels, skipped

    @staticmethod
    def significance(place: tuple[int, int], gx: int, gy: int, log2: int, chroma: bool, scan: int, around: int) -> int:
        x, y = place
        if log2 == 2:
            k = SMALL[4 * y + x]
        elif not (x or y or gx or gy):
            k = 0
        else:
            if around == 0:
                k = 2 if x + y == 0 else 1 if x + y < 3 else 0
            elif around == 3:
                k = 2
            else:
                k = max(2 - (y if around == 1 else x), 0)
            if chroma:
                k += 9 if log2 == 3 else 12
            else:
                k += (3 if gx or gy else 0) + ((9 if scan == 0 else 15) if log2 == 3 else 21)
        return k + 27 * chroma

    def levels_of(self, levels, found, inner, gx, gy, g, chroma, slope, first_group) -> int:
        """Levels of a group's places, last first; returns the state that the next group's contexts start from."""
        c = self.c
        family = 0 if g == 0 or chroma else 2
        if not first_group and slope == 0:
            family += 1
        slope, sizes, second = 1, [], None
        for i in range(min(len(found), 8)):
            more = c.bin(AT["greater1"] + 4 * family + slope + 16 * chroma)
            sizes.append(1 + more)
            if more:
                slope = 0
                second = i if second is None else second
            elif 0 < slope < 3:
                slope += 1
        if second is not None:
            sizes[second] += c.bin(AT["greater2"] + family + 4 * chroma)
        hidden = self.p.sign_hiding and not self.lossless and found[0] - found[-1] > 3
        signs = [c.bypass() for _ in range(len(found) - bool(hidden))] + [0] * bool(hidden)
        rice = total = 0
        for i, n in enumerate(found):
            base = sizes[i] if i < 8 else 1
            if base == ((3 if i == second else 2) if i < 8 else 1):
                base += self.remaining(rice)
                if base > 3 << rice:
                    rice = min(rice + 1, 4)
            total += base
            x, y = inner[n]
            levels[4 * gy + y, 4 * gx + x] = max(min(-base if signs[i] else base, 32767), -32768)
        if hidden and total & 1:
            x, y = inner[found[-1]]
            levels[4 * gy + y, 4 * gx + x] *= -1
        return slope

    def finished(self) -> list[np.ndarray]:
        """Planes after the loop filters; every tree block must have been read."""
        if len(self.sao) != self.columns * self.rows:
            raise invalid("slices are missing")
        samples.deblock(self)
        samples.offset(self)
        return [p.astype(np.uint8) for p in self.planes]


def decode(nal_units: list[bytes]) -> tuple[SimpleNamespace, list[np.ndarray]]:
    """Sequence parameters and planes of the intra picture."""
    s, p, slices = headers(nal_units)
    picture = Picture(s, p)
    for unit in slices:
        picture.decode(slice_header(unit, s, p))
    return s, picture.finished()


def headers(nal_units: list[bytes]) -> tuple[SimpleNamespace, SimpleNamespace, list[bytes]]:
    """Both parameter sets and the units of the picture, which isn't decoded."""
    first = {kind: next((u for u in nal_units if kind_of(u) == kind), None) for kind in (SPS, PPS)}
    slices = [u for u in nal_units if kind_of(u) in INTRA_UNITS]
    if first[SPS] is None or first[PPS] is None or not slices:
        raise invalid("HEVC parameter sets or slices are missing")
    return sequence(first[SPS]), picture_set(first[PPS]), slices
