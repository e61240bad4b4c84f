"""HEVC pictures against a coder of random syntax, and samples against their definitions a sample at a time. No encoder's files are at hand here."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from pixelloom.errors import ImageError
from pixelloom.functions import codecs, udfs
from pixelloom.functions.codecs import heic, hevc, info
from pixelloom.functions.codecs import hevc_samples as samples

NAMES = [name for name, values in hevc.CONTEXTS.items() for _ in values]
CHANCES = {"significant": 0.3, "cbf_luma": 0.6, "cbf_chroma": 0.5, "greater1": 0.3, "greater2": 0.3, "qp_delta": 0.3, "bypass_cu": 0.15, "last_x": 0.7, "last_y": 0.7}


class Coder:
    """Stands for the arithmetic decoder: answers at random and writes what it answered."""

    def __init__(self, seed, ends):
        self.random, self.ends, self.out, self.states = random.Random(seed), list(ends), [], []

    def start(self):
        self.low, self.range, self.first, self.waiting = 0, 510, True, 0

    def put(self, b):
        if not self.first:
            self.out.append(b)
        self.first = False
        self.out += [1 - b] * self.waiting
        self.waiting = 0

    def shift(self):
        if self.low < 256:
            self.put(0)
        elif self.low >= 512:
            self.low -= 512
            self.put(1)
        else:
            self.low -= 256
            self.waiting += 1
        self.low <<= 1

    def renormalise(self):
        while self.range < 256:
            self.shift()
            self.range <<= 1

    def bin(self, k):
        b, state = int(self.random.random() < CHANCES.get(NAMES[k], 0.5)), self.states[k]
        low = hevc.LPS[state >> 1][self.range >> 6 & 3]
        self.range -= low
        if b == state & 1:
            self.states[k] = min(state >> 1, 61) + 1 << 1 | b if state >> 1 < 62 else state
        else:
            self.low, self.range = self.low + self.range, low
            self.states[k] = b if state < 2 else hevc.AFTER_LPS[state >> 1] << 1 | 1 - b
        self.renormalise()
        return b

    def bypass(self):
        b = self.random.randrange(2)
        self.low = 2 * self.low + b * self.range
        if self.low >= 1024:
            self.put(1)
            self.low -= 1024
        elif self.low < 512:
            self.put(0)
        else:
            self.low -= 512
            self.waiting += 1
        return b

    def bits(self, n):
        return sum(self.bypass() << (n - 1 - k) for k in range(n))

    def terminate(self):
        b = self.ends.pop(0)
        self.range -= 2
        if b:
            self.low, self.range = self.low + self.range, 2
            self.renormalise()
            self.put(self.low >> 9 & 1)
            self.out += [self.low >> 8 & 1, 1]
            self.out += [0] * (-len(self.out) % 8)
        else:
            self.renormalise()
        return b


def ue(n):
    return bin(n + 1)[2:].zfill(2 * (n + 1).bit_length() - 1)


def se(n):
    return ue(2 * n - 1 if n > 0 else -2 * n)


def unit(kind, bits, tail=b""):
    bits += "1" + "0" * (-(len(bits) + 1) % 8) if not tail else ""
    data, out = int(bits, 2).to_bytes(len(bits) // 8, "big") + tail, bytearray([kind << 1, 1])
    for b in data:
        if b <= 3 and out[2:][-2:] == b"\0\0":
            out.append(3)
        out.append(b)
    return bytes(out)


def coded(seed, width, height, *, window=(0, 0, 0, 0), ctb=4, wavefront=0, delta=0, hiding=0, skip=0, bypass=0, lists=0, sao=1, strong=1, slices=1, across=1, kind=19):
    """Units of a random picture and its planes as made without them."""
    sps = "0000" + "000" + "1" + "0" * 96 + ue(0) + ue(1) + ue(width) + ue(height) + "1" + "".join(ue(n) for n in window) + ue(0) + ue(0) + ue(0) + "1" + ue(0) * 3
    sps += ue(0) + ue(ctb - 3) + ue(0) + ue(min(ctb, 5) - 2) + ue(0) + ue(2)
    sps += ("10" if lists == 1 else "11" + "".join(random_lists(seed)) if lists else "0") + "0" + str(sao) + "0" + ue(0) + "0" + "0" + str(strong) + "0" + "0"
    pps = ue(0) + ue(0) + "0" + "0" + "000" + str(hiding) + "0" + ue(0) + ue(0) + se(4) + "0" + str(skip) + (("1" + ue(1)) if delta else "0") + se(2) + se(-3) + "1" + "00" + str(bypass) + "0" + str(wavefront)
    pps += "1" + "1" + "1" + "0" + se(1) + se(-1) + "0" + "0" + ue(0) + "0" + "0"
    found = [unit(hevc.SPS, sps), unit(hevc.PPS, pps)]
    s, p = hevc.sequence(found[0]), hevc.picture_set(found[1])
    picture = hevc.Picture(s, p)
    total, columns = picture.columns * picture.rows, picture.columns
    starts = [total * k // slices for k in range(slices)] + [total]
    for k, (start, end) in enumerate(zip(starts, starts[1:])):
        ends = []
        for at in range(start, end):
            ends.append(int(at == end - 1))
            if wavefront and at < end - 1 and (at + 1) % columns == 0:
                ends.append(1)
        c = Coder(seed * 100 + k, ends)
        first = "1" if start == 0 else "0"
        bits = first + "0" + ue(0) + ("" if start == 0 else f"{start:b}".zfill((total - 1).bit_length())) + ue(2)
        if kind not in hevc.IDR_UNITS:
            bits += "0000" + "0" + ue(0) + ue(0)
        bits += ("11" if sao else "") + se(3) + se(1) + se(0) + "1" + "0" + se(-1) + se(2) + str(across) + (ue(0) if wavefront else "")
        bits += "1" + "0" * (-(len(bits) + 1) % 8)
        h = hevc.slice_header(unit(kind, bits, b"\x55"), s, p)
        assert h.data == b"\x55" and (h.start, h.qp, h.beta, h.tc, h.across) == (start, 33, -2, 4, across)
        picture.decode(h, c)
        assert not c.ends
        found.append(unit(kind, bits, int("".join(map(str, c.out)), 2).to_bytes(len(c.out) // 8, "big")))
    return found, picture.finished()


def random_lists(seed):
    r = random.Random(seed)
    for s in range(4):
        for m in range(0, 6, 3 if s == 3 else 1):
            if r.random() < 0.4:
                yield "0" + ue(r.randrange(m + 1) if s < 3 else r.randrange(m // 3 + 1))
            else:
                yield "1" + (se(r.randrange(-4, 9)) if s > 1 else "") + "".join(se(r.randrange(-2, 4)) for _ in range(16 if s == 0 else 64))


SHAPES = [
    {},
    {"ctb": 6, "delta": 1, "hiding": 1},
    {"ctb": 5, "skip": 1, "bypass": 1, "delta": 1},
    {"wavefront": 1, "hiding": 1, "delta": 1},
    {"lists": 1, "ctb": 5},
    {"lists": 2, "ctb": 5, "hiding": 1},
    {"slices": 3, "across": 0, "bypass": 1},
    {"slices": 4, "wavefront": 1, "kind": 21},
    {"sao": 0, "strong": 0, "ctb": 6},
]


def attempt(seed, width, height, **shape):
    """A random picture whose QP differences are all allowed."""
    for k in range(50):
        try:
            return coded(seed + 1000 * k, width, height, **shape)
        except ImageError as e:
            assert e.reason in ("QP difference", "coefficient")
    raise AssertionError


@pytest.mark.parametrize("shape", SHAPES, ids=str)
def test_syntax_round_trip(shape):
    for seed, (width, height) in enumerate([(8, 8), (72, 40), (40, 88)]):
        shape_here = shape | {"slices": 1} if (width, height) == (8, 8) else shape
        units, planes = attempt(seed, width, height, **shape_here)
        _, again = hevc.decode(units)
        assert all(np.array_equal(a, b) for a, b in zip(planes, again))
        assert planes[0].shape == (height, width) and planes[1].shape == (height // 2, width // 2)


def test_damage_is_an_error():
    units, _ = attempt(5, 40, 24, delta=1, wavefront=1)
    r = random.Random(3)
    for _ in range(60):
        k, bad = r.randrange(3), list(units)
        data = bytearray(bad[k])
        for _ in range(r.randrange(1, 4)):
            data[r.randrange(2, len(data))] ^= 1 << r.randrange(8)
        bad[k] = bytes(data[: r.randrange(3, len(data) + 1)])
        try:
            hevc.decode(bad)
        except ImageError:
            pass


def predicted(line, n, mode, luma, strong):
    """Intra prediction as it is defined: p(-1, y), p(x, -1), one sample at a time."""
    p = lambda x, y: int(line[2 * n - 1 - y] if x < 0 <= y else line[2 * n] if x < 0 else line[2 * n + 1 + x])
    far = min(abs(mode - 26), abs(mode - 10))
    if luma and mode != 1 and n > 4 and far > {8: 7, 16: 1, 32: 0}[n]:
        q, c = dict(), p(-1, -1)
        bilinear = strong and n == 32 and abs(c + p(63, -1) - 2 * p(31, -1)) < 8 and abs(c + p(-1, 63) - 2 * p(-1, 31)) < 8
        for i in range(2 * n):
            last = i == 2 * n - 1
            if bilinear:
                q[-1, i] = p(-1, i) if last else ((63 - i) * c + (i + 1) * p(-1, 63) + 32) >> 6
                q[i, -1] = p(i, -1) if last else ((63 - i) * c + (i + 1) * p(63, -1) + 32) >> 6
            else:
                q[-1, i] = p(-1, i) if last else (p(-1, i + 1) + 2 * p(-1, i) + p(-1, i - 1) + 2) >> 2
                q[i, -1] = p(i, -1) if last else (p(i - 1, -1) + 2 * p(i, -1) + p(i + 1, -1) + 2) >> 2
        q[-1, -1] = c if bilinear else (p(-1, 0) + 2 * c + p(0, -1) + 2) >> 2
        p = lambda x, y: q[x, y]
    out, shift = np.zeros((n, n), int), n.bit_length()
    if mode == 0:
        for y in range(n):
            for x in range(n):
                out[y, x] = ((n - 1 - x) * p(-1, y) + (x + 1) * p(n, -1) + (n - 1 - y) * p(x, -1) + (y + 1) * p(-1, n) + n) >> shift
    elif mode == 1:
        dc = (sum(p(i, -1) + p(-1, i) for i in range(n)) + n) >> shift
        out[:] = dc
        if luma and n < 32:
            for i in range(1, n):
                out[0, i], out[i, 0] = (p(i, -1) + 3 * dc + 2) >> 2, (p(-1, i) + 3 * dc + 2) >> 2
            out[0, 0] = (p(-1, 0) + 2 * dc + p(0, -1) + 2) >> 2
    else:
        angle, flat = samples.ANGLES[mode - 2], mode < 18
        a = (lambda i, j: p(j, i)) if flat else p
        ref = {0: a(-1, -1)} | {i: a(i - 1, -1) for i in range(1, 2 * n + 1)}
        if (n * angle) >> 5 < -1:
            inverse = int(np.floor(8192 / -angle + 0.5)) * -1
            for i in range(-1, ((n * angle) >> 5) - 1, -1):
                ref[i] = a(-1, -1 + ((i * inverse + 128) >> 8))
        for v in range(n):
            for u in range(n):
                i, f = ((v + 1) * angle) >> 5, ((v + 1) * angle) & 31
                value = ((32 - f) * ref[u + i + 1] + f * ref[u + i + 2] + 16) >> 5 if f else ref[u + i + 1]
                if angle == 0 and u == 0 and luma and n < 32:
                    value = min(max(a(0, -1) + ((a(-1, v) - a(-1, -1)) >> 1), 0), 255)
                out[(u, v) if flat else (v, u)] = value
    return out


def test_prediction():
    r = np.random.default_rng(1)
    for n in (4, 8, 16, 32):
        lines = [r.integers(0, 256, 4 * n + 1), (100 + np.arange(4 * n + 1) / 9).astype(int)]
        for mode in range(35):
            for line in lines:
                for luma in (True, False):
                    for strong in (0, 1):
                        assert np.array_equal(samples.predict(line.astype(np.int32), n, mode, luma, strong), predicted(line, n, mode, luma, strong)), (n, mode, luma)


def test_transforms():
    r = np.random.default_rng(2)
    for k, rows in samples.TRANSFORMS.items():
        n = 1 << k
        i, f = np.meshgrid(np.arange(n), np.arange(n))
        exact = np.cos(np.pi * f * (2 * i + 1) / (2 * n)) * np.where(f == 0, 1, np.sqrt(2)) * 64
        assert np.abs(rows - exact).max() < 1.4
        levels = r.integers(-300, 300, (n, n))
        got = samples.residual(levels, 4, 16, k, 0, False)
        wanted = exact.T @ (levels * 1024 / 2 ** (k + 3)) @ exact / 2**19
        assert np.abs(got - wanted).max() < 2 + 0.02 * np.abs(wanted).max()
    sines = np.array([[np.sin(np.pi * (2 * f + 1) * (i + 1) / 9) for i in range(4)] for f in range(4)])
    assert np.abs(samples.SINES - sines * 256 / 3).max() < 1.5
    step = (3 * 16 * (64 << 1) + 16) >> 5
    assert samples.residual(np.full((4, 4), 3), 10, 16, 2, 1, True).tolist() == [[(step * 128 + 2048) >> 12] * 4] * 4
    assert np.array_equal(samples.residual(np.eye(4, dtype=int) * 9, 12, np.full((4, 4), 32), 2, 0, True), samples.residual(np.eye(4, dtype=int) * 9, 18, 16, 2, 0, True))
    assert [samples.chroma_qp(q) for q in (-3, 29, 30, 35, 42, 43, 57)] == [-3, 29, 29, 33, 37, 37, 51]
    assert len(samples.BETA) == 52 and len(samples.TC) == 54


def test_border():
    plane, owner = np.arange(16 * 16, dtype=np.int32).reshape(16, 16), np.zeros((4, 4), np.int32)
    assert (samples.border(plane, owner, 1, 4, 4, 4, 0) == 128).all()
    owner[0, :2], owner[1, 0] = 1, 1
    line = samples.border(plane, owner, 1, 4, 4, 4, 0)
    assert line.tolist() == [plane[7, 3]] * 4 + [plane[y, 3] for y in (7, 6, 5, 4)] + [plane[3, 3]] + [plane[3, x] for x in (4, 5, 6, 7)] + [plane[3, 7]] * 4
    owner[0, 0] = 2  # another slice: the corner comes from the left
    assert samples.border(plane, owner, 1, 4, 4, 4, 0)[8] == plane[4, 3]
    chroma = samples.border(plane[:8, :8], owner, 1, 2, 2, 2 * 2, 1)
    assert len(chroma) == 17


def deblocked(v, beta, tc):
    """A segment of four lines across an edge, by definition."""
    v = v.astype(int)
    p, q = lambda i, k: v[k, 3 - i], lambda i, k: v[k, 4 + i]
    dp, dq = ([abs(s(2, k) - 2 * s(1, k) + s(0, k)) for k in (0, 3)] for s in (p, q))
    if sum(dp) + sum(dq) >= beta:
        return v
    flat = lambda k, d: 2 * d < beta >> 2 and abs(p(3, k) - p(0, k)) + abs(q(0, k) - q(3, k)) < beta >> 3 and abs(p(0, k) - q(0, k)) < (5 * tc + 1) >> 1
    strong = flat(0, dp[0] + dq[0]) and flat(3, dp[1] + dq[1])
    out, cut = v.copy(), lambda x, a, b: min(max(x, a), b)
    for k in range(4):
        for s, t, way in ((p, q, -1), (q, p, 1)):
            place = lambda i, way=way: 4 + i if way > 0 else 3 - i
            if strong:
                new = [(s(2, k) + 2 * s(1, k) + 2 * s(0, k) + 2 * t(0, k) + t(1, k) + 4) >> 3, (s(2, k) + s(1, k) + s(0, k) + t(0, k) + 2) >> 2, (2 * s(3, k) + 3 * s(2, k) + s(1, k) + s(0, k) + t(0, k) + 4) >> 3]
                for i in range(3):
                    out[k, place(i)] = cut(new[i], s(i, k) - 2 * tc, s(i, k) + 2 * tc)
                continue
            step = (9 * (q(0, k) - p(0, k)) - 3 * (q(1, k) - p(1, k)) + 8) >> 4
            if abs(step) >= 10 * tc:
                continue
            step = cut(step, -tc, tc) * -way
            out[k, place(0)] = cut(s(0, k) + step, 0, 255)
            if sum(dp if way < 0 else dq) < (beta + (beta >> 1)) >> 3:
                out[k, place(1)] = cut(s(1, k) + cut((((s(2, k) + s(0, k) + 1) >> 1) - s(1, k) + step) >> 1, -(tc >> 1), tc >> 1), 0, 255)
    return out


def test_deblocking():
    r, changed = np.random.default_rng(4), 0
    for spread in (1, 2, 4, 10, 40):
        for _ in range(60):
            plane = np.clip(r.integers(90, 160) + r.integers(-spread, spread + 1, (4, 8)) + np.repeat([[0, r.integers(-12, 12)]], 4, 1), 0, 255).astype(np.int32)
            beta, tc = int(r.integers(0, 65)), int(r.integers(0, 25))
            expected, got = deblocked(plane, beta, tc), plane.copy()
            samples.deblock_luma(got, np.array([0]), np.array([1]), np.array([beta]), np.array([tc]), [np.array([False])] * 2)
            assert np.array_equal(got, expected)
            changed += not np.array_equal(got, plane)
    assert changed > 50


def test_offsets():
    r = np.random.default_rng(5)
    plane = r.integers(0, 256, (16, 32)).astype(np.int32)
    for kind, place in [(1, 30), (2, 0), (2, 1), (2, 2), (2, 3)]:
        offsets = (3, 1, -2, -7)
        empty = (0, 0, (0, 0, 0, 0))
        grid = np.ones((4, 8), np.int32)
        made = SimpleNamespace(planes=[plane.copy()], s=SimpleNamespace(ctb=4), sao={(0, 0): [(kind, place, offsets)], (1, 0): [empty]}, owner=grid, bypass=np.zeros_like(grid), slices=[SimpleNamespace(across=1)])
        samples.offset(made)
        dx, dy = [(-1, 0), (0, -1), (-1, -1), (1, -1)][place if kind == 2 else 0]
        for y in range(16):
            for x in range(32):
                v, change = int(plane[y, x]), 0
                if x < 16 and kind == 1:
                    band = ((v >> 3) - place) % 32
                    change = offsets[band] if band < 4 else 0
                elif x < 16 and all(0 <= y + s * dy < 16 and 0 <= x + s * dx < 32 for s in (1, -1)):
                    a, b = plane[y + dy, x + dx], plane[y - dy, x - dx]
                    lower, higher = int(v < a) + int(v < b), int(v > a) + int(v > b)
                    change = {(2, 0): offsets[0], (1, 0): offsets[1], (0, 1): offsets[2], (0, 2): offsets[3]}.get((lower, higher), 0)
                assert made.planes[0][y, x] == min(max(v + change, 0), 255)


def box(kind, body):
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def heic_file(pictures, properties=(), grid=None):
    """A file of coded items 2, 3, ...; the first is the primary item unless there is a grid, item 1."""
    sets = pictures[0][:2]
    config = bytes(21) + b"\3" + bytes([len(sets)]) + b"".join(bytes([hevc.kind_of(u)]) + b"\0\1" + len(u).to_bytes(2, "big") + u for u in sets)
    held, extents = b"", []
    for item, body in ([(1, grid)] if grid else []) + [(k + 2, b"".join(len(u).to_bytes(4, "big") + u for u in units[2:])) for k, units in enumerate(pictures)]:
        extents.append((item, len(held), len(body)))
        held += body
    infe = lambda n, kind: box(b"infe", b"\2\0\0\0" + n.to_bytes(2, "big") + b"\0\0" + kind + b"\0")
    primary, items = 1 if grid else 2, [e[0] for e in extents]
    iloc = b"\1\0\0\0\x44\0" + len(items).to_bytes(2, "big") + b"".join(i.to_bytes(2, "big") + b"\0\1\0\0\0\1" + a.to_bytes(4, "big") + n.to_bytes(4, "big") for i, a, n in extents)
    shown = bytes(range(2, 2 + len(properties)))
    ipma = bytes(4) + len(items).to_bytes(4, "big")
    for i in items:
        own = (b"" if i == 1 else b"\1") + (shown if i == primary else b"")
        ipma += i.to_bytes(2, "big") + bytes([len(own)]) + own
    refs = box(b"iref", bytes(4) + box(b"dimg", b"\0\1" + len(pictures).to_bytes(2, "big") + b"".join(i.to_bytes(2, "big") for i in items[1:]))) if grid else b""
    iinf = box(b"iinf", bytes(4) + len(items).to_bytes(2, "big") + b"".join(infe(i, b"grid" if i == 1 else b"hvc1") for i in items))
    iprp = box(b"iprp", box(b"ipco", box(b"hvcC", config) + b"".join(properties)) + box(b"ipma", ipma))
    return box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", bytes(4) + box(b"pitm", bytes(4) + primary.to_bytes(2, "big")) + iinf + box(b"iloc", iloc) + refs + iprp + box(b"idat", held))


def rgb(planes, x, y, low_y, high_y, right, matrix, full):
    """A pixel in floating point."""
    kr, kb = {1: (0.2126, 0.0722), 9: (0.2627, 0.0593)}.get(matrix, (0.299, 0.114))
    at = min(max(y / 2 - 0.25, low_y), high_y)
    top = int(np.floor(at))
    across = [(x // 2, 1.0)] if x % 2 == 0 else [(x // 2, 0.5), (min(x // 2 + 1, right), 0.5)]
    mixed = [sum(w * ((1 - at + top) * float(p[top, i]) + (at - top) * float(p[min(top + 1, high_y), i])) for i, w in across) - 128 for p in planes[1:]]
    luma, (cb, cr) = float(planes[0][y, x]), mixed
    if not full:
        luma, cb, cr = (luma - 16) * 255 / 219, cb * 255 / 224, cr * 255 / 224
    r, b = luma + 2 * (1 - kr) * cr, luma + 2 * (1 - kb) * cb
    exact = luma - (2 * (1 - kb) * kb * cb + 2 * (1 - kr) * kr * cr) / (1 - kr - kb)
    return np.clip([r, exact, b], 0, 255)


def test_files():
    units, planes = attempt(7, 48, 40, window=(1, 2, 0, 3), ctb=5)
    left, top, width, height = 2, 0, 42, 34
    data = heic_file([units])
    assert codecs.detect(data) == "heic" and info.size_of(data, "heic") == (42, 34)
    name, pixels = codecs.decode(data)
    assert name == "heic" and pixels.shape == (34, 42, 4) and (pixels[..., 3] == 255).all()
    with pytest.raises(ImageError):
        codecs.decode(data, most=1000)
    for matrix, full in ((6, False), (1, True), (9, False), (2, True)):
        colr = box(b"colr", b"nclx\0\1\0\1" + matrix.to_bytes(2, "big") + (b"\x80" if full else b"\0"))
        got = codecs.decode(heic_file([units], [colr]))[1]
        expected = np.array([[rgb(planes, x, y, top >> 1, (top + height - 1) >> 1, (left + width - 1) >> 1, matrix, full) for x in range(left, left + width)] for y in range(top, top + height)])
        assert np.abs(got[..., :3] - expected).max() <= 0.51
    clap = box(b"clap", np.array([41, 1, 33, 1, 1, 2, 1, 2], ">i4").tobytes())
    part = heic.to_rgb(planes, (3, 1, 41, 33), 6, False)
    for turns in range(4):
        for axis in (None, 0, 1):
            got = codecs.decode(heic_file([units], [clap, box(b"irot", bytes([turns]))] + ([] if axis is None else [box(b"imir", bytes([axis]))])))[1]
            want = part
            for _ in range(turns):  # a quarter turn against the clock: the last column becomes the first row
                want = want[:, ::-1].transpose(1, 0, 2)
            want = want if axis is None else want[:, ::-1] if axis == 0 else want[::-1]
            assert np.array_equal(got, want)


def test_grids():
    made = [attempt(20 + k, 16, 16) for k in range(6)]
    tiles = [heic.to_rgb(planes, (0, 0, 16, 16), 6, False) for _, planes in made]
    whole = np.concatenate([np.concatenate(tiles[3 * k : 3 * k + 3], 1) for k in range(2)])
    layout = b"\0\0\1\2" + (45).to_bytes(2, "big") + (30).to_bytes(2, "big")
    data = heic_file([u for u, _ in made], [box(b"irot", b"\1")], layout)
    assert np.array_equal(codecs.decode(data)[1], np.rot90(whole[:30, :45]))
    for bad in (layout[:3] + b"\1" + layout[4:], layout[:4] + b"\0\x40" + layout[6:], layout[:5]):
        with pytest.raises(ImageError):
            codecs.decode(heic_file([u for u, _ in made], [], bad))


def test_refusals():
    units, _ = attempt(1, 16, 16)
    for bad in ([], units[1:], units[:2], [units[0], *units[2:]]):
        with pytest.raises(ImageError):
            hevc.decode(bad)
    with pytest.raises(ImageError) as e:
        hevc.decode(units[:2] + [units[2]] * 2)
    assert e.value.reason == "slices overlap"
    with pytest.raises(ImageError):
        codecs.encode(np.zeros((2, 2, 4), np.uint8), "heic")
    assert hevc.units(b"\0\0\0\2ab\0\0\0\3cde", 4) == [b"ab", b"cde"]
    assert hevc.unescaped(b"\0\0\3\0\0\3\1\0\0\3") == b"\0\0\0\0\1\0\0"


def test_rows(spark):
    units, planes = attempt(9, 24, 16)
    data = heic_file([units])
    files = spark.createDataFrame([(1, data), (2, data[:-40]), (3, data.replace(b"hvc1", b"av01"))], "k int, content binary")
    found = {r.k: r for r in udfs.decoded(files).collect()}
    expected = heic.to_rgb(planes, (0, 0, 24, 16), 6, False)
    assert (found[1].format, found[1].width, found[1].height, found[1].error) == ("heic", 24, 16, None)
    assert found[1].r == expected[..., 0].ravel().tolist() and found[1].b == expected[..., 2].ravel().tolist() and set(found[1].a) == {255}
    assert found[2].error.code == "invalidData" and found[3].error.code == "unsupportedFeature"
