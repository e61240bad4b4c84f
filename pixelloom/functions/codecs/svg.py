"""SVG: documents to a list of filled outlines, and those to pixels.

Outlines are filled without a loop over pixels: every crossing of an outline with one of SAMPLES scan lines a row adds the covered part of its pixel and the
whole of those behind it, with the sign of entering or leaving the shape, and running sums along the rows give exact horizontal coverage.
Strokes are unions of positive polygons. Work is bounded: nested `use` elements, points and shapes are counted against budgets.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

import numpy as np

from ...errors import INVALID_DIMENSIONS, ImageError, invalid, unsupported

SAMPLES, ROWS_AT_A_TIME, MOST_PIXELS = 4, 64, 2**28
#: Depth of elements and of `use`, visits of elements, points, shapes, points of one path and of one stroke.
DEPTH, USES, VISITS, POINTS, SHAPES, PATH_POINTS, STROKE_POINTS = 256, 12, 1_000_000, 2_000_000, 100_000, 500_000, 24_000
DEFAULT_SIZE = (300.0, 150.0)
NUMBER = re.compile(r"[\s,]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^<>\[]|\[[^\]]*\])*>|</\s*([^\s>]+)\s*>|<([^\s/>!?]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.DOTALL)
ENTITY = re.compile(r"&(#x[0-9a-fA-F]+|#\d+|amp|lt|gt|quot|apos);")
#: Pixels of a unit, entities, styles that are also attributes.
UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "mm": 96 / 25.4, "cm": 96 / 2.54, "in": 96.0}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
STYLES = frozenset(["fill", "fill-opacity", "fill-rule", "stroke", "stroke-opacity", "stroke-width", "stroke-linecap", "stroke-linejoin", "stroke-miterlimit", "opacity", "color", "display", "visibility", "stop-color", "stop-opacity"])
#: CSS colour names.
NAMED = dict(x.split() for x in """aliceblue f0f8ff,antiquewhite faebd7,aqua 00ffff,aquamarine 7fffd4,azure f0ffff,beige f5f5dc,bisque ffe4c4,black 000000,blanchedalmond ffebcd,blue 0000ff,
blueviolet 8a2be2,brown a52a2a,burlywood deb887,cadetblue 5f9ea0,chartreuse 7fff00,chocolate d2691e,coral ff7f50,cornflowerblue 6495ed,cornsilk fff8dc,crimson dc143c,cyan 00ffff,darkblue 00008b,
darkcyan 008b8b,darkgoldenrod b8860b,darkgray a9a9a9,darkgreen 006400,darkgrey a9a9a9,darkkhaki bdb76b,darkmagenta 8b008b,darkolivegreen 556b2f,darkorange ff8c00,darkorchid 9932cc,darkred 8b0000,
darksalmon e9967a,darkseagreen 8fbc8f,darkslateblue 483d8b,darkslategray 2f4f4f,darkslategrey 2f4f4f,darkturquoise 00ced1,darkviolet 9400d3,deeppink ff1493,deepskyblue 00bfff,dimgray 696969,
dimgrey 696969,dodgerblue 1e90ff,firebrick b22222,floralwhite fffaf0,forestgreen 228b22,fuchsia ff00ff,gainsboro dcdcdc,ghostwhite f8f8ff,gold ffd700,goldenrod daa520,gray 808080,green 008000,
greenyellow adff2f,grey 808080,honeydew f0fff0,hotpink ff69b4,indianred cd5c5c,indigo 4b0082,ivory fffff0,khaki f0e68c,lavender e6e6fa,lavenderblush fff0f5,lawngreen 7cfc00,lemonchiffon fffacd,
lightblue add8e6,lightcoral f08080,lightcyan e0ffff,lightgoldenrodyellow fafad2,lightgray d3d3d3,lightgreen 90ee90,lightgrey d3d3d3,lightpink ffb6c1,lightsalmon ffa07a,lightseagreen 20b2aa,
lightskyblue 87cefa,lightslategray 778899,lightslategrey 778899,lightsteelblue b0c4de,lightyellow ffffe0,lime 00ff00,limegreen 32cd32,linen faf0e6,magenta ff00ff,maroon 800000,
mediumaquamarine 66cdaa,mediumblue 0000cd,mediumorchid ba55d3,mediumpurple 9370db,mediumseagreen 3cb371,mediumslateblue 7b68ee,mediumspringgreen 00fa9a,mediumturquoise 48d1cc,
mediumvioletred c71585,midnightblue 191970,mintcream f5fffa,mistyrose ffe4e1,moccasin ffe4b5,navajowhite ffdead,navy 000080,oldlace fdf5e6,olive 808000,olivedrab 6b8e23,orange ffa500,
orangered ff4500,orchid da70d6,palegoldenrod eee8aa,palegreen 98fb98,paleturquoise afeeee,palevioletred db7093,papayawhip ffefd5,peachpuff ffdab9,peru cd853f,pink ffc0cb,plum dda0dd,
powderblue b0e0e6,purple 800080,rebeccapurple 663399,red ff0000,rosybrown bc8f8f,royalblue 4169e1,saddlebrown 8b4513,salmon fa8072,sandybrown f4a460,seagreen 2e8b57,seashell fff5ee,sienna a0522d,
silver c0c0c0,skyblue 87ceeb,slateblue 6a5acd,slategray 708090,slategrey 708090,snow fffafa,springgreen 00ff7f,steelblue 4682b4,tan d2b48c,teal 008080,thistle d8bfd8,tomato ff6347,
turquoise 40e0d0,violet ee82ee,wheat f5deb3,white ffffff,whitesmoke f5f5f5,yellow ffff00,yellowgreen 9acd32""".replace("\n", "").split(","))
BLACK, CLEAR = (0, 0, 0, 255), (0, 0, 0, 0)


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    children: list[Element] = field(default_factory=list)


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] in ENTITIES:
            return ENTITIES[m[1]]
        code = int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""

    return ENTITY.sub(one, text)


def parse_xml(data: bytes) -> Element:
    """The root element. Names of closing tags aren't compared; what isn't an element is skipped."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    open_: list[Element] = []
    for m in TAG.finditer(text):
        if m[2]:
            found = Element(m[2].rsplit(":", 1)[-1], {k: unescaped(a or b) for k, a, b in ATTRIBUTE.findall(m[3])})
            if open_:
                open_[-1].children.append(found)
            if not m[4]:
                if len(open_) >= DEPTH:
                    raise invalid("elements are nested too deeply")
                open_.append(found)
            elif not open_:
                return found
        elif m[1]:
            if not open_:
                raise invalid("a tag is closed that isn't open")
            last = open_.pop()
            if not open_:
                return last
    raise invalid("no complete root element")


def numbers(text: str, most: int | None = None) -> tuple[list[float], int]:
    """Numbers that the text begins with, and the place after them."""
    out, at = [], 0
    while (most is None or len(out) < most) and (m := NUMBER.match(text, at)):
        out.append(float(m[1]))
        at = m.end()
    return out, at


def length(text: str | None, reference: float | None = None) -> float | None:
    """Pixels; with a reference also percentages, em and ex."""
    if text is None:
        return None
    found, at = numbers(text.strip(), 1)
    unit = text.strip()[at:].strip()
    if not found:
        return None
    relative = {"%": reference / 100, "em": 16.0, "ex": 8.0} if reference is not None else {}
    factor = (UNITS | relative).get(unit)
    return None if factor is None else found[0] * factor


def view_box(root: Element) -> tuple[float, ...] | None:
    found, _ = numbers(root.attributes.get("viewBox", ""), 4)
    return tuple(found) if len(found) == 4 and found[2] > 0 and found[3] > 0 else None


def intrinsic_size(root: Element) -> tuple[float, float]:
    box = view_box(root)
    w, h = (x if (x := length(root.attributes.get(k))) and x > 0 else None for k in ("width", "height"))
    if w and h:
        return w, h
    if w:
        return w, w * box[3] / box[2] if box else DEFAULT_SIZE[1]
    if h:
        return h * box[2] / box[3] if box else DEFAULT_SIZE[0], h
    return (box[2], box[3]) if box else DEFAULT_SIZE


def pixel_size(root: Element, width: int | None = None, height: int | None = None, most: int = MOST_PIXELS) -> tuple[int, int]:
    """Size of the image: as asked for, or the document's; one asked side keeps the aspect, and what is too large is made smaller."""
    iw, ih = intrinsic_size(root)
    w = float(width) if width is not None else height * iw / ih if height is not None else iw
    h = float(height) if height is not None else width * ih / iw if width is not None else ih
    if not (w >= 0.5 and h >= 0.5 and math.isfinite(w) and math.isfinite(h)):
        raise ImageError(INVALID_DIMENSIONS, f"{w} x {h}")
    if w * h > most:
        w, h = (x * math.sqrt(most / (w * h)) for x in (w, h))
    w, h = (max(1, int(min(math.floor(x + 0.5), most))) for x in (w, h))
    return min(w, most // h), h


def rounded(x) -> int:
    return int(min(255, max(0, math.floor(x + 0.5))))


def parse_color(text: str) -> tuple[int, int, int, int] | None:
    t = text.strip().lower()
    if t.startswith("#"):
        digits = t[1:]
        if not re.fullmatch("[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8}", digits):
            return None
        parts = [d * 2 for d in digits] if len(digits) < 6 else [digits[i : i + 2] for i in range(0, len(digits), 2)]
        return tuple(int(p, 16) for p in [*parts, "ff"][:4])
    if m := re.match(r"(rgb|hsl)a?\((.*)\)", t, re.DOTALL):
        found = [(float(v), unit == "%") for v, unit in re.findall(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(%?)", m[2])]
        if len(found) < 3:
            return None
        a = rounded((found[3][0] / 100 if found[3][1] else found[3][0]) * 255) if len(found) > 3 else 255
        if m[1] == "rgb":
            return (*(rounded(v * 255 / 100 if percent else v) for v, percent in found[:3]), a)
        hue, (s, light) = found[0][0] % 360 / 30, (min(1.0, max(0.0, v / 100)) for v, _ in found[1:3])
        reach = s * min(light, 1 - light)
        return (*(rounded(255 * (light - reach * max(-1, min(k - 3, 9 - k, 1)))) for k in ((n + hue) % 12 for n in (0, 8, 4))), a)
    if t == "transparent":
        return CLEAR
    return (*bytes.fromhex(NAMED[t]), 255) if t in NAMED else None


def parse_paint(text: str) -> tuple | None:
    """("none",), ("current",), ("color", rgba) or ("url", id, colour if the id is missing)."""
    t = text.strip()
    if t in ("none", "currentColor"):
        return ("none",) if t == "none" else ("current",)
    if m := re.match(r"url\(\s*['\"]?#([^)'\"]*)['\"]?\s*\)\s*(.*)", t, re.DOTALL):
        return ("url", m[1].strip(), None if m[2] in ("", "none") else parse_color(m[2]))
    color = parse_color(t)
    return ("color", color) if color else None


def matrix(a=1.0, b=0.0, c=0.0, d=1.0, e=0.0, f=0.0) -> np.ndarray:
    return np.array([[a, c, e], [b, d, f], [0, 0, 1.0]])


def parse_transform(text: str) -> np.ndarray:
    out = matrix()
    for name, body in re.findall(r"([A-Za-z]+)\s*\(([^)]*)\)", text):
        v = numbers(body)[0]
        if name == "matrix" and len(v) >= 6:
            m = matrix(*v[:6])
        elif name == "translate" and v:
            m = matrix(e=v[0], f=v[1] if len(v) > 1 else 0.0)
        elif name == "scale" and v:
            m = matrix(a=v[0], d=v[1] if len(v) > 1 else v[0])
        elif name == "rotate" and v:
            r, (x, y) = math.radians(v[0]), v[1:3] if len(v) > 2 else (0.0, 0.0)
            m = matrix(e=x, f=y) @ matrix(math.cos(r), math.sin(r), -math.sin(r), math.cos(r)) @ matrix(e=-x, f=-y)
        elif name in ("skewX", "skewY") and v:
            tan = math.tan(math.radians(v[0]))
            m = matrix(c=tan) if name == "skewX" else matrix(b=tan)
        else:
            continue
        out = out @ m
    return out


def moved(points: np.ndarray, m: np.ndarray) -> np.ndarray:
    return points @ m[:2, :2].T + m[:2, 2]


class Path:
    """Polylines (points, closed) of a path; curves are cut so that they are off by at most the tolerance."""

    def __init__(self, tolerance: float):
        self.tolerance = max(tolerance, 1e-9)
        self.lines: list[tuple[list, bool]] = []
        self.at = self.start = (0.0, 0.0)
        self.left = PATH_POINTS

    def move(self, p) -> None:
        self.at = self.start = p
        if self.left > 0:
            self.left -= 1
            self.lines.append(([p], False))

    def line(self, p) -> None:
        if self.left > 0:
            self.left -= 1
            if not self.lines or self.lines[-1][1]:
                self.lines.append(([self.at], False))
            self.lines[-1][0].append(p)
        self.at = p

    def close(self) -> None:
        if self.lines:
            self.lines[-1] = (self.lines[-1][0], True)
            self.at = self.start

    def steps(self, bend: float) -> int:
        return int(min(max(1.0, math.ceil(bend)), 4096, max(1, self.left))) if math.isfinite(bend) else 1

    def cubic(self, c1, c2, end) -> None:
        p = np.array([self.at, c1, c2, end])
        with np.errstate(all="ignore"):
            n = self.steps(math.sqrt(0.75 * float(np.abs(np.diff(p, 2, axis=0)).max()) / self.tolerance))
        t = np.linspace(0, 1, n + 1)[1:-1, None]
        for x, y in ((1 - t) ** 3 * p[0] + 3 * t * (1 - t) ** 2 * p[1] + 3 * t * t * (1 - t) * p[2] + t**3 * p[3]).tolist():
            self.line((x, y))
        self.line(end)

    def quadratic(self, c, end) -> None:
        third = lambda a: tuple(x + (y - x) * 2 / 3 for x, y in zip(a, c, strict=True))
        self.cubic(third(self.at), third(end), end)

    def ellipse_part(self, center, rx: float, ry: float, turn: float, first: float, sweep: float) -> None:
        flat = 2 * math.acos(max(-1.0, 1 - min(1.0, self.tolerance / max(rx, ry, 1e-12))))
        t = first + sweep * np.arange(1, self.steps(max(abs(sweep) / max(flat, 1e-4), abs(sweep))) + 1) / self.steps(max(abs(sweep) / max(flat, 1e-4), abs(sweep)))
        x, y = rx * np.cos(t), ry * np.sin(t)
        for p in zip((center[0] + x * math.cos(turn) - y * math.sin(turn)).tolist(), (center[1] + x * math.sin(turn) + y * math.cos(turn)).tolist(), strict=True):
            self.line(p)

    def arc(self, rx: float, ry: float, degrees: float, large: bool, sweep: bool, end) -> None:
        """The arc between two points, by the centre that the standard's end point parameters have."""
        rx, ry, turn = abs(rx), abs(ry), math.radians(degrees)
        dx, dy = (self.at[0] - end[0]) / 2, (self.at[1] - end[1]) / 2
        if rx < 1e-9 or ry < 1e-9 or math.hypot(dx, dy) < 1e-12:
            return self.line(end)
        x, y = math.cos(turn) * dx + math.sin(turn) * dy, -math.sin(turn) * dx + math.cos(turn) * dy
        grow = math.sqrt(max(1.0, (x / rx) ** 2 + (y / ry) ** 2))
        rx, ry = rx * grow, ry * grow
        off = math.sqrt(max(0.0, (rx * ry) ** 2 / max((rx * y) ** 2 + (ry * x) ** 2, 1e-300) - 1)) * (1 if large != sweep else -1)
        cx, cy = off * rx * y / ry, -off * ry * x / rx
        center = (math.cos(turn) * cx - math.sin(turn) * cy + (self.at[0] + end[0]) / 2, math.sin(turn) * cx + math.cos(turn) * cy + (self.at[1] + end[1]) / 2)
        first, last = math.atan2((y - cy) / ry, (x - cx) / rx), math.atan2((-y - cy) / ry, (-x - cx) / rx)
        delta = (last - first) % (2 * math.pi)
        self.ellipse_part(center, rx, ry, turn, first, delta if sweep else delta - 2 * math.pi)
        self.lines[-1][0][-1] = self.at = end

    def ellipse(self, cx: float, cy: float, rx: float, ry: float) -> None:
        if rx > 0 and ry > 0:
            self.move((cx + rx, cy))
            self.ellipse_part((cx, cy), rx, ry, 0.0, 0.0, 2 * math.pi)
            self.close()

    def rect(self, x: float, y: float, w: float, h: float, rx: float, ry: float) -> None:
        if w <= 0 or h <= 0:
            return
        rx, ry = min(max(rx, 0.0), w / 2), min(max(ry, 0.0), h / 2)
        self.move((x + rx, y))
        corners = [(x + w, y, -1, 1), (x + w, y + h, -1, -1), (x, y + h, 1, -1), (x, y, 1, 1)]
        for k, (cx, cy, sx, sy) in enumerate(corners):
            if rx and ry:
                self.line((cx + sx * rx, cy) if k % 2 == 0 else (cx, cy + sy * ry))
                self.ellipse_part((cx + sx * rx, cy + sy * ry), rx, ry, 0.0, math.pi / 2 * (k - 1), math.pi / 2)
            elif k < 3:
                self.line((cx, cy))
        self.close()

    def polyline(self, text: str, closed: bool) -> None:
        v = numbers(text)[0]
        for k in range(0, len(v) - 1, 2):
            (self.line if k else self.move)((v[k], v[k + 1]))
        if closed:
            self.close()

    def data(self, text: str) -> None:
        """Path data up to the first error."""
        at, command, last, control = 0, "", "", None
        need = {"m": 2, "l": 2, "h": 1, "v": 1, "c": 6, "s": 4, "q": 4, "t": 2, "a": 7, "z": 0}
        blank = re.compile(r"[\s,]*")
        while (at := blank.match(text, at).end()) < len(text):
            if text[at].lower() in need:
                command, at = text[at], at + 1
            elif not command or command in "zZ":
                return
            kind, relative = command.lower(), command.islower()
            v: list[float] = []
            while len(v) < need[kind]:
                if kind == "a" and len(v) in (3, 4):  # flags may stand without a space
                    m = re.compile(r"[\s,]*([01])").match(text, at)
                else:
                    m = NUMBER.match(text, at)
                if not m:
                    return
                v.append(float(m[1]))
                at = m.end()
            if not last and kind != "m":
                return
            ox, oy = self.at if relative else (0.0, 0.0)
            points = [(v[k] + ox, v[k + 1] + oy) for k in range(0, len(v) - 1, 2)] if kind in "mlcsqt" else []
            mirrored = tuple(2 * p - c for p, c in zip(self.at, control, strict=True)) if control and last in {"s": "cs", "t": "qt"}.get(kind, "") else self.at
            control = None
            if kind == "m":
                self.move(points[0])
                command = "l" if relative else "L"
            elif kind == "l":
                self.line(points[0])
            elif kind == "h":
                self.line((v[0] + ox, self.at[1]))
            elif kind == "v":
                self.line((self.at[0], v[0] + oy))
            elif kind in "cs":
                c1, c2, end = points if kind == "c" else (mirrored, *points)
                self.cubic(c1, c2, end)
                control = c2
            elif kind in "qt":
                c, end = points if kind == "q" else (mirrored, points[0])
                self.quadratic(c, end)
                control = c
            elif kind == "a":
                self.arc(v[0], v[1], v[2], v[3] == 1, v[4] == 1, (v[5] + ox, v[6] + oy))
            else:
                self.close()
            last = kind


def stroked(lines: list, width: float, cap: str, join: str, limit: float, tolerance: float) -> list:
    """Polygons whose union is the stroke: one a segment, one a join, one a cap, all turning the same way."""
    half, out, left = max(width, 1e-6) / 2, [], STROKE_POINTS
    corners = min(256, max(8, math.ceil(2 * math.pi / max(2 * math.acos(min(1.0, max(0.0, 1 - tolerance / half))), 1e-3))))
    angles = 2 * np.pi * np.arange(corners) / corners
    circle = half * np.stack([np.cos(angles), np.sin(angles)], axis=1)

    def add(points) -> bool:
        nonlocal left
        p = np.array(points, float)
        left = left - len(p) if len(p) <= left else -1
        if left < 0:
            return False
        x, y = p[:, 0], p[:, 1]
        out.append((p if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() >= 0 else p[::-1], True))
        return True

    for points, closed in lines:
        p = np.array(points, float)
        p = p[np.concatenate([[True], np.hypot(*np.diff(p, axis=0).T) > 1e-9])] if len(p) > 1 else p
        if closed and len(p) > 1 and np.hypot(*(p[0] - p[-1])) <= 1e-9:
            p = p[:-1]
        if len(p) == 1:
            if cap == "round":
                add(p[0] + circle)
            elif cap == "square":
                add(p[0] + half * np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]))
            continue
        ends = np.roll(p, -1, axis=0) if closed else p[1:]
        along = ends - p[: len(ends)]
        along = along / np.hypot(along[:, 0], along[:, 1])[:, None]
        normal = half * np.stack([along[:, 1], -along[:, 0]], axis=1)  # to the outside of a left turn's opposite
        for a, z, n in zip(p, ends, normal, strict=False):
            if not add([a + n, z + n, z - n, a - n]):
                return out
        for k in range(len(p)) if closed else range(1, len(p) - 1):
            before, after = along[k - 1], along[k % len(along)]
            turn = before[0] * after[1] - before[1] * after[0]
            if join == "round":
                ok = add(p[k] + circle)
            elif abs(turn) < 1e-12:
                continue
            else:
                side = 1 if turn > 0 else -1
                one, two = side * normal[k - 1], side * normal[k % len(along)]
                middle = (one + two) / max(np.hypot(*(one + two)), 1e-300)
                cosine = float(middle @ one) / half
                tip = [p[k] + middle * half / cosine] if join == "miter" and cosine > 1e-6 and 1 / cosine <= limit else []
                ok = add([p[k], p[k] + one, *tip, p[k] + two])
            if not ok:
                return out
        for end, way, n in () if closed else ((p[0], -along[0], normal[0]), (p[-1], along[-1], normal[-1])):
            if cap == "round":
                add(end + circle)
            elif cap == "square":
                add([end + n, end + n + half * way, end - n + half * way, end - n])
    return out


@dataclass
class Gradient:
    """Colours by a number that grows along a line or from a focus to a circle."""

    to_gradient: np.ndarray
    offsets: np.ndarray
    colors: np.ndarray
    spread: str
    line: tuple | None = None
    circle: tuple | None = None

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = moved(np.stack([x, y], axis=-1), self.to_gradient)
        if self.line:
            start, delta = self.line
            size = float(delta @ delta)
            t = (p - start) @ delta / size if size > 1e-12 else np.ones(p.shape[:-1])
        else:
            center, radius, focus = self.circle
            way = p - focus
            far = np.hypot(way[..., 0], way[..., 1])
            unit, off = way / np.maximum(far, 1e-12)[..., None], focus - center
            b = unit @ off
            s = -b + np.sqrt(np.maximum(0, b * b - off @ off + radius * radius))
            t = np.where(far < 1e-12, 0.0, np.where(s > 1e-12, far / np.where(s > 1e-12, s, 1), 1.0))
        if self.spread == "repeat":
            t = t - np.floor(t)
        elif self.spread == "reflect":
            t = np.abs(np.fmod(t, 2))
            t = np.where(t > 1, 2 - t, t)
        t = np.clip(t, 0, 1)
        at = np.clip(np.searchsorted(self.offsets, t, side="left"), 1, len(self.offsets) - 1)
        low, span = self.offsets[at - 1], self.offsets[at] - self.offsets[at - 1]
        part = np.where(t <= self.offsets[0], 0.0, np.where(span > 1e-12, np.clip((t - low) / np.where(span > 1e-12, span, 1), 0, 1), 1.0))
        one = np.where(t <= self.offsets[0], 1, at)
        a, z = self.colors[one - 1], self.colors[np.where(t >= self.offsets[-1], len(self.offsets) - 1, one)]
        part = np.where(t >= self.offsets[-1], np.where(t <= self.offsets[0], 0.0, 1.0), part)
        return np.floor(a + (z - a) * part[..., None] + 0.5)


@dataclass(frozen=True)
class State:
    transform: np.ndarray
    fill: tuple = ("color", BLACK)
    stroke: tuple = ("none",)
    fill_opacity: float = 1.0
    stroke_opacity: float = 1.0
    opacity: float = 1.0
    rule: str = "nonzero"
    width: float = 1.0
    cap: str = "butt"
    join: str = "miter"
    limit: float = 4.0
    color: tuple = BLACK


@dataclass
class Shape:
    lines: list
    even_odd: bool
    paint: tuple | Gradient
    opacity: float


def opacity_of(text: str | None) -> float | None:
    found, at = numbers(text or "", 1)
    return min(1.0, max(0.0, found[0] / 100 if text[at : at + 1] == "%" else found[0])) if found else None


def styles_of(element: Element) -> dict[str, str]:
    found = {k: v for k, v in element.attributes.items() if k in STYLES}
    for part in element.attributes["style"].split(";") if "style" in element.attributes else ():
        name, colon, value = part.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


class Scene:
    """The shapes of a document, in painting order, in pixels of an image of the given size."""

    def __init__(self, root: Element, width: int, height: int):
        self.by_id: dict[str, Element] = {}
        todo = [root]
        while todo:
            e = todo.pop()
            if "id" in e.attributes:
                self.by_id.setdefault(e.attributes["id"], e)
            todo += reversed(e.children)
        self.shapes: list[Shape] = []
        self.visits, self.points, self.uses, self.depth = VISITS, POINTS, 0, 0
        box, size = view_box(root), intrinsic_size(root)
        self.view = (box[2], box[3]) if box else size
        if box:
            sx, sy, align = width / box[2], height / box[3], (0.5, 0.5)
            words = root.attributes.get("preserveAspectRatio", "").split() or ["xMidYMid"]
            if words[0] != "none":
                sx = sy = (max if words[1:2] == ["slice"] else min)(sx, sy)
                part = lambda word: {"Min": 0.0, "Max": 1.0}.get(word, 0.5)
                align = part(words[0][1:4]), part(words[0][-3:])
            base = matrix(e=(width - box[2] * sx) * align[0], f=(height - box[3] * sy) * align[1]) @ matrix(a=sx, d=sy) @ matrix(e=-box[0], f=-box[1])
        else:
            base = matrix(a=width / size[0], d=height / size[1])
        self.diagonal = math.hypot(*self.view) / math.sqrt(2)
        state = self.styled(root, State(base), styles_of(root))
        for child in root.children:
            self.draw(child, state)

    def size(self, element: Element, styles: dict, name: str, reference: float) -> float | None:
        return length(styles.get(name, element.attributes.get(name)), reference)

    def styled(self, element: Element, state: State, styles: dict[str, str]) -> State:
        new: dict = {}
        if not styles and "transform" not in element.attributes:
            return state
        if "transform" in element.attributes:
            new["transform"] = state.transform @ parse_transform(element.attributes["transform"])
        if c := parse_color(styles.get("color", "")):
            new["color"] = c
        new |= {k: p for k in ("fill", "stroke") if (p := parse_paint(styles.get(k, "")))}
        new |= {k.replace("-", "_"): v for k in ("fill-opacity", "stroke-opacity") if (v := opacity_of(styles.get(k))) is not None}
        if (v := opacity_of(styles.get("opacity"))) is not None:
            new["opacity"] = state.opacity * v
        for key, name, known in (("rule", "fill-rule", ("nonzero", "evenodd")), ("cap", "stroke-linecap", ("butt", "round", "square")), ("join", "stroke-linejoin", ("miter", "round", "bevel"))):
            if styles.get(name) in known:
                new[key] = styles[name]
        if (v := length(styles.get("stroke-width"), self.diagonal)) is not None:
            new["width"] = max(0.0, v)
        if (found := numbers(styles.get("stroke-miterlimit", ""), 1)[0]) and found[0] >= 1:
            new["limit"] = found[0]
        return replace(state, **new)

    def draw(self, element: Element, state: State) -> None:
        styles = styles_of(element)
        if self.visits <= 0 or self.points <= 0 or self.depth >= DEPTH or styles.get("display") == "none" or styles.get("visibility") in ("hidden", "collapse"):
            self.visits -= 1
            return
        self.visits -= 1
        self.depth += 1
        kind = element.name
        if kind in ("g", "a", "svg", "switch", "use"):
            state = self.styled(element, state, styles)
            if kind in ("svg", "use"):
                x, y = (self.size(element, styles, k, r) or 0.0 for k, r in zip("xy", self.view, strict=True))
                state = replace(state, transform=state.transform @ matrix(e=x, f=y)) if x or y else state
            if kind == "use":
                target = self.by_id.get(self.href(element) or "")
                if target is not None and self.uses < USES:
                    self.uses += 1
                    self.draw(target, state)
                    self.uses -= 1
            elif kind == "switch":
                chosen = next((c for c in element.children if not {"requiredFeatures", "requiredExtensions", "systemLanguage"} & c.attributes.keys()), None)
                if chosen is not None:
                    self.draw(chosen, state)
            else:
                for child in element.children:
                    self.draw(child, state)
        elif kind in ("path", "rect", "circle", "ellipse", "line", "polyline", "polygon"):
            self.shape(element, styles, self.styled(element, state, styles))
        self.depth -= 1

    def href(self, element: Element) -> str | None:
        found = element.attributes.get("href", element.attributes.get("xlink:href", ""))
        return found[1:] if found.startswith("#") else None

    def shape(self, element: Element, styles: dict[str, str], state: State) -> None:
        scale = math.sqrt(abs(float(np.linalg.det(state.transform[:2, :2])))) or 1e-9
        path, (vw, vh) = Path(0.05 / scale), self.view
        get = lambda name, r: self.size(element, styles, name, r)
        x_of, y_of = (lambda n: get(n, vw) or 0.0), (lambda n: get(n, vh) or 0.0)
        kind = element.name
        if kind == "path":
            path.data(element.attributes.get("d", ""))
        elif kind == "rect":
            rx, ry = get("rx", vw), get("ry", vh)
            path.rect(x_of("x"), y_of("y"), x_of("width"), y_of("height"), (rx if rx is not None else ry) or 0.0, (ry if ry is not None else rx) or 0.0)
        elif kind == "circle":
            r = get("r", self.diagonal) or 0.0
            path.ellipse(x_of("cx"), y_of("cy"), r, r)
        elif kind == "ellipse":
            path.ellipse(x_of("cx"), y_of("cy"), x_of("rx"), y_of("ry"))
        elif kind == "line":
            path.move((x_of("x1"), y_of("y1")))
            path.line((x_of("x2"), y_of("y2")))
        else:
            path.polyline(element.attributes.get("points", ""), kind == "polygon")
        if not path.lines:
            return
        with np.errstate(all="ignore"):
            every = np.array([p for points, _ in path.lines for p in points])
            box = (*every.min(axis=0), *(every.max(axis=0) - every.min(axis=0)))
            if kind != "line":
                self.add(path.lines, state.rule == "evenodd", self.paint(state.fill, state, box), state.fill_opacity * state.opacity, state)
            if state.width > 0 and state.stroke != ("none",):
                paint = self.paint(state.stroke, state, box)
                if paint is not None and np.isfinite(every).all():
                    self.add(stroked(path.lines, state.width, state.cap, state.join, state.limit, path.tolerance), False, paint, state.stroke_opacity * state.opacity, state)

    def add(self, lines: list, even_odd: bool, paint, opacity: float, state: State) -> None:
        count = sum(len(p) for p, _ in lines)
        if paint is None or not count:
            return
        if count > self.points or len(self.shapes) >= SHAPES:
            self.points = 0
            return
        self.points -= count
        self.shapes.append(Shape([(moved(np.array(p, float), state.transform), closed) for p, closed in lines], even_odd, paint, opacity))

    def paint(self, paint: tuple, state: State, box: tuple) -> tuple | Gradient | None:
        if paint[0] != "url":
            return {"none": None, "current": state.color}.get(paint[0], paint[-1])
        chain, name = [], paint[1]
        while name in self.by_id and len(chain) < 8:
            element = self.by_id[name]
            if element.name not in ("linearGradient", "radialGradient"):
                return paint[2]
            chain.append(element)
            name = self.href(element)
        if not chain:
            return paint[2]
        get = lambda k, default=None: next((e.attributes[k] for e in chain if k in e.attributes), default)
        offsets, colors, low = [], [], 0.0
        for stop in next((s for e in chain if (s := [c for c in e.children if c.name == "stop"])), []):
            styles = styles_of(stop)
            low = max(low, opacity_of(styles.get("offset", stop.attributes.get("offset"))) or 0.0)
            r, g, b, a = parse_color(styles.get("stop-color", "")) or BLACK
            alpha = opacity_of(styles.get("stop-opacity"))
            offsets.append(low)
            colors.append((r, g, b, a if alpha is None else rounded(a * alpha)))
        if len(offsets) < 2:
            return colors[0] if colors else None
        by_box = get("gradientUnits") != "userSpaceOnUse"
        own = parse_transform(get("gradientTransform", ""))
        if by_box:
            own = matrix(max(box[2], 1e-9), 0, 0, max(box[3], 1e-9), box[0], box[1]) @ own
        full = state.transform @ own
        if not abs(np.linalg.det(full)) > 1e-18:
            return colors[-1]
        vw, vh, diagonal = (1.0, 1.0, 1.0) if by_box else (*self.view, self.diagonal)
        value = lambda k, default, r: v if (v := length(get(k), r)) is not None else default * r
        made = Gradient(np.linalg.inv(full), np.array(offsets), np.array(colors, float), get("spreadMethod", "pad"))
        if chain[0].name == "linearGradient":
            start, end = np.array([value("x1", 0.0, vw), value("y1", 0.0, vh)]), np.array([value("x2", 1.0, vw), value("y2", 0.0, vh)])
            made.line = (start, end - start)
        else:
            center, radius = np.array([value("cx", 0.5, vw), value("cy", 0.5, vh)]), value("r", 0.5, diagonal)
            if radius <= 1e-12:
                return colors[-1]
            focus = [v if (v := length(get(k), r)) is not None else c for k, r, c in zip(("fx", "fy"), (vw, vh), center, strict=True)]
            made.circle = (center, radius, np.array(focus))
        return made


def edges_of(lines: list) -> np.ndarray:
    """Rows of (top y, bottom y, x at the top, slope, direction); polylines are closed."""
    parts = []
    for p, _ in lines:
        if len(p) > 1:
            a, z = p, np.roll(p, -1, axis=0)
            down = z[:, 1] > a[:, 1]
            top, bottom = np.where(down[:, None], a, z), np.where(down[:, None], z, a)
            tall = bottom[:, 1] - top[:, 1]
            with np.errstate(all="ignore"):
                rows = np.stack([top[:, 1], bottom[:, 1], top[:, 0], (bottom[:, 0] - top[:, 0]) / tall, np.where(down, 1.0, -1.0)], axis=1)
            parts.append(rows[(tall > 1e-12) & np.isfinite(rows).all(axis=1)])
    return np.concatenate(parts) if parts else np.zeros((0, 5))


def coverage(edges: np.ndarray, even_odd: bool, first: int, rows: int, width: int) -> np.ndarray:
    """Covered part of each pixel of some rows."""
    y = first + (np.arange(rows * SAMPLES) + 0.5) / SAMPLES
    low, high = (np.searchsorted(y, edges[:, k], side="left") for k in (0, 1))
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(edges)), count)
    line = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    x = edges[which, 2] + (y[line] - edges[which, 0]) * edges[which, 3]
    order = np.lexsort((x, line))
    line, x, way = line[order], x[order], edges[which[order], 4].astype(np.int64)
    after = np.cumsum(way)
    starts = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    base = np.repeat((after - way)[starts], np.diff(np.append(np.flatnonzero(starts), len(line))))
    after = after - base
    before = after - way
    inside = (lambda w: w % 2 != 0) if even_odd else (lambda w: w != 0)
    sign = inside(after).astype(float) - inside(before)
    some = sign != 0
    x, row, sign = np.clip(x[some], 0, width), line[some] // SAMPLES, sign[some] / SAMPLES
    at = np.floor(x).astype(np.int64)
    part = x - at
    sums = np.zeros((rows, width + 2))
    np.add.at(sums, (row, at), sign * (1 - part))
    np.add.at(sums, (row, at + 1), sign * part)
    return np.cumsum(sums, axis=1)[:, :width]


def paint_shape(image: np.ndarray, shape: Shape) -> None:
    """Source-over of the shape, straight alpha, rounded to bytes."""
    height, width = image.shape[:2]
    edges = edges_of(shape.lines)
    if shape.opacity <= 0 or not len(edges):
        return
    top, bottom = (int(np.clip(v, 0, height)) for v in (np.floor(edges[:, 0].min()), np.ceil(edges[:, 1].max())))
    for first in range(top, bottom, ROWS_AT_A_TIME):
        rows = min(ROWS_AT_A_TIME, bottom - first)
        near = edges[(edges[:, 1] > first) & (edges[:, 0] < first + rows)]
        cover = coverage(near, shape.even_odd, first, rows, width)
        r, c = np.nonzero(cover > 0.0001)
        if not len(r):
            continue
        source = shape.paint.at(c + 0.5, first + r + 0.5) if isinstance(shape.paint, Gradient) else np.broadcast_to(np.array(shape.paint, float), (len(r), 4))
        under = image[first + r, c].astype(float)
        alpha, below = np.minimum(1, cover[r, c] * shape.opacity) * source[:, 3] / 255, under[:, 3] / 255
        out = alpha + below * (1 - alpha)
        some = alpha > 0
        safe = np.where(out > 0, out, 1)
        mixed = (source[:, :3] * alpha[:, None] + under[:, :3] * (below * (1 - alpha))[:, None]) / safe[:, None]
        new = np.floor(np.clip(np.concatenate([mixed, out[:, None] * 255], axis=1), 0, 255) + 0.5).astype(np.uint8)
        image[first + r[some], c[some]] = new[some]


def root_of(data: bytes) -> Element:
    root = parse_xml(data)
    if root.name != "svg":
        raise invalid("the root element isn't svg")
    return root


def rasterize(data: bytes, width: int | None = None, height: int | None = None, most: int = MOST_PIXELS) -> np.ndarray:
    root = root_of(data)
    w, h = pixel_size(root, width, height, most)
    image = np.zeros((h, w, 4), np.uint8)
    for shape in Scene(root, w, h).shapes:
        paint_shape(image, shape)
    return image


def decode(data: bytes) -> np.ndarray:
    return rasterize(data)


def elements(data: bytes, precision: float = 4.0) -> tuple[float, float, list[dict]]:
    """Width, height and shapes in painting order; strokes as fills. Gradients aren't supported here."""
    root = root_of(data)
    w, h = intrinsic_size(root)
    fine = min(16.0, max(1.0, precision))
    pixels = [max(1, math.floor(x * fine + 0.5)) for x in (w, h)]
    out = []
    for s in Scene(root, *pixels).shapes:
        if isinstance(s.paint, Gradient):
            raise unsupported("gradients as vectors")
        lines = [(p * np.array([w / pixels[0], h / pixels[1]]), closed) for p, closed in s.lines if len(p) > 1]
        if lines:
            paths = [{"points": [{"x": x, "y": y} for x, y in p.tolist()], "is_closed": closed} for p, closed in lines]
            out.append({"even_odd": s.even_odd, **dict(zip("rgba", s.paint, strict=True)), "opacity": min(1.0, max(0.0, s.opacity)), "subpaths": paths})
    return w, h, out
