"""SVG documents: pixels of shapes on whole coordinates, areas of others, sizes, colours, gradients, hostile input."""

import time

import numpy as np
import pytest

from pixelloom.errors import ImageError
from pixelloom.functions.codecs import svg


def draw(body, size='width="20" height="20"', **more):
    return svg.rasterize(f"<svg {size}>{body}</svg>".encode(), **more)


def area(image):
    return image[..., 3].sum() / 255


def test_rectangles_and_rules():
    a = draw('<rect x="2" y="1" width="5" height="4" fill="#0a141e"/>')
    assert (a[1:5, 2:7] == (10, 20, 30, 255)).all() and area(a) == 20
    assert area(draw('<path d="M1 1h8v8h-8z M3 3h4v4h-4z"/>')) == 64
    assert area(draw('<path d="M1 1h8v8h-8z M3 3h4v4h-4z" style="fill-rule: evenodd"/>')) == 48
    assert area(draw('<path d="M1 1h8v8h-8z M3 3v4h4v-4z"/>')) == 48  # the other way round
    assert area(draw('<rect x="0.5" y="0.25" width="1" height="1" fill="black"/>')) == pytest.approx(1, abs=0.02)
    assert area(draw('<polygon points="0,0 10,0 10 10 0 10"/><polyline points="10,10 12,10 12,12 10,12"/>')) == 104
    assert area(draw('<rect width="4" height="4" display="none"/><rect width="3" height="3" visibility="hidden"/>')) == 0
    assert area(draw('<path d="m1 1 2 0 0 2 -2 0z l5 0"/><path d="M9,9 h2 v2 h-2 q"/>')) == 8


def test_curves():
    for r in (4, 9):
        assert area(draw(f'<circle cx="10" cy="10" r="{r}"/>')) == pytest.approx(np.pi * r * r, rel=0.02)
    assert area(draw('<ellipse cx="10" cy="10" rx="8" ry="3"/>')) == pytest.approx(np.pi * 24, rel=0.02)
    assert area(draw('<rect width="20" height="10" rx="5"/>')) == pytest.approx(100 + np.pi * 25, rel=0.02)
    assert area(draw('<path d="M2 10A8 8 0 0 1 18 10z"/>')) == pytest.approx(np.pi * 32, rel=0.02)
    assert area(draw('<path d="M2 10a8 8 0 1018 0z"/>', 'width="40" height="40"')) > 100  # flags without spaces
    assert area(draw('<path d="M0 0C0 10 20 10 20 0z"/>')) == pytest.approx(120, rel=0.02)  # 3/5 of the box of control points
    assert area(draw('<path d="M0 0Q10 20 20 0z"/>')) == pytest.approx(400 / 3, rel=0.02)
    assert area(draw('<path d="M0 10Q5 0 10 10T20 10z"/>')) == pytest.approx(2 * 100 / 3, rel=0.03)


def test_strokes():
    line = '<line x1="5" y1="10" x2="15" y2="10" stroke="red" stroke-width="4" stroke-linecap="{}"/>'
    assert area(draw(line.format("butt"))) == 40 and area(draw(line.format("square"))) == 56
    assert area(draw(line.format("round"))) == pytest.approx(40 + 4 * np.pi, rel=0.02)
    box = '<rect x="5" y="5" width="10" height="10" fill="none" stroke="red" stroke-width="2" stroke-linejoin="{}"/>'
    assert area(draw(box.format("miter"))) == 144 - 64
    assert area(draw(box.format("bevel"))) == pytest.approx(80 - 4 * 0.5, abs=0.1)
    assert area(draw(box.format("round"))) == pytest.approx(80 - 4 + np.pi, rel=0.02)
    sharp = '<polyline points="2,18 10,4 18,18" fill="none" stroke="red" stroke-width="2" stroke-miterlimit="{}"/>'
    assert area(draw(sharp.format(10))) > area(draw(sharp.format(1))) + 0.5
    assert area(draw('<path d="M10 10z" stroke="red" stroke-width="4" stroke-linecap="square"/>')) == 16


def test_structure_and_styles():
    a = draw('<g id="a" transform="translate(2 3)" opacity="50%"><rect width="2" height="2" fill="currentColor" color="lime"/></g><use href="#a" x="4"/>')
    assert (a[3, 2] == (0, 255, 0, 128)).all() and (a[4, 7] == a[3, 2]).all() and (a[..., 3] > 0).sum() == 8
    a = draw('<g fill="red"><rect width="1" height="1" style="fill:blue"/><rect x="1" width="1" height="1"/></g>')
    assert a[0, 0].tolist() == [0, 0, 255, 255] and a[0, 1].tolist() == [255, 0, 0, 255]
    assert area(draw('<switch><rect systemLanguage="x" width="9" height="9"/><rect width="2" height="2"/><rect width="5" height="5"/></switch>')) == 4
    assert area(draw('<svg x="5"><rect x="50%" width="1em" height="1"/></svg>')) == 5
    assert area(draw('<defs><rect width="9" height="9"/></defs><!-- <rect width="9" height="9"/> --><![CDATA[<rect width="9"/>]]><rect width="1" height="&#50;"></other>')) == 2
    over = draw('<rect width="1" height="1" fill="white"/><rect width="1" height="1" fill="rgba(0,0,0,0.5)"/>')
    assert over[0, 0].tolist() == [127, 127, 127, 255]
    latin = "<svg width='1' height='1'><title>é</title><rect width='1' height='1'/></svg>".encode("latin-1")
    assert area(svg.rasterize(latin)) == 1
    assert area(draw('<rect width="2" height="3" transform="rotate(90) matrix(1 0 0 1 0 -5) scale(2,1)"/>')) == 12
    assert area(draw('<rect width="4" height="4" transform="skewX(45)"/>')) == pytest.approx(16, abs=0.1)


@pytest.mark.parametrize(
    "text,want",
    [("#abc", (170, 187, 204, 255)), ("#abcd", (170, 187, 204, 221)), ("#01020304", (1, 2, 3, 4)), ("rgb(10%, 20 , 300)", (26, 20, 255, 255)), ("rgba(1,2,3,.5)", (1, 2, 3, 128)), ("hsl(120,100%,25%)", (0, 128, 0, 255)),
     ("hsl(0,0%,50%)", (128, 128, 128, 255)), ("hsla(240, 100%, 50%, 50%)", (0, 0, 255, 128)), ("RebeccaPurple", (102, 51, 153, 255)), ("transparent", (0, 0, 0, 0)), ("#12", None), ("nothing", None)],
)
def test_colors(text, want):
    assert svg.parse_color(text) == want


def test_paints_and_gradients():
    assert svg.parse_paint("url( '#a' ) red") == ("url", "a", (255, 0, 0, 255)) and svg.parse_paint("none") == ("none",) and svg.parse_paint("") is None
    stops = '<stop offset="0" stop-color="black"/><stop offset="100%" stop-color="white"/>'
    row = draw(f'<linearGradient id="g">{stops}</linearGradient><rect width="100" height="1" fill="url(#g)"/>', 'width="100" height="1"')[0, :, 0]
    assert (row == np.floor(255 * (np.arange(100) + 0.5) / 100 + 0.5)).all()
    row = draw(f'<linearGradient id="h">{stops}</linearGradient><linearGradient id="g" href="#h" gradientUnits="userSpaceOnUse" x2="25" spreadMethod="reflect"/><rect width="100" height="1" fill="url(#g)"/>', 'width="100" height="1"')[0, :, 0]
    row = row.astype(int)
    assert np.abs(row[:25] - row[25:50][::-1]).max() <= 1 and np.abs(row[:50] - row[50:]).max() <= 1 and row[24] == 250
    disc = draw(f'<radialGradient id="g">{stops}</radialGradient><rect width="21" height="21" fill="url(#g)"/>', 'width="21" height="21"')[..., 0]
    assert disc[10, 10] == 0 and disc[0, 0] == 255 and (disc == disc.T).all() and disc[10, 15] == round(255 * 5 / 10.5)
    assert area(draw('<linearGradient id="g"/><rect width="5" height="5" fill="url(#g)"/>')) == 0
    assert draw('<rect width="5" height="5" fill="url(#none) blue"/>')[0, 0].tolist() == [0, 0, 255, 255]
    one = '<linearGradient id="g"><stop stop-color="red" stop-opacity="0.5"/></linearGradient><rect width="5" height="5" fill="url(#g)"/>'
    assert draw(one)[0, 0].tolist() == [255, 0, 0, 128]


def test_sizes():
    size = lambda head, **k: svg.pixel_size(svg.parse_xml(f"<svg {head}/>".encode()), **k)
    assert size("") == (300, 150) and size('width="1in" height="2.54cm"') == (96, 96) and size('width="50%" viewBox="0 0 30 60"') == (30, 60)
    assert size('height="10" viewBox="0 0 30 60"') == (5, 10) and size('width="10" height="20"', width=5) == (5, 10) and size('width="10"', width=7, height=9) == (7, 9)
    with pytest.raises(ImageError, match="invalidDimensions"):
        size('width="0.2" height="9"')
    w, h = size('width="1e9" height="0.5"', most=2**20)
    assert w * h <= 2**20 and h == 1
    for head, box in (('viewBox="0 0 10 10"', (5, 15)), ('viewBox="0 0 10 10" preserveAspectRatio="xMinYMid"', (0, 10)), ('viewBox="0 0 10 10" preserveAspectRatio="xMaxYMid"', (10, 20)), ('viewBox="0 0 10 10" preserveAspectRatio="none"', (0, 20))):
        columns = np.flatnonzero(draw('<rect width="10" height="10"/>', head, width=20, height=10)[5, :, 3])
        assert (columns[0], columns[-1] + 1) == box
    assert area(draw('<rect width="10" height="10"/>', 'viewBox="0 0 10 10" preserveAspectRatio="xMidYMid slice"', width=20, height=10)) == 200


def test_elements():
    w, h, found = svg.elements(b'<svg width="30" height="10"><rect width="3" height="2" fill="red" stroke="blue" opacity="0.5"/><path d="M1 1"/></svg>')
    assert (w, h) == (30, 10) and [(e["r"], e["b"], e["opacity"]) for e in found] == [(255, 0, 0.5), (0, 255, 0.5)]
    assert [tuple(p.values()) for p in found[0]["subpaths"][0]["points"]] == [(0, 0), (3, 0), (3, 2), (0, 2)] and found[0]["subpaths"][0]["is_closed"]
    with pytest.raises(ImageError, match="unsupported"):
        svg.elements(b'<svg><linearGradient id="g"><stop/><stop/></linearGradient><rect width="3" height="2" fill="url(#g)"/></svg>')


def test_hostile():
    started = time.time()
    levels = "".join(f'<g id="l{k}">' + f'<use href="#l{k - 1}"/>' * 10 + "</g>" for k in range(1, 14))
    draw('<g id="l0"/>' + levels)
    draw('<g id="a"><use href="#a"/><rect width="1" height="1"/></g>')
    draw('<path d="M0 0C1e300 1e300 -1e300 1e300 1e18 0 1e200 5 5 5 5 5" stroke="red" stroke-width="1e9"/><circle r="1e308"/><rect width="1e400" height="nan"/>')
    draw('<polyline stroke-linejoin="round" stroke-width="1e6" stroke="red" points="' + " ".join(f"{k % 7},{k % 5}" for k in range(50000)) + '"/>')
    draw('<g transform="scale(0)"><circle r="5" stroke="red"/></g>')
    for bad in (b"", b"<html></html>", b"<svg", b"</svg>", b"<svg>" * 300, b"<svg><g>"):
        with pytest.raises(ImageError):
            svg.rasterize(bad)
    assert time.time() - started < 60
