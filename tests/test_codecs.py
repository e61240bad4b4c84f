"""Codecs on images of all shapes, on other writers' layouts, and on damaged files."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.errors import ImageError
from pixelloom.functions import codecs, exif
from pixelloom.functions.codecs import gif, png, tiff

SIZES = [(23, 11), (1, 1), (5, 3), (17, 13), (64, 48)]
LOSSLESS = ("qoi", "png", "tiff", "webp")


def picture(width: int, height: int) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    p = np.dstack([(17 * x + 3 * y) % 256, (x ^ y) * 9 % 256, (x * x + 31 * y) % 256, 255 - (13 * x + y * y) % 200]).astype(np.uint8)
    p[y % 4 == 1] = (12, 140, 220, 255)
    return p


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", ["qoi", "png", "tiff", "webp", "bmp", "netpbm"])
def test_roundtrip(name, size):
    p = picture(*size)
    data = codecs.encode(p, name)
    found, back = codecs.decode(data)
    want = p.copy()
    if name not in LOSSLESS:
        want[..., 3] = 255
    assert codecs.detect(data) == found == name
    assert (back == want).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 9), st.integers(0, 2**32 - 1), st.integers(1, 255))
def test_noise_roundtrip(width, height, seed, spread):
    p = np.random.default_rng(seed).integers(0, spread + 1, (height, width, 4)).astype(np.uint8)
    for name in LOSSLESS:
        assert (codecs.decode(codecs.encode(p, name))[1] == p).all()


@pytest.mark.parametrize("quality,most", [(90, 16), (95, 8)])
def test_jpeg_is_close(quality, most):
    y, x = np.mgrid[:48, :64]
    p = np.dstack([np.minimum(255, 3 * x), np.minimum(255, 4 * y), np.minimum(255, 60 + x + y), np.full_like(x, 255)]).astype(np.uint8)
    back = codecs.decode(codecs.encode(p, "jpeg", quality))[1]
    assert np.abs(back.astype(int) - p).max() <= most


def test_gif():
    y, x = np.mgrid[:25, :40]
    colors = np.random.default_rng(1).integers(0, 255, (7, 3))
    p = np.dstack([colors[(3 * x + y) % 7], np.where((x + y) % 5 == 0, 0, 255)]).astype(np.uint8)
    p[(x + y) % 5 == 0] = 0
    assert (codecs.decode(codecs.encode(p, "gif"))[1] == p).all()
    many = picture(200, 150)
    back = codecs.decode(codecs.encode(many, "gif"))[1]
    assert len(np.unique(back.reshape(-1, 4), axis=0)) <= 256
    noise = np.random.default_rng(2).integers(0, 200, 70_000).tolist()
    assert gif.unpack_lzw(gif.pack_lzw(noise, 8), 8, len(noise)) == noise


def test_sizes():
    flat = np.full((100, 100, 4), 255, np.uint8)
    assert len(codecs.encode(flat, "png")) < 1000
    y, x = np.mgrid[:64, :256]
    gradient = np.dstack([x, y, x ^ 0, np.full_like(x, 255)]).astype(np.uint8)
    assert len(codecs.encode(gradient, "png")) < gradient.size / 8


@pytest.mark.parametrize("color,depth", [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
@pytest.mark.parametrize("interlace", [0, 1])
def test_png_layouts(color, depth, interlace):
    rng = np.random.default_rng(color * 100 + depth)
    width, height, per = 13, 9, png.SAMPLES[color]
    samples = rng.integers(0, min(1 << depth, 16 if color == 3 else 1 << depth), (height, width, per))
    areas = [(0, 0, 1, 1)] if not interlace else [p for p in png.PASSES if p[0] < width and p[1] < height]
    raw = b""
    for x, y, dx, dy in areas:
        part = samples[y::dy, x::dx].reshape(len(range(y, height, dy)), -1)
        for row in part:
            bits = "".join(f"{v:0{depth}b}" for v in row)
            raw += b"\0" + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    chunk = lambda k, c: struct.pack(">I", len(c)) + k + c + struct.pack(">I", zlib.crc32(k + c))
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace))
    data += (chunk(b"PLTE", palette.tobytes()) if color == 3 else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    back = png.decode(data)
    if color == 3:
        assert (back[..., :3] == palette[samples[..., 0]]).all()
    else:
        eight = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
        assert (back[..., 0] == eight[..., 0]).all() and (back[..., 3] == (eight[..., -1] if color in (4, 6) else 255)).all()


def test_png_filters_are_undone():
    p = picture(40, 30)
    lines = np.frombuffer(png.filtered(p), np.uint8).reshape(30, -1)
    assert len(set(lines[:, 0])) > 1
    assert (png.unfilter(lines.reshape(-1), 30, 160, 4).reshape(30, 40, 4) == p).all()


def test_tiff_pack_bits():
    packed = bytes([0xFD, 0x0A, 3, 1, 2, 3, 4])
    assert tiff.unpack_bits(packed, 8) == bytes([10, 10, 10, 10, 1, 2, 3, 4])
    entries = [(256, 4, 1, 4), (257, 4, 1, 2), (258, 3, 1, 8), (259, 3, 1, 32773), (262, 3, 1, 1), (273, 4, 1, 122), (277, 3, 1, 1), (278, 4, 1, 2), (279, 4, 1, 7)]
    data = b"II*\0" + struct.pack("<IH", 8, 9) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4
    data = data.ljust(122, b"\0") + packed
    assert tiff.decode(data)[..., 0].tolist() == [[10, 10, 10, 10], [1, 2, 3, 4]]


@pytest.mark.parametrize("name", ["qoi", "png", "tiff", "bmp", "netpbm", "gif", "jpeg"])
def test_damaged_files_are_errors_or_images(name):
    rng = np.random.default_rng(7)
    good = codecs.encode(picture(17, 13), name)
    from pixelloom.functions.udfs import guarded

    for k in range(150):
        bad = bytearray(good)
        if k % 3 == 0:
            bad = bad[: int(rng.integers(0, len(bad)))]
        else:
            for _ in range(1 + k % 4):
                bad[int(rng.integers(0, len(bad)))] = int(rng.integers(0, 256))
        value, error = guarded(codecs.decode, bytes(bad), name)
        assert (value is None) != (error is None)


def test_unknown_and_unsupported():
    with pytest.raises(ImageError, match="unknownFormat"):
        codecs.decode(b"no image")
    with pytest.raises(ImageError, match="unsupportedFeature"):
        codecs.decode(b"\0\0\0\x18ftypavif\0\0\0\0mif1avif")
    assert codecs.detect(b"\0\0\0\x14ftypheic\0\0\0\0mif1") == "heic"
    with pytest.raises(ImageError, match="unsupportedFeature"):
        codecs.encode(picture(2, 2), "heic")


def sample_exif() -> exif.Exif:
    return exif.Exif({271: (2, "Loom Works"), 272: (2, "LW-7"), 274: (3, [6])}, {33437: (5, [(56, 10)]), 34855: (3, [250])}, {1: (2, "S"), 2: (5, [(12, 1), (34, 1), (30, 1)]), 3: (2, "E"), 4: (5, [(98, 1), (45, 1), (0, 1)])})


def test_exif_roundtrip_and_places():
    block = exif.serialize(sample_exif())
    back = exif.parse(block)
    assert back.tags[274] == (3, [1]) and back.photo == sample_exif().photo and back.gps == sample_exif().gps
    assert exif.degrees(back.gps[2], back.gps[1]) == pytest.approx(-12.575)
    assert exif.degrees(back.gps[4], back.gps[3]) == 98.75
    assert exif.degrees((5, [(1, 0), (0, 1), (0, 1)]), None) is None
    for name in ("png", "jpeg", "webp"):
        assert exif.read(codecs.encode(picture(9, 8), name, metadata=block)).photo == sample_exif().photo


@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientation(orientation):
    p = picture(3, 2)
    block = bytearray(exif.serialize(sample_exif()))
    entry = block.index(struct.pack("<HHI", 274, 3, 1))
    block[entry + 8] = orientation
    turned = codecs.decode(codecs.encode(p, "png", metadata=bytes(block)))[1]
    assert turned.shape[:2] == ((3, 2) if orientation >= 5 else (2, 3))
    corner = {1: (0, 0), 2: (0, 2), 3: (1, 2), 4: (1, 0), 5: (0, 0), 6: (1, 0), 7: (1, 2), 8: (0, 2)}[orientation]
    assert (turned[0, 0] == p[corner]).all()
