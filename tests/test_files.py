"""Files in, in batch and as a stream."""

import numpy as np
from pyspark.sql import functions as F

from pixelloom.errors import ImageError
from pixelloom.functions import codecs, exif, udfs
from pixelloom.functions.codecs import heif, info
from pixelloom.sources import files
from pixelloom.streaming import images


def put(folder):
    p = np.arange(60, dtype=np.uint8).reshape(3, 5, 4)
    for name in ("png", "qoi", "bmp"):
        (folder / f"one.{name}").write_bytes(codecs.encode(p, name))
    (folder / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nrest")


def test_batch(spark, tmp_path):
    put(tmp_path)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert rows["one.png"].r == rows["one.qoi"].r == list(range(0, 60, 4))
    assert rows["one.bmp"].format == "bmp" and rows["bad.png"].error.code == "invalidData"


def test_most_pixels(spark, tmp_path):
    big = np.full((4097, 4096, 4), 7, np.uint8)
    assert codecs.decode(codecs.encode(big, "bmp"))[1].shape == big.shape
    put(tmp_path)
    read = lambda most: {r.path.rsplit("/", 1)[1]: r.error and r.error.code for r in files.read_images(spark, str(tmp_path), most=most).collect()}
    assert read(15)["one.png"] is None and read(14)["one.png"] == "invalidDimensions"


def test_images_go_to_the_jvm_in_parts(spark):
    images = [np.full((n, 900, 4), n % 256, np.uint8) for n in (1, 2500, 3, 2500, 2500, 2)]
    rows = spark.createDataFrame([(k, codecs.encode(p, "bmp")) for k, p in enumerate(images)], "k int, content binary").coalesce(1)
    got = udfs.decoded(rows).select("k", "height", F.size("r").alias("n"), F.array_min("r").alias("low"), F.array_max("r").alias("high")).collect()
    assert [(r.k, r.height, r.n, r.low, r.high) for r in got] == [(k, p.shape[0], p.shape[0] * 900, p[0, 0, 0], p[0, 0, 0]) for k, p in enumerate(images)]


def test_stream(spark, tmp_path):
    put(tmp_path)
    stream = images.stream_images(spark, str(tmp_path))
    q = stream.select("format", "error.code").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found").count() == 4
    assert images.counts_by_time(stream).isStreaming


def test_zlib(spark):
    rows = spark.createDataFrame([(b"",), (b"hello" * 1000,), (bytes(range(256)) * 300,)], "b binary")
    back = rows.select("b", udfs.decompress(udfs.compress("b")).alias("d")).collect()
    assert all(r.b == r.d.content and r.d.error is None for r in back)
    bad = spark.createDataFrame([(b"junk!!",), (b"\x78\x9c\x03",)], "b binary").select(udfs.decompress("b").alias("d")).collect()
    assert all(r.d.error is not None for r in bad)
    one = spark.createDataFrame([(b"123456789",)], "b binary").select(F.crc32("b").alias("c"), udfs.adler32(F.col("b")).alias("a")).first()
    assert (one.c, one.a) == (0xCBF43926, 0x091E01DE)


def test_write_images(spark, tmp_path):
    rows = [(k, 5, 3, *[[(k * 7 + 3 * i + c) % 256 for i in range(15)] for c in range(3)], [255] * 15, exif.serialize(exif.Exif({271: (2, f"M{k}")}, {}, {}))) for k in range(6)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>, block binary").repartition(3)
    for name in ("png", "webp", "jpeg"):
        folder = tmp_path / name
        written = files.write_images(df, f"file://{folder}", name, metadata="block").collect()
        assert len(written) == 6 and all(r.error is None and r.length > 0 for r in written)
        assert sorted(x.name for x in folder.iterdir()) == [f"{k}.{files.EXTENSIONS.get(name, name)}" for k in range(6)]
        assert all(exif.read((folder / f"{k}.{files.EXTENSIONS.get(name, name)}").read_bytes()).tags[271] == (2, f"M{k}") for k in range(6))
    back = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path / "png")).collect()}
    assert all(back[f"{k}.png"].r == rows[k][3] for k in range(6))
    failed = files.write_images(df, str(tmp_path / "none"), "heic").collect()
    assert {r.error.code for r in failed} == {"unsupportedFeature"} and {r.path for r in failed} == {None}


def test_containers():
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    infe = lambda n, kind: box(b"infe", b"\2\0\0\0" + n.to_bytes(2, "big") + b"\0\0" + kind + b"\0")
    grid = b"\0\0\1\2" + (50).to_bytes(2, "big") + (30).to_bytes(2, "big")
    iloc = box(b"iloc", b"\1\0\0\0" + b"\x44\x00" + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"\0\1\0\0\0\1" + bytes(4) + (8).to_bytes(4, "big") + (2).to_bytes(2, "big") + b"\0\0\0\0\0\1" + bytes(4) + (4).to_bytes(4, "big"))
    clap = np.array([41, 1, 20, 1, 0, 1, -3, 1], ">i4").tobytes()
    props = box(b"ipco", box(b"clap", clap) + box(b"irot", b"\1") + box(b"auxC", bytes(4) + b"urn:alpha\0"))
    ipma = box(b"ipma", bytes(4) + (2).to_bytes(4, "big") + b"\0\1\2\1\2" + b"\0\x09\1\3")
    refs = box(b"iref", bytes(4) + box(b"dimg", b"\0\1\0\6" + b"".join(k.to_bytes(2, "big") for k in range(2, 8))) + box(b"auxl", b"\0\x09\0\1\0\1"))
    meta = box(b"meta", bytes(4) + box(b"pitm", bytes(4) + b"\0\1") + box(b"iinf", bytes(4) + b"\0\3" + infe(1, b"grid") + infe(2, b"hvc1") + infe(9, b"hvc1")) + iloc + refs + box(b"iprp", props + ipma) + box(b"idat", grid))
    data = box(b"ftyp", b"heic\0\0\0\0mif1") + meta
    found = info.describe(data)
    assert found == {"format": "heic", "item_type": "grid", "tiles": [2, 3, 4, 5, 6, 7], "alpha": 9, "rows": 2, "columns": 3, "width": 20, "height": 41, "turns": 1, "mirror": None}
    c = heif.parse(data)
    assert c.item(1) == grid and c.item(2) == data[:4] and c.item(9) is None and c.property(2, "irot") == b"\1" and c.property(9, "irot") is None
    assert heif.clean_aperture(50, 30, clap) == (4, 2, 41, 20) and heif.clean_aperture(40, 30, clap) == (0, 0, 40, 30)
    for k in range(len(data)):  # damage is an error and nothing else
        bad = bytearray(data)
        bad[k] ^= 0x5A
        for broken in (bytes(bad), data[:k]):
            try:
                heif.describe(broken)
            except ImageError:
                pass
