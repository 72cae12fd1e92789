import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.sources import codecs, images


def some(h, w, seed=0, colours=40):
    r = np.random.default_rng(seed)
    table = r.integers(0, 256, (colours, 4)).astype(np.uint8)
    table[:, 3] = 255
    return table[r.integers(0, colours, (h, w))]


def png(w, h, depth, colour, rows, lace=0, more=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, lace)) + more + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(rgba, kinds, unit):
    """PNG rows by filter, byte by byte."""
    h, out, above = len(rgba), b"", None
    for y in range(h):
        row = rgba[y].tobytes()
        above = above or bytes(len(row))
        line = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - unit] if i >= unit else 0, above[i], above[i - unit] if i >= unit else 0
            p = a + b - c
            guess = {0: 0, 1: a, 2: b, 3: (a + b) // 2, 4: min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]}[kinds[y]]
            line.append((v - guess) & 255)
        out += bytes([kinds[y]]) + bytes(line)
        above = row
    return out


@pytest.mark.parametrize("kind", list(codecs.ENCODERS))
@pytest.mark.parametrize("h,w,colours", [(1, 1, 1), (7, 5, 3), (40, 33, 250), (3, 300, 2)])
def test_formats_round_trip(kind, h, w, colours):
    rgba = some(h, w, h, colours)
    if kind == "gif" and colours > 2:
        rgba[0, 0] = 0
    assert (codecs.decode(codecs.ENCODERS[kind](rgba)) == rgba).all()


def test_png_filters_and_depths():
    rgba = np.random.default_rng(1).integers(0, 256, (10, 6, 4)).astype(np.uint8)
    for kinds in ([0, 1, 2, 3, 4, 4, 3, 2, 1, 0], [4] * 10, [1] * 10, [2] * 10):
        assert (codecs.decode_png(png(6, 10, 8, 6, filtered(rgba, kinds, 4))) == rgba).all()
    deep = np.repeat(rgba[:, :, :, None], 2, axis=3).reshape(10, 6, 8)
    assert (codecs.decode_png(png(6, 10, 16, 6, filtered(deep, [3, 4] * 5, 8))) == rgba).all()
    grey = rgba[:, :, 0]
    assert (codecs.decode_png(png(6, 10, 8, 0, filtered(grey, [4] * 10, 1)))[:, :, 1] == grey).all()
    bits = np.packbits(grey > 99, axis=1)
    assert (codecs.decode_png(png(6, 10, 1, 0, filtered(bits, [0] * 10, 1)))[:, :, 2] == np.where(grey > 99, 255, 0)).all()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    table = chunk(b"PLTE", bytes(range(48))) + chunk(b"tRNS", bytes([0, 99]))
    mapped = codecs.decode_png(png(6, 10, 4, 3, filtered(np.array([[0x01, 0x23, 0xF0]] * 10, np.uint8), [0] * 10, 1), more=table))
    assert mapped[3].tolist() == [[0, 1, 2, 0], [3, 4, 5, 99], [6, 7, 8, 255], [9, 10, 11, 255], [45, 46, 47, 255], [0, 1, 2, 0]]
    parts = b"".join(filtered(p, [4] * len(p), 4) for x, y, dx, dy in codecs.PASSES if (p := rgba[y::dy, x::dx]).size)
    assert (codecs.decode_png(png(6, 10, 8, 6, parts, lace=1)) == rgba).all()


def test_other_layouts():
    rgb = some(3, 5, 2)[:, :, :3]
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in rgb)  # rows of 15 bytes and one to fill
    head = lambda h: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, h, 1, 24, 0, 0, 0, 0, 0, 0)
    assert (codecs.decode(head(-3) + rows)[:, :, :3] == rgb).all() and (codecs.decode(head(3) + rows)[::-1, :, :3] == rgb).all()
    tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 5, 3, 24, 0) + rgb[::-1, :, ::-1].tobytes()
    assert (codecs.decode(tga, "x.tga")[:, :, :3] == rgb).all()
    assert (codecs.decode(b"P6 # note\n5 3\n255\n" + rgb.tobytes())[:, :, :3] == rgb).all()
    assert codecs.decode(b"P1\n3 1\n1 0 1")[0, :, 0].tolist() == [0, 255, 0]
    assert codecs.decode(b"P2\n2 1\n15\n15 3")[0, :, 0].tolist() == [255, 51]


@pytest.mark.parametrize("content,why", [(b"", "format"), (b"hello world, this is text", "format"), (b"\xff\xd8\xff\xe0 jpeg", "decoder for jpg"), (b"RIFF0000WEBPVP8 ", "decoder for webp"), (codecs.encode_png(some(9, 9))[:60], "cut off"), (codecs.encode_gif(some(9, 9))[:40], ""), (codecs.encode_bmp(some(9, 9))[:80], ""), (b"P6\n9 9\n255\nxx", "cut off")])
def test_unreadable(content, why):
    with pytest.raises(codecs.Unreadable, match=why):
        codecs.decode(content)


def frame(spark, rgbas):
    rows = [(n, x, y, *map(int, rgba[y, x])) for n, rgba in rgbas.items() for y in range(rgba.shape[0]) for x in range(rgba.shape[1])]
    return spark.createDataFrame(rows, "name string, x int, y int, r int, g int, b int, a int")


def as_arrays(rows):
    out = {}
    for r in rows:
        out.setdefault(os.path.basename(r["path"]), {})[r["x"], r["y"]] = (r["r"], r["g"], r["b"], r["a"])
    return out


@pytest.mark.parametrize("kind", ["png", "bmp", "tga", "gif"])
def test_written_files_are_read_back_both_ways(spark, tmp_path, kind):
    rgbas = {f"im{i}": some(5 + i, 9, i) for i in range(4)}
    out = str(tmp_path / "out")
    images.write_images(frame(spark, rgbas), out, kind)
    assert sorted(os.listdir(out)) == [f"im{i}.{kind}" for i in range(4)]
    with open(f"{out}/broken.{kind}", "wb") as f:
        f.write(b"not an image at all")
    expected = {f"{n}.{kind}": {(x, y): tuple(map(int, rgba[y, x])) for y in range(rgba.shape[0]) for x in range(rgba.shape[1])} for n, rgba in rgbas.items()}
    found, rejected = images.read_images(spark, out)
    assert as_arrays(found.collect()) == expected
    assert [os.path.basename(r["path"]) for r in rejected.collect()] == [f"broken.{kind}"]
    bands = images.read_bands(spark, out, band_rows=3)
    assert as_arrays(bands.where("error IS NULL").collect()) == expected and bands.where("error IS NOT NULL").count() == 1
    if kind == "bmp":
        assert bands.rdd.getNumPartitions() == sum(-(-(5 + i) // 3) for i in range(4)) + 1


def test_large_image_spreads_over_tasks(spark, tmp_path):
    images.write_images(frame(spark, {"big": some(64, 20)}), str(tmp_path / "o"), "bmp")
    bands = images.read_bands(spark, str(tmp_path / "o"), band_rows=8)
    assert bands.select(F.spark_partition_id().alias("p"), "y").distinct().groupBy("p").count().count() == 8


def test_failing_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    good = frame(spark, {f"im{i}": some(4, 4, i) for i in range(6)})
    bad = good.withColumn("x", F.when(F.col("name") == "im4", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        images.write_images(bad, out)
    assert not os.path.exists(out) or os.listdir(out) == []
    images.write_images(good.where("name = 'im1'"), out)
    with pytest.raises(Exception, match="already"):
        images.write_images(good, out)
    assert os.listdir(out) == ["im1.png"]  # nothing of the second job
    images.write_images(good, out, overwrite=True)
    assert len(os.listdir(out)) == 6


def test_buffers_in_memory(spark):
    rgba = some(3, 4, 5)
    pixels = {(x, y): tuple(map(int, rgba[y, x])) for y in range(3) for x in range(4)}
    take = lambda df: {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in df.collect()}
    whole = spark.createDataFrame([(1, 4, 3, bytearray(rgba.tobytes()))], "image_id long, width int, height int, content binary")
    assert take(images.pixels_of_buffers(whole)) == pixels
    rows = spark.createDataFrame([(1, y, bytearray(rgba[y].tobytes())) for y in range(3)], "image_id long, y int, content binary")
    assert take(images.pixels_of_rows(rows)) == pixels
    made = rgba.tobytes()
    assert take(images.pixels_of_callback(whole.drop("content"), lambda image, y, width: made[y * width * 4 : (y + 1) * width * 4])) == pixels
    with pytest.raises(Exception, match="too short"):
        images.pixels_of_buffers(whole.withColumn("height", F.lit(4))).collect()
    with pytest.raises(Exception, match="whole pixels"):
        images.pixels_of_rows(rows.withColumn("content", F.substring("content", 1, 7))).collect()
    indexed = spark.createDataFrame([(1, x, y, x + 4 * y) for x in range(4) for y in range(3)], "image_id long, x int, y int, idx int")
    assert bytes(images.index_buffers(indexed, 12).first()["content"]) == bytes(range(12))
    assert [bytes(r["content"]) for r in images.index_rows(indexed).orderBy("y").collect()] == [bytes(range(4 * y, 4 * y + 4)) for y in range(3)]
    with pytest.raises(Exception, match="too small"):
        images.index_buffers(indexed, 11).collect()
    with pytest.raises(Exception, match="gaps"):
        images.index_rows(indexed.where("x <> 1")).collect()


def test_formats_that_are_known():
    assert images.available()["png"] and images.available()["tga"] and not images.available()["webp"] and not images.available()["jfif"]
