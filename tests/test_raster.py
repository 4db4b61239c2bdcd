"""Images: bytes written here are read back as grey pixels, for every filter, depth and kind of colour."""

import random
import struct
import zlib

import numpy as np
import pytest

from docmill.functions import raster, udfs


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows, step, kinds):
    """Rows of bytes, each filtered as its kind says, by the definition of the five filters."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        out, above = out + bytes([kind, *line]), row
    return out


def png(samples, depth, colour, kinds, palette=None, width=None):
    """samples: rows of sample values."""
    per = raster.SAMPLES[colour]
    rows = []
    for r in samples:
        bits = "".join(format(v, f"0{depth}b") for v in r)
        bits += "0" * (-len(bits) % 8)
        rows.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    body = zlib.compress(filtered(rows, max(1, per * depth // 8), kinds))
    head = struct.pack(">IIBBBBB", len(samples[0]) // per, len(samples), depth, colour, 0, 0, 0)
    half = len(body) // 2
    return raster.PNG + chunk(b"IHDR", head) + (chunk(b"PLTE", bytes(sum(palette, []))) if palette else b"") + chunk(b"IDAT", body[:half]) + chunk(b"IDAT", body[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,depth", [(c, d) for c, ds in raster.DEPTHS.items() for d in ds])
def test_every_kind_of_png(colour, depth):
    r = random.Random(colour * 100 + depth)
    per, width, height = raster.SAMPLES[colour], 11, 13
    palette = [[r.randrange(256) for _ in range(3)] for _ in range(1 << depth)] if colour == 3 else None
    samples = [[r.randrange(1 << depth) for _ in range(width * per)] for _ in range(height)]
    got = raster.decode_grey(png(samples, depth, colour, [y % 5 for y in range(height)], palette))

    def eight(v):
        return v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1) if depth < 8 else v

    def grey(p):
        if colour == 3:
            p = palette[p[0]]
        elif colour in (2, 6):
            p = [eight(v) for v in p[:3]]
        else:
            return eight(p[0])
        return int(p[0] * 0.299 + p[1] * 0.587 + p[2] * 0.114 + 0.5)

    assert got.tolist() == [[grey(row[x * per : x * per + per]) for x in range(width)] for row in samples]


def test_portable_maps():
    assert raster.decode_grey(b"P5\n# by hand\n2 2\n255\n\x00\x01\xfe\xff").tolist() == [[0, 1], [254, 255]]
    assert raster.decode_grey(b"P5 2 1 65535\n\x00\x00\xff\xff").tolist() == [[0, 255]]
    assert raster.decode_grey(b"P6 1 2 255\n" + bytes([255, 0, 0, 0, 0, 255])).tolist() == [[76], [29]]


def test_what_is_no_image():
    whole = png([[1, 2, 3]] * 3, 8, 0, [0, 1, 2])
    broken = [None, b"", b"GIF89a", whole[:40], whole[:-20], whole.replace(b"IDAT", b"IDAX"), b"P5 2 2 255\n\x00", b"P5 x", raster.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0))]
    assert [raster.decode_grey(x) for x in broken] == [None] * len(broken) and raster.decode_grey(whole) is not None


def test_files_are_read_back_and_measured(spark, tmp_path):
    page = [[(x * 16 + y * 8) % 256 for x in range(16)] for y in range(8)]
    (tmp_path / "a.png").write_bytes(png(page, 8, 0, [y % 5 for y in range(8)]))
    (tmp_path / "b.pgm").write_bytes(b"P5 16 8 255\n" + bytes(sum(page, [])))
    (tmp_path / "c.png").write_bytes(b"no image")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r["path"][-5:]: r for r in raster.grey_images(files).withColumn("p", udfs.pixel_stats("grey", "width", "height")).withColumn("hash", udfs.difference_hash("grey", "width", "height")).collect()}
    a, b = rows["a.png"], rows["b.pgm"]
    assert (a["width"], a["height"], bytes(a["grey"])) == (16, 8, bytes(sum(page, []))) and a["p"] == b["p"] and a["hash"] == b["hash"]
    flat = np.array(page, float)
    assert a["p"]["p2"] == pytest.approx(np.percentile(flat, 2)) and a["p"]["p98"] == pytest.approx(np.percentile(flat, 98))
    assert rows["c.png"]["grey"] is None and rows["c.png"]["width"] is None
