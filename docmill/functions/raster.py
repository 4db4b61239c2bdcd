"""Grey images from the bytes of PNG and of portable grey and colour maps."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: The first bytes of a PNG file; samples a pixel by colour type; weights of red, green and blue in grey.
PNG = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
LUMA = (0.299, 0.587, 0.114)
MOST_PIXELS = 1 << 28  # a larger image is taken for a broken one


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Rows of (red, green, blue) bytes as grey bytes, rounded."""
    return np.floor(rgb[..., 0] * LUMA[0] + rgb[..., 1] * LUMA[1] + rgb[..., 2] * LUMA[2] + 0.5).clip(0, 255).astype(np.uint8)


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """The rows of a PNG image, each after the byte that says how it was filtered: none, by the pixel before (``step`` bytes), by the
    row above, by the mean of both, or by the nearest of both and the corner to their sum less the corner."""
    kinds, rows = raw[:, 0], raw[:, 1:].astype(np.uint8)
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = row + above
        elif kind in (3, 4):
            now = np.zeros_like(row)
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            for x in range(0, len(row), step):
                up = above[x : x + step].astype(np.int64)
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    near = left + up - corner
                    a, b, c = np.abs(near - left), np.abs(near - up), np.abs(near - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (row[x : x + step] + guess) & 255, up
                now[x : x + step] = left
        else:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = now
    return out


def _samples(rows: np.ndarray, count: int, depth: int) -> np.ndarray:
    """``count`` samples a row of packed bytes."""
    if depth == 8:
        return rows[:, :count]
    if depth == 16:
        return rows[:, 0 : 2 * count : 2]  # the upper byte is the sample to 8 bits
    bits = np.unpackbits(rows, axis=1)[:, : count * depth].reshape(len(rows), count, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)


def _png(data: bytes) -> np.ndarray:
    at, palette, body, head = len(PNG), None, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is cut or broken")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or depth not in DEPTHS[colour] or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("not read: interlaced, of an unknown kind, or too large")
    per = SAMPLES[colour]
    line = (width * per * depth + 7) // 8
    flat = zlib.decompressobj().decompress(b"".join(body), height * (line + 1))
    rows = unfiltered(np.frombuffer(flat, np.uint8).reshape(height, line + 1), max(1, per * depth // 8))
    x = _samples(rows, width * per, depth).reshape(height, width, per)
    if colour == 3:
        return grey_of(palette[x[..., 0]].astype(np.float64))
    if colour in (2, 6):
        return grey_of(x[..., :3].astype(np.float64))
    grey = x[..., 0]
    return (grey.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8) if depth < 8 else grey


def _portable(data: bytes) -> np.ndarray:
    """P5 and P6: three numbers after the mark, comments between them left out, then samples of one or two bytes."""
    numbers, at = [], 2
    while len(numbers) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height, most = numbers
    per, kind = (1 if data[:2] == b"P5" else 3), (np.dtype(np.uint8) if most < 256 else np.dtype(">u2"))
    if not 0 < width * height <= MOST_PIXELS or not 0 < most < 65_536:
        raise ValueError("too large, or without a range")
    x = np.frombuffer(data, kind, width * height * per, at + 1).reshape(height, width, per).astype(np.float64) * 255 / most
    return grey_of(x) if per == 3 else np.floor(x[..., 0] + 0.5).astype(np.uint8)


def decode_grey(data: bytes | None) -> np.ndarray | None:
    """A matrix of grey bytes; None for what is no image that is read here."""
    try:
        if data and data[: len(PNG)] == PNG:
            return _png(data)
        if data and data[:2] in (b"P5", b"P6"):
            return _portable(data)
    except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
        pass
    return None


def grey_images(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``width``, ``height`` and ``grey`` (bytes, row by row) to files, such as those that ``binaryFile`` reads; null where ``content`` is no
    image. Columns of these names are replaced."""
    rows = files.drop("width", "height", "grey")
    schema = StructType([*rows.schema.fields, StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("grey", BinaryType())])
    at = rows.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                images = [decode_grey(x) for x in part.column(at).to_pylist()]
                sides = [(None, None) if x is None else x.shape for x in images]
                new = [pa.array([w for _, w in sides], pa.int32()), pa.array([h for h, _ in sides], pa.int32()), pa.array([None if x is None else x.tobytes() for x in images], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "width", "height", "grey"])

    return rows.mapInArrow(run, schema)


@pandas_udf(BinaryType())
def portable_grey(grey: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Grey bytes as a portable grey map."""
    return pd.Series([None if g is None else b"P5 %d %d 255\n" % (w, h) + bytes(g) for g, w, h in zip(grey, width, height, strict=True)])
