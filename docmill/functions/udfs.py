"""Functions that Spark's built-ins cannot express, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from difflib import SequenceMatcher
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from . import text as T


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        return 1.0 if not x and not y else 0.0 if not x or not y else round(SequenceMatcher(None, x, y).ratio(), 4)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two receipt texts after normalising, four decimals; both empty 1, one empty 0."""
    return _ratio(T.receipt_text(a), T.receipt_text(b))


def hashed_embedding(s: Column, dimensions: int = 384) -> Column:
    """A text's tokens, each hashed to one of the dimensions with a sign, scaled to length 1; zeros for a text without tokens."""

    @pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:  # eight bytes a number; a list of Python's numbers takes four times as many
            v = np.zeros(dimensions)
            for token in re.findall(r"\w+", (t or "").lower()):
                d = hashlib.blake2b(token.encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "big") % dimensions] += 1.0 if d[4] % 2 else -1.0
            n = sqrt(float((v * v).sum()))
            return v / n if n else v

        return texts.map(one)

    return embed(s)


@pandas_udf(StringType())
def json_block(s: pd.Series) -> pd.Series:
    """The first balanced ``{…}`` of a text, a fenced block before the rest; braces in strings do not count; null without one."""

    def one(t: str | None) -> str | None:
        t = t or ""
        fence = re.search(r"```(?:json)?\s*(.*?)```", t, re.S)
        for part in ([fence.group(1)] if fence else []) + [t]:
            depth, start, quoted, skip = 0, -1, False, False
            for i, c in enumerate(part):
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"' and depth:
                    quoted = True
                elif c == "{":
                    start = i if not depth else start
                    depth += 1
                elif c == "}" and depth:
                    depth -= 1
                    if not depth:
                        return part[start : i + 1]
        return None

    return s.map(one)


@pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """The text of a word-processor file; null for what is none, is over 50 MB unpacked, or unpacks over 200 times its size."""

    def one(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                info = z.getinfo("word/document.xml")
                if info.file_size > 50 << 20 or info.file_size > 200 * max(1, info.compress_size):
                    return None
                xml = z.read(info).decode("utf-8", "ignore")
        except (zipfile.BadZipFile, KeyError):
            return None
        return " ".join(re.sub(r"<[^>]+>", " ", xml).split())

    return content.map(one)


@pandas_udf(StringType())
def difference_hash(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """64 bits in hexadecimal: of the grey image averaged to 9 x 8 cells, whether each is brighter than its right neighbour."""

    def one(raw: bytes, w: int, h: int) -> str | None:
        if not raw or w < 9 or h < 8 or len(raw) < w * h:
            return None
        a = np.frombuffer(raw, np.uint8, w * h).reshape(h, w).astype(float)
        rows = np.add.reduceat(a, np.linspace(0, h, 8, endpoint=False).astype(int), axis=0)
        cells = np.add.reduceat(rows, np.linspace(0, w, 9, endpoint=False).astype(int), axis=1)
        n = np.outer(np.diff(np.r_[np.linspace(0, h, 8, endpoint=False).astype(int), h]), np.diff(np.r_[np.linspace(0, w, 9, endpoint=False).astype(int), w]))
        cells = cells / n
        return f"{int(''.join('1' if x else '0' for x in (cells[:, :-1] > cells[:, 1:]).ravel()), 2):016x}"

    return pd.Series([one(r, _side(w), _side(h)) for r, w, h in zip(pixels, width, height, strict=True)])


def _side(x: float) -> int:
    """A width or height; 0 for a null, which no image has."""
    return 0 if pd.isna(x) else int(x)


@pandas_udf(StructType([StructField(k, DoubleType()) for k in ("variance", "noise", "p2", "p98")]))
def pixel_stats(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Of a grey image: variance of the Laplacian, mean deviation from its 3 x 3 blur, 2nd and 98th percentile."""

    def one(raw: bytes, w: int, h: int) -> tuple:
        if not raw or w < 3 or h < 3 or len(raw) < w * h:
            return (None, None, None, None)
        a = np.frombuffer(raw, np.uint8, w * h).reshape(h, w).astype(float)
        inner = a[1:-1, 1:-1]
        laplace = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * inner
        blur = sum(a[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3)) / 9
        return (laplace.var(), np.abs(inner - blur).mean(), *np.percentile(a, [2, 98]))

    return pd.DataFrame([one(r, _side(w), _side(h)) for r, w, h in zip(pixels, width, height, strict=True)], columns=["variance", "noise", "p2", "p98"])


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes of 16 hexadecimal digits differ."""
    half = lambda s, i: F.conv(F.substring(s, i, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
