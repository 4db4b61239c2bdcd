"""Shared helpers: shared-folder tables, text hashing, and numbering rows without a single-task window."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import shared_folder as shared_dir


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


ROWS_PER_BATCH = 1_024
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, after the session's Arrow batches have been limited to ROWS_PER_BATCH rows: whole texts in batches of
    10 000, the default, need more memory than a small executor has."""
    if int(df.sparkSession.conf.get(_BATCH_KEY)) > ROWS_PER_BATCH:
        df.sparkSession.conf.set(_BATCH_KEY, str(ROWS_PER_BATCH))
    return df


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by integer ``keys``, one table each; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(k[a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def forget(df: DataFrame) -> None:
    """Delete the folder of a table made by :func:`store` that no later step reads."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, so that every engine and Python's ``bytes.lower`` agree."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def number_rows(df: DataFrame, group: list[str], order: list[Column], out: str, size: Column | None = None, per_task: int = 8_192) -> DataFrame:
    """Give the rows of each group a gapless position from 0 (or, with ``size``, the sum of the sizes before the row).

    Rows are dealt by (group, leading bits of a hash of ``order``) to windows of about ``per_task`` rows; the totals of those
    small cells give each cell its offset. So a group with a third of all rows is numbered by many tasks. The order inside a
    group is that of the hash, then of ``order``; rows that agree in everything may swap, which leaves the result unchanged.
    """
    n = df.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / per_task)))))
    h, cell, start = f"__h_{out}", f"__cell_{out}", f"__start_{out}"
    df = df.withColumn(h, F.xxhash64(*order)).withColumn(cell, F.pmod(F.shiftrightunsigned(F.col(h), 64 - bits), F.lit(1 << bits)) if bits else F.lit(0).cast("bigint"))
    size = F.lit(1).cast("bigint") if size is None else size.cast("bigint")
    totals = df.groupBy(*group, cell).agg(F.sum(size).alias("__sum"))
    # A table of (groups x cells) totals; its windows run over cells, of which there is one for every per_task rows.
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, cell, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(start))
    keys = [*group, cell]
    within = Window.partitionBy(*keys).orderBy(h, *order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(size).over(within), F.lit(0).cast("bigint")))
    right = totals.select(*[F.col(k).alias(f"__r_{k}") for k in keys], start)
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return df.join(right, on, "left").withColumn(out, F.col(out) + F.col(start)).drop(h, cell, start, *[f"__r_{k}" for k in keys])


# --- hashing words of a whole batch of texts at once -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_BLOCK = 1 << 19
#: Bytes that are no part of the words that :mod:`search` and :mod:`decontam` take: ASCII but for digits and letters.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def hash_words(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another in ``buf``: runs of bytes that are not among ``gaps``,
    which are ``[\\x20\\x09-\\x0D]`` unless others are given.

    ``offsets`` has the start of each text and the end of the last. A-Z count as a-z. Returns the hashes in order and, for
    each text, how many words it has. A word's hash is a polynomial in its bytes modulo 2**64, mixed.
    """
    global _UP, _DOWN
    counts = np.zeros(len(offsets) - 1, np.int64)
    parts: list[np.ndarray] = []
    i = 0
    while i < len(offsets) - 1:  # blocks of whole texts, so that the temporaries stay small
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if b > a:
            x = _LOWER[buf[a:b]]
            word = ~gaps[x]
            first = word.copy()
            first[1:] &= ~word[:-1]
            cuts = (offsets[i:j] - a)[offsets[i:j] < b]
            first[cuts] = word[cuts]
            last = word.copy()
            last[:-1] &= ~word[1:]
            ends = offsets[i + 1 : j + 1] - a - 1
            ends = ends[ends >= 0]
            last[ends] = word[ends]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if _UP is None or len(_UP) < b - a + 1:
                _UP, _DOWN = powers(BASE, max(_BLOCK, b - a) + 1), powers(INVERSE, max(_BLOCK, b - a) + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[x] * _UP[: b - a], out=sums[1:])
            parts.append(mix((sums[e] - sums[s]) * _DOWN[s]))
            counts[i:j] = np.diff(np.searchsorted(s, offsets[i : j + 1] - a))
        i = j
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and where its texts begin and end (nulls: empty)."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def word_blocks(batches: Iterator[pa.RecordBatch], text: int, gaps: np.ndarray, most_words: int, most_rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, word hashes, words of each row) of runs of rows that have at most so many words and rows together, or of a single
    row that has more words. The text is column ``text``, which the rows no longer have."""
    rows, hashes, counts, words, n = [], [], [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            h, c = hash_words(*text_buffer(part.column(text)), gaps)
            part = pa.Table.from_batches([part]).remove_column(text)
            ends = np.cumsum(c)
            first = 0
            while first < len(c):
                done = int(ends[first - 1]) if first else 0
                last = int(np.searchsorted(ends, done + most_words - words, "right"))
                last = min(max(last, first), first + most_rows - n, len(c))
                if last == first and not n:
                    last = first + 1
                if last > first:
                    rows.append(part.slice(first, last - first))
                    hashes.append(h[done : int(ends[last - 1])])
                    counts.append(c[first:last])
                    words, n = words + len(hashes[-1]), n + last - first
                    first = last
                if first < len(c):
                    yield pa.concat_tables(rows), np.concatenate(hashes), np.concatenate(counts)
                    rows, hashes, counts, words, n = [], [], [], 0, 0
    if rows:
        yield pa.concat_tables(rows), np.concatenate(hashes), np.concatenate(counts)


def item_blocks(items: DataFrame, item_id: str, text: str, gaps: np.ndarray, most: int) -> Iterator[pa.Table]:
    """(item, words) of all ``items`` with words, hashed, in blocks that come to the driver one at a time.

    A block has at most ``most`` words besides those of its last item, however many items there are.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = hash_words(*text_buffer(batch.column(1)), gaps)
            edges = np.concatenate([[0], np.cumsum(n)])
            words = pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), words], names=["item", "n", "words"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = small_batches(items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text"))).mapInArrow(hashed, f"item {kind}, n bigint, words binary").where("n > 0")
    placed = number_rows(store(rows, "items"), [], [F.col("item").cast("string"), F.col("words")], "before", F.col("n"))
    placed = store(placed.withColumn("block", F.expr(f"before div {most}")), "items")
    for block in range((placed.agg(F.max("block")).first()[0] or 0) + 1):
        table = placed.where(F.col("block") == block).orderBy("before").select("item", "words").toArrow()
        if table.num_rows:
            yield table
