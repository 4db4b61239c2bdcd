"""Stupid-backoff scores, computed relationally: n-gram count tables partitioned by hash, joined to exploded n-grams, summed per document.

S(w | context) is c(context w) / c(context .) for the longest context at hand (at most ``order`` - 1 words) for which
c(context w) is at least ``min_count``; every word by which the context had to be cut costs a factor alpha. Without a context
it is c(w) / N. c(context .) counts how often the context is followed by a word. All counts are over all documents given, and
all words of every text count. Each log score is rounded to a multiple of 1 / UNIT, so that a document's sum is exact and does
not depend on the order or the partitions in which rows arrive.

The tables, all written to the shared folder or dealt by hash:

* *tokens*: a row for each block of documents (about BLOCK_WORDS words): their ids, the block's vocabulary and coded words;
* *n-grams*: tokens exploded to the distinct n-grams of each block with their number there, dealt by ranges of a 64-bit hash;
* *counts*: the sums of these for each n-gram of the corpus, kept in the same partitions (n-grams under min_count are pruned);
* *answers*: counts joined to the n-grams of each block, in the order in which the block's n-grams are sorted.

As a block asks for each of its n-grams once, however often it occurs there, an n-gram that makes up a third of all text is
one number a block, like any other: no range of the hash gets a hot key. Rows hold arrays, not single n-grams, to keep what
is shuffled small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, forget, hash_words, mix, small_batches, store, text_buffer

ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
UNIT = 1 << 24  # log scores are multiples of 1 / UNIT
BLOCK_WORDS = 3_000_000  # words of a block, about; a longer document is a block of its own
BUCKET_WORDS = 1_000_000  # words of a range of the hash, about

COLUMNS = "abcdefgh"
CELL = "block bigint, cell bigint, words bigint, " + ", ".join(f"{c} binary" for c in COLUMNS)
TOKENS, COUNTS = -1, -1  # the cell of a row of tokens, the block of a row of counts


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """An Arrow binary array: piece i is ``data[edges[i] : edges[i + 1]]``."""
    width = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _array(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of a binary column as one array, and the length of each."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(off) // np.dtype(kind).itemsize


def _planes(x: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """Numbers as their lowest bytes, the next four bytes, and the rest, which is there only where it is not 0. Most numbers are small,
    and planes of zeros take no space once compressed."""
    x = x.astype(np.uint64)
    rest = (x >> np.uint64(40)).astype(np.uint32)
    some = bool(rest.any())
    return [_binary(x.astype(np.uint8), edges), _binary((x >> np.uint64(8)).astype(np.uint32), edges), _binary(rest if some else rest[:0], edges if some else edges * 0)]


def _numbers(table: pa.Table, columns: str) -> np.ndarray:
    """The numbers of all pieces, from the three columns that :func:`_planes` made."""
    low, mid, rest = columns
    n, sizes = _array(table.column(low), np.uint8)
    out = n.astype(np.int64) + (_array(table.column(mid), np.uint32)[0].astype(np.int64) << 8)
    high, there = _array(table.column(rest), np.uint32)
    out[np.repeat(there > 0, sizes)] += high.astype(np.int64) << 40
    return out


def _rows(block: np.ndarray, cell: np.ndarray, words: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
    empty = pa.nulls(len(block), pa.binary())
    return pa.record_batch([pa.array(block, pa.int64()), pa.array(cell, pa.int64()), pa.array(words, pa.int64()), *columns, *[empty] * (len(COLUMNS) - len(columns))], names=["block", "cell", "words", *COLUMNS])


# --- tokens ------------------------------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """(id arrays, word hashes, words of each document) of runs of documents of bounded size."""
    ids, hashes, counts, words = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            h, n = hash_words(*text_buffer(part.column(1)))
            if ids and words + len(h) > BLOCK_WORDS:
                yield ids, np.concatenate(hashes), np.concatenate(counts)
                ids, hashes, counts, words = [], [], [], 0
            ids.append(part.column(0))
            hashes.append(h)
            counts.append(n)
            words += len(h)
    if ids:
        yield ids, np.concatenate(hashes), np.concatenate(counts)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids, whether they are known, words of each, vocabulary, and each word's place in it (two halves).
    Frequent words come first in the vocabulary, so that the upper halves are mostly 0."""
    base = TaskContext.get().partitionId() << 24
    for i, (ids, w, counts) in enumerate(_blocks(batches)):
        ids = pa.chunked_array(ids)
        known, valid = ids.fill_null(0).to_numpy().astype(np.int64), ids.is_valid().to_numpy()
        u, code, n = np.unique(w, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(u), np.uint32)
        rank[order] = np.arange(len(u), dtype=np.uint32)
        code = rank[code]
        halves = code.astype(np.uint16), (code >> np.uint32(16)).astype(np.uint16)
        whole = [_binary(x, np.array([0, len(x)])) for x in (known, valid, counts.astype(np.int64), u[order], *halves)]
        yield _rows(np.array([base + i]), np.array([TOKENS]), np.array([len(w)]), whole)


class Block:
    """A row of tokens, read again: the documents and the hashes of their words, and the n-grams of each order."""

    def __init__(self, row: dict) -> None:
        self.ids, self.valid = np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], bool)
        self.counts = np.frombuffer(row["c"], np.int64)
        code = np.frombuffer(row["e"], np.uint16).astype(np.int64) + (np.frombuffer(row["f"], np.uint16).astype(np.int64) << 16)
        self.words = np.frombuffer(row["d"], np.uint64)[code]
        ends = np.repeat(np.cumsum(self.counts), self.counts)
        self.left = ends - np.arange(len(self.words))  # words from each place to its document's end
        self.hash = self.words

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For k = 1 .. order: k, where the k-grams begin, the distinct ones' hashes (sorted), each k-gram's place among them, and their number."""
        h = self.words
        for k in range(1, order + 1):
            at = np.flatnonzero(self.left >= k)
            if k > 1:  # the hash of k words from that of the first k - 1 and the last one
                full = np.zeros(len(self.words), np.uint64)
                full[at] = mix(mix(h[at]) + self.words[at + k - 1] * np.uint64(0x9E3779B97F4A7C15))
                h = full
            u, place, n = np.unique(h[at], return_inverse=True, return_counts=True)
            yield k, at, u, place, n


# --- n-grams and counts ------------------------------------------------------------------------------------------------


def _range(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by ranges of the hash, so that sorting by the hash sorts by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed_keys(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as differences from the one before in their piece: lower six bytes, and the upper two (nearly always 0)."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    d[edges[:-1]] = keys[edges[:-1]]
    return d.view(np.uint8).reshape(-1, 8)[:, :6], (d >> np.uint64(48)).astype(np.uint16)


def _keys(lower: pa.ChunkedArray, upper: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all pieces, and the number of each."""
    high, sizes = _array(upper, np.uint16)
    low, _ = _array(lower, np.uint8)
    d = np.zeros((len(high), 8), np.uint8)
    d[:, :6] = low.reshape(-1, 6)
    d[:, 6:] = high.view(np.uint8).reshape(-1, 2)
    total = np.cumsum(d.reshape(-1).view(np.uint64))
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, total[first - 1], np.uint64(0)) if len(total) else np.zeros(len(sizes), np.uint64)
    return total - np.repeat(before, sizes), sizes


def _explode(order: int, buckets: int):
    """Each block's distinct n-grams, a row for each range of the hash: keys, numbers, and how many are followed by a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for k, at, u, place, n in block.grams(order):
                    if not len(u):
                        continue
                    bucket = _range(u, buckets)
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(u)]])
                    columns = [*[_binary(x, edges) for x in _packed_keys(u, edges)], *_planes(n, edges)]
                    if k < order:
                        columns += _planes(np.bincount(place, block.left[at] > k, len(u)), edges)
                    rows = len(edges) - 1
                    yield _rows(np.full(rows, row["block"]), (k - 1) * buckets + bucket[edges[:-1]], np.diff(edges), columns)

    return run


def _count(buckets: int, min_count: int):
    """One range of the hash: its counts (one row), and the answers to each block's n-grams."""

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        keys, sizes = _keys(table.column("a"), table.column("b"))
        u, place = np.unique(keys, return_inverse=True)
        # Sums are exact below 2**53.
        sums = [np.bincount(place, _numbers(table, c), len(u)).astype(np.int64) for c in ("cde", "fgh") if table.column(c[0]).null_count == 0]
        kept = sums[0] >= (min_count if cell >= buckets else 1)
        edges = np.array([0, int(kept.sum())])
        counts = [*[_binary(x, edges) for x in _packed_keys(u[kept], edges)], *[c for x in sums for c in _planes(x[kept], edges)]] if kept.any() else []
        own = _rows(np.array([COUNTS]), np.array([cell]), np.array([edges[1]]), counts)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        answers = _rows(table.column("block").to_numpy(), np.full(len(sizes), cell), sizes, [c for x in sums for c in _planes(x[place], edges)])
        return pa.Table.from_batches([own, answers])

    return run


def _score(order: int, buckets: int, total: int, alpha: float, min_count: int):
    """One block: its tokens and the answers to its n-grams give each document's sum."""

    def run(table: pa.Table) -> pa.Table:
        cells = table.column("cell").to_numpy()
        row = table.slice(int(np.flatnonzero(cells == TOKENS)[0]), 1).to_pylist()[0]
        block = Block(row)
        sort = np.argsort(cells, kind="stable")
        table, cells = table.take(pa.array(sort)), cells[sort]
        value = np.zeros(len(block.words))  # of the word at each place, by the orders looked at so far
        before: np.ndarray | None = None
        for k, at, _, place, _ in block.grams(order):
            mine = table.filter(pa.array((cells >= (k - 1) * buckets) & (cells < k * buckets)))

            last = at + k - 1  # the word that a k-gram ends in
            if len(at):
                n = _numbers(mine, "abc")[place]
                if k == 1:
                    value[last] = np.log(n) - np.log(total)
                else:
                    good = n >= min_count
                    back = value[last] + np.log(alpha)
                    back[good] = np.log(n[good]) - np.log(before[at[good]])
                    value[last] = back
                if k < order:
                    before = np.zeros(len(block.words), np.int64)  # how often the k-gram at each place is followed
                    before[at] = _numbers(mine, "def")[place]
        units = np.concatenate([[0], np.cumsum(np.rint(value * UNIT).astype(np.int64))])
        ends = np.cumsum(block.counts)
        log_score = (units[ends] - units[ends - block.counts]) / UNIT
        none = block.counts == 0
        score = pa.array(log_score / np.maximum(block.counts, 1), pa.float64(), mask=none)
        return pa.table({"doc_id": pa.array(block.ids, pa.int64(), mask=~block.valid), "n_words": block.counts, "log_score": np.where(none, 0.0, log_score), "score": score})

    return run


def _counted(docs: DataFrame, order: int, min_count: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The table of tokens, that of counts and answers, the number of ranges of the hash, and the corpus's words."""
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = store(rows.mapInArrow(_tokens, CELL), "tokens", "zstd")
    total = tokens.agg(F.sum("words")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))
    with batches_of(docs.sparkSession, 1):
        grams = tokens.mapInArrow(_explode(order, buckets), CELL)
        counted = store(grams.groupBy("cell").applyInArrow(_count(buckets, min_count), CELL), "counts", "zstd")
    return tokens, counted, buckets, total


def count_ngrams(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """The count tables as rows: order (1 ..), gram (a 64-bit hash), n, followed (null for the longest ones); n-grams of two and more words that
    occur less than ``min_count`` times are not in them."""
    _, counted, buckets, _ = _counted(docs, order, min_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if not row.column("words")[0].as_py():
                    continue
                keys, _ = _keys(row.column("a"), row.column("b"))
                table = pa.Table.from_batches([row])
                followed = pa.array(_numbers(table, "fgh")) if row.column("f").null_count == 0 else pa.nulls(len(keys), pa.int64())
                k = row.column("cell")[0].as_py() // buckets + 1
                yield pa.record_batch([pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys.view(np.int64)), pa.array(_numbers(table, "cde")), followed], names=["order", "gram", "n", "followed"])

    return counted.where(F.col("block") == COUNTS).mapInArrow(run, "order int, gram bigint, n bigint, followed bigint")


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_score (the sum of the words' log scores; 0 without words) and score (their mean; null without words).

    One row for each row of ``docs``; null texts count as empty, null ids stay null, repeated rows are counted and scored each.
    Extra columns are not read; an empty table gives none.
    """
    tokens, counted, buckets, total = _counted(docs, order, min_count)
    both = tokens.unionByName(counted.where(F.col("block") != COUNTS))
    with batches_of(docs.sparkSession, 1):
        out = store(both.groupBy("block").applyInArrow(_score(order, buckets, total, alpha, min_count), "doc_id bigint, n_words bigint, log_score double, score double"), "scores")
    forget(tokens)
    forget(counted)
    return out


def brute_force(texts: list[str | None], order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> list[tuple[int, float]]:
    """The same scores by dictionaries, for tests: (words, sum of logs)."""
    split = [tuple((t or "").encode().lower().split()) for t in texts]
    count = Counter(t[i : i + k] for t in split for k in range(1, order + 1) for i in range(len(t) - k + 1))
    followed = Counter(t[i : i + k] for t in split for k in range(1, order) for i in range(len(t) - k))
    total, out = sum(map(len, split)), []
    for t in split:
        s = 0
        for i in range(len(t)):
            longest = min(i + 1, order)
            k = next((k for k in range(longest, 1, -1) if count[t[i + 1 - k : i + 1]] >= min_count), 1)
            p = log(count[t[i + 1 - k : i + 1]]) - log(followed[t[i + 1 - k : i]] if k > 1 else total)
            s += round((p + (longest - k) * log(alpha)) * UNIT)
        out.append((len(t), s / UNIT))
    return out
