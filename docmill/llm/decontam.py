"""Benchmark decontamination by suffix arrays of the training texts.

A task builds a word-level suffix array of each shard (about SHARD_WORDS words of whole documents; a longer document is cut into
pieces that overlap by a window on either side, which loses no window) by doubling the compared prefix, only for suffixes that are still tied.
Every suffix of every benchmark item is then searched in it by bisection, word by word, all suffixes side by side: the range of
the suffixes that share its first words narrows until no word more agrees. So each suffix gets the length of its longest verbatim
match in the shard, and every place where its first WINDOW words occur.

Documents stay where they are: nothing is shuffled. The benchmark goes to the tasks in blocks of bounded size; if it has several,
each is searched in a pass of its own, and rows carry the words that were hit from pass to pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, forget, hash_words, item_blocks, small_batches, store, text_buffer

WINDOW = 10
SHARD_WORDS = 1 << 20  # a vocabulary and the ends of texts fit into CODE bits
SHARD_DOCS = 1 << 18
CODE = 21
ITEM_WORDS = 1 << 20  # words of the items that are searched in one pass, about


class Suffixes:
    """The suffix array of texts whose words lie one after another, each text followed by an end of its own."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        n = len(words) + len(counts)
        self.vocabulary, inverse = np.unique(words, return_inverse=True)
        #: where each text begins; its end is before the next one's begin
        self.first = np.concatenate([[0], np.cumsum(counts + 1)])
        ends = self.first[1:] - 1
        self.codes = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        self.codes[inner] = inverse
        self.codes[ends] = len(self.vocabulary) + np.arange(len(counts))
        self.order = _sorted_suffixes(self.codes)
        #: where the suffixes that begin with each word of the vocabulary begin in the order
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(self.vocabulary)))])

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """The text in which each place lies."""
        return np.searchsorted(self.first, places, "right") - 1

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Other words in this vocabulary; -1 for those it doesn't have."""
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at, -1) if len(self.vocabulary) else np.full(len(words), -1)

    def find(self, words: np.ndarray, until: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix of ``words`` (coded; that at i ends before ``until[i]``): the length of its longest match in the texts, and
        the range of the order that agrees in its first ``needed`` words, empty if none does."""
        length = np.zeros(len(words), np.int64)
        low, high = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero((words >= 0) & (np.arange(len(words)) < until))
        a, b = self.starts[words[live]], self.starts[words[live] + 1]
        depth = 1
        while len(live):
            length[live] = depth
            done = needed[live] == depth
            low[live[done]], high[live[done]] = a[done], b[done]
            more = live + depth < until[live]
            live, a, b = live[more], a[more], b[more]
            w = words[live + depth]
            known = w >= 0
            live, a, b, w = live[known], a[known], b[known], w[known]
            a, b = self._bisect(a, b, depth, w), self._bisect(a, b, depth, w + 1)
            some = a < b
            live, a, b = live[some], a[some], b[some]
            depth += 1
        return length, low, high

    def _bisect(self, a: np.ndarray, b: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """The first place of each range [a, b) of the order whose suffix has at least ``word`` after ``depth`` words."""
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self.codes[self.order[middle] + depth] < word[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a


def _sorted_suffixes(codes: np.ndarray) -> np.ndarray:
    """The places of ``codes`` in the order of what follows them. Three codes of CODE bits are compared at first; then, among ties
    only, twice as many in each round. The codes of ends occur once, so no tie reaches over one."""
    n = len(codes)
    padded = np.concatenate([codes, [0, 0]])
    key = (padded[:n] << (2 * CODE)) | (padded[1 : n + 1] << CODE) | padded[2 : n + 2]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)  # of a group of ties: where it begins in the order
    slots, depth = np.arange(n), 3
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        begin = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[order[slots]] = begin
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots, begin = slots[tied], begin[tied]
        if not len(slots):
            return order
        places = order[slots]
        key = (begin << 32) | rank[places + depth]
        sort = np.argsort(key, kind="stable")
        order[slots] = places[sort]
        key = key[sort]
        depth *= 2


class Items:
    """A block of items: their words one after another, and the windows that differ, each with the items that have it."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.ids = [None if x is None else str(x) for x in table.column("item").to_pylist()]
        parts = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        self.words = np.concatenate(parts)
        self.begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.until = self.begin + np.repeat(sizes, sizes)
        self.item = np.repeat(np.arange(len(parts)), sizes)
        at = np.arange(len(self.words))
        # the words that an occurrence of the window at each place takes; 0: no window begins there
        self.needed = np.where(self.until - at >= window, window, np.where(at == self.begin, self.until - at, 0))


def _cut(words: np.ndarray, counts: np.ndarray, window: int, size: int) -> Iterator[tuple[list[int], list[int], list[int], np.ndarray, np.ndarray]]:
    """Shards (texts, offsets, own words, words, words of each piece) of whole texts, or pieces of one text that is longer than ``size``."""
    begin, at = np.concatenate([[0], np.cumsum(counts)]), 0
    while at < len(counts):
        if counts[at] > size:
            for a in range(0, int(counts[at]), size):
                b = min(int(counts[at]), a + size)
                lo, hi = max(0, a - window + 1), min(int(counts[at]), b + window - 1)
                yield [at], [lo], [a, b], words[begin[at] + lo : begin[at] + hi], np.array([hi - lo])
            at += 1
            continue
        last = at + 1
        while last < len(counts) and last - at < SHARD_DOCS and counts[last] <= size and begin[last + 1] - begin[at] <= size:
            last += 1
        yield list(range(at, last)), [0] * (last - at), [], words[begin[at] : begin[last]], counts[at:last]
        at = last


def _pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's number beside each of its places."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]


def _batches_of_texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, words, words of each row) of runs of rows with about SHARD_WORDS words together."""
    held, words, counts = [], [], []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            h, c = hash_words(*text_buffer(part.column("row").field(text)), MARKS)
            if held and sum(map(len, words)) + len(h) > SHARD_WORDS:
                yield pa.Table.from_batches(held), np.concatenate(words), np.concatenate(counts)
                held, words, counts = [], [], []
            held.append(part)
            words.append(h)
            counts.append(c)
    if held:
        yield pa.Table.from_batches(held), np.concatenate(words), np.concatenate(counts)


def _mark(items: Items, window: int, text: str, size: int):
    """(row, n_words, n_hit, hits, items) of rows (row, hits, items): hits has a bit for each word; found ones are added to those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, counts in _batches_of_texts(batches, text):
            edge = np.concatenate([[0], np.cumsum(counts)])
            hit = np.zeros(len(words), bool)
            for i, bits in enumerate(rows.column("hits").to_pylist()):
                if bits:
                    hit[edge[i] : edge[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(counts[i])).astype(bool)
            named = [set(x or ()) for x in rows.column("items").to_pylist()]
            for texts, offsets, own, part, sizes in _cut(words, counts, window, size):
                if not len(part):
                    continue
                array = Suffixes(part, sizes)
                _, low, high = array.find(array.coded(items.words), items.until, items.needed)
                some = np.flatnonzero((items.needed > 0) & (low < high))
                if not len(some):
                    continue
                # windows with the same words have the same range
                ranges, same = np.unique(np.stack([low[some], high[some], items.needed[some]]), axis=1, return_inverse=True)
                which, slot = _pairs(ranges[0], ranges[1])
                places, length = array.order[slot], ranges[2][which]
                cover = np.zeros(len(array.codes) + 1, np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + length, -1)
                covered = np.cumsum(cover)[:-1] > 0
                inside = array.text_of(places)
                for k in np.unique(inside).tolist():
                    mine = covered[array.first[k] : array.first[k + 1] - 1]
                    a, b = own or (0, len(mine))
                    hit[edge[texts[k]] + a : edge[texts[k]] + b] |= mine[a - offsets[k] : b - offsets[k]]
                found = np.unique(np.stack([inside, which]), axis=1)
                by_range = np.argsort(same.ravel(), kind="stable")
                start = np.searchsorted(same.ravel()[by_range], np.arange(ranges.shape[1] + 1))
                for k, r in found.T.tolist():
                    named[texts[k]].update(x for j in items.item[some[by_range[start[r] : start[r + 1]]]].tolist() if (x := items.ids[j]) is not None)
            bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch([rows.column("row").combine_chunks(), pa.array(counts, pa.int64()), pa.array([int(hit[a:b].sum()) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.int64()), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in named], pa.list_(pa.string()))], names=["row", "n_words", "n_hit", "hits", "items"])

    return run


def _length(texts: np.ndarray, a: np.ndarray, words: np.ndarray, p: np.ndarray, until: np.ndarray) -> np.ndarray:
    """How many words agree from text place ``a`` and item place ``p`` on."""
    n = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        more = p[live] + n[live] < until[live]
        live = live[more]
        live = live[texts[a[live] + n[live]] == words[p[live] + n[live]]]
        n[live] += 1
    return n


def _longest(items: Items, window: int, text: str, size: int):
    """(row, item, item_start, start, length) of each verbatim match that can't be made longer and has a whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, counts in _batches_of_texts(batches, text):
            for texts, offsets, own, part, sizes in _cut(words, counts, window, size):
                if not len(part):
                    continue
                array = Suffixes(part, sizes)
                coded = array.coded(items.words)
                _, low, high = array.find(coded, items.until, items.needed)
                some = np.flatnonzero((items.needed > 0) & (low < high))
                which, slot = _pairs(low[some], high[some])
                p, a = some[which], array.order[slot]
                before = (p > items.begin[p]) & (a > array.first[array.text_of(a)])
                longer = np.zeros(len(p), bool)
                longer[before] = array.codes[a[before] - 1] == coded[p[before] - 1]
                p, a = p[~longer], a[~longer]
                inside = array.text_of(a)
                start = a - array.first[inside] + np.array(offsets)[inside]
                n = _length(array.codes, a, coded, p, items.until[p])
                row = np.array(texts)[inside]
                yield pa.record_batch([rows.column("row").combine_chunks().take(pa.array(row)), pa.array([items.ids[i] for i in items.item[p]], pa.string()), pa.array(p - items.begin[p]), pa.array(start), pa.array(n)], names=["row", "item", "item_start", "start", "length"])

    return run


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return small_batches(docs.select(F.struct(*[F.col(c).cast("string").alias(c) if c == text else c for c in docs.columns]).alias("row")))


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", size: int = SHARD_WORDS) -> DataFrame:
    """(row, item, item_start, start, length): the verbatim matches of items in the texts of ``docs`` that can't be made longer and have at
    least ``window`` words, or a whole shorter item. ``row`` has all columns of ``docs``, starts count words from 0, ``item`` is the
    id as a string. A match in a text of more than ``size`` words may be reported in parts that overlap."""
    out = None
    rows = _rows(docs, text)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, item string, item_start bigint, start bigint, length bigint"
    for block in item_blocks(items, item_id, "text", MARKS, ITEM_WORDS):
        found = rows.mapInArrow(_longest(Items(block, window), window, text, size), schema).distinct()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", size: int = SHARD_WORDS, item_words: int = ITEM_WORDS) -> DataFrame:
    """(row, n_words, n_hit, hits, items) of each row of ``docs``: its numbers of words and of hit words, a bit for each word that lies in an occurrence of a
    window, first word first, and the ids of the items with such windows as sorted strings, each once.

    A window is a run of ``window`` words of an item, or a whole item of fewer. Null and empty texts have no words; items without words
    have no window. An item with a null id hits words, but is not named. Repeated rows are judged each; ``row`` has all columns of docs,
    whatever they are called. Empty tables: no rows, or no hits.
    """
    rows = _rows(docs, text).withColumns({"n_words": F.lit(0).cast("bigint"), "n_hit": F.lit(0).cast("bigint"), "hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, n_hit bigint, hits binary, items array<string>"
    empty = pa.table({"item": pa.array([""]), "words": pa.array([b""], pa.binary())})
    before = None
    for i, block in enumerate(item_blocks(items, item_id, "text", MARKS, item_words)):
        if i:
            rows = store(rows, "contamination")
            if before is not None:
                forget(before)
            before = rows
        rows = rows.mapInArrow(_mark(Items(block, window), window, text, size), schema)
        empty = None
    return rows if empty is None else rows.mapInArrow(_mark(Items(empty, window), window, text, size), schema)


def judge(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document; see :func:`contamination`."""
    found = contamination(docs.select("doc_id", "text"), items, **options)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a word that lies in a window of ``items``; see :func:`contamination`."""
    return contamination(docs, items, **options).where("n_hit = 0").select("row.*")
