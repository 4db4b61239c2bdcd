"""Ranked lexical search: an inverted index in shards of documents, and top-k by WAND in each of them.

A shard holds the documents of one run of rows (about SHARD_WORDS words, at most SHARD_DOCS documents): its vocabulary, and for
each term the documents that hold it, in order, with their counts. Shards are rows of a stored table. The corpus' counts (documents,
terms, documents that hold a query's terms) are sums over all shards.

For a query, each of its terms has in a shard a maximum impact: the most that it adds to a score there. With the terms in falling
order of these, the *pivot* is the first term from which on the maxima together can't reach the threshold, the k-th best score so
far. A document that holds none of the terms before the pivot can't get in and is never looked at; of the others, only those are
scored whose terms' maxima reach the threshold, and scoring ends as soon as what is left can't. Documents are walked in windows
of WINDOW, so that numpy looks at many together; the threshold rises from window to window and from shard to shard, as a task takes
each query's heap along. The heaps of all tasks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MARKS, batches_of, item_blocks, small_batches, store, word_blocks

SHARD_WORDS = 2_000_000
SHARD_DOCS = 1 << 15
WINDOW = 2_048
QUERY_WORDS = 1 << 18  # words of the queries that are searched in one pass, about
TOP = 10
LONG = 2**63

SHARD = "docs bigint, words bigint, ids binary, known binary, sizes binary, vocabulary binary, starts binary, slots binary, counts binary"
FOUND = "item int, doc_id bigint, score bigint"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, words, sizes in word_blocks(batches, 1, MARKS, SHARD_WORDS, SHARD_DOCS):
        ids = rows.column(0).combine_chunks()
        some = np.flatnonzero(sizes)  # documents without a term are in no list and don't count
        vocabulary, term = np.unique(words, return_inverse=True)
        pairs = term.astype(np.int64) * len(some) + np.repeat(np.arange(len(some)), sizes[some])
        pairs, counts = np.unique(pairs, return_counts=True)
        starts = np.searchsorted(pairs, np.arange(len(vocabulary) + 1) * len(some))
        slots = (pairs % max(1, len(some))).astype(np.uint16)
        parts = [ids.fill_null(0).to_numpy().astype(np.int64)[some], ids.is_valid().to_numpy(zero_copy_only=False)[some], sizes[some].astype(np.int64), vocabulary, starts.astype(np.uint32), slots, counts.astype(np.uint32)]
        names = ["ids", "known", "sizes", "vocabulary", "starts", "slots", "counts"]
        yield pa.record_batch([pa.array([len(some)], pa.int64()), pa.array([len(words)], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["docs", "words", *names])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored shards of all documents. Whole texts are read; terms are runs of letters and digits of ASCII and of all other
    characters beyond ASCII, A-Z lower-cased. Terms are kept as 64-bit hashes. The index doesn't depend on any query."""
    rows = small_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return store(rows.mapInArrow(_shards, SHARD), "index", codec="zstd")


def _array(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _holders(terms: np.ndarray):
    """(term, df): how many documents of a task's shards hold each of ``terms`` (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, starts = _array(row, "vocabulary", np.uint64), _array(row, "starts", np.uint32)
                at = np.searchsorted(terms, vocabulary)
                here = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == vocabulary)
                total[at[here]] += np.diff(starts.astype(np.int64))[here]
        some = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(some, pa.int32()), "df": total[some]})

    return run


class Shard:
    """The lists of one shard for the terms of a block of queries."""

    def __init__(self, row: dict, terms: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int) -> None:
        self.ids, self.known = _array(row, "ids", np.int64), _array(row, "known", bool)
        self.n = len(self.ids)
        sizes = _array(row, "sizes", np.int64)
        if self.n and 90 * int(sizes.max()) * n_docs >= LONG:
            sizes = sizes.astype(object)
        self.m = (10 + (90 * sizes * n_docs) // n_words).astype(np.int64)
        self.starts, self.slots, self.counts = _array(row, "starts", np.uint32), _array(row, "slots", np.uint16), _array(row, "counts", np.uint32)
        vocabulary = _array(row, "vocabulary", np.uint64)
        at = np.searchsorted(vocabulary, terms)
        here = vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms if len(vocabulary) else np.zeros(len(terms), bool)
        self.place = np.where(here, at, -1)
        self.weights, self.lists = weights, {}

    def list_of(self, term: int):
        """(maximum impact, slots, impacts) of a term that a document here holds, else None; a term without weight adds nothing."""
        if term not in self.lists:
            p, w = self.place[term], int(self.weights[term])
            out = None
            if p >= 0 and w:
                a, b = int(self.starts[p]), int(self.starts[p + 1])
                slots, tf = self.slots[a:b].astype(np.int64), self.counts[a:b].astype(np.int64)
                impacts = w * ((1_000_000_000 * tf) // (1_000 * tf + 8 * self.m[slots]))
                if most := int(impacts.max()):
                    out = most, slots, impacts
            self.lists[term] = out
        return self.lists[term]


class Heap:
    """A query's k best documents so far, best first; what has been scored for it, and what holds one of its terms."""

    def __init__(self, k: int) -> None:
        self.k, self.best, self.scored = k, [], 0

    @property
    def least(self) -> int:
        """A lower score can't get in; an equal one may, by its id."""
        return self.best[-1][0] if len(self.best) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, known = scores[keep], ids[keep], known[keep]
        new = [(s, i if k else None) for s, i, k in zip(scores.tolist(), ids.tolist(), known.tolist(), strict=True)]
        self.best = sorted([*self.best, *new], key=lambda x: (-x[0], x[1] is None, x[1] or 0))[: self.k]


def wand(shard: Shard, terms: list[int], heap: Heap) -> None:
    """Offer ``heap`` the documents of ``shard`` that can get in."""
    lists = sorted((x for t in terms if (x := shard.list_of(t))), key=lambda x: -x[0])
    if not lists:
        return
    tail = np.cumsum([0, *[x[0] for x in reversed(lists)]])[::-1].tolist()  # tail[i]: maxima of the lists from i on, together
    if tail[0] < heap.least:
        return
    bounds = np.arange(0, shard.n + WINDOW, WINDOW)
    edges = [np.searchsorted(x[1], bounds) for x in lists]
    for w, first in enumerate(bounds[:-1].tolist()):
        least = heap.least
        pivot = next((i for i, t in enumerate(tail) if t < least), len(lists))
        if not pivot:
            return
        reach = np.zeros(WINDOW, np.int64)  # the maxima of the terms before the pivot that each document holds
        for (most, slots, _), e in zip(lists[:pivot], edges, strict=False):
            reach[slots[e[w] : e[w + 1]] - first] += most
        who = np.flatnonzero((reach > 0) & (reach + tail[pivot] >= least))
        heap.scored += len(who)
        score, left = np.zeros(len(who), np.int64), reach[who]
        for i, ((most, slots, impacts), e) in enumerate(zip(lists, edges, strict=True)):
            if not len(who):
                break
            a, b = int(e[w]), int(e[w + 1])
            at = a + np.searchsorted(slots[a:b], who + first)
            hit = np.flatnonzero((at < b) & (slots[np.minimum(at, len(slots) - 1)] == who + first))
            score[hit] += impacts[at[hit]]
            if i < pivot:
                left[hit] -= most
            keep = score + left + tail[max(i + 1, pivot)] >= least
            if not keep.all():
                who, score, left = who[keep], score[keep], left[keep]
        if len(who):
            heap.offer(score, shard.ids[who + first], shard.known[who + first])


def _search(terms: np.ndarray, weights: np.ndarray, queries: list[list[int]], n_docs: int, n_words: int, k: int, stats: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, terms, weights, n_docs, n_words)
                for q, heap in zip(queries, heaps, strict=True):
                    wand(shard, q, heap)
        if stats:
            found = [(i, TaskContext.get().partitionId(), h.scored) for i, h in enumerate(heaps)]
        else:
            found = [(i, d, s) for i, h in enumerate(heaps) for s, d in h.best]
        yield pa.record_batch({"item": pa.array([x[0] for x in found], pa.int32()), "doc_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.int64())})

    return run


def weight(n_docs: int, df: int) -> int:
    """A term's weight: the thousandfold logarithm of its rarity, rounded down."""
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text", stats: bool = False) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best documents with a score above 0.

    Equal scores go to the smaller doc_id, null ids last. An item's terms count once each. Items that are null or without terms, or
    whose terms no document holds, have no rows. Items that repeat an id are items of their own; so are documents. Queries are
    searched in blocks of about QUERY_WORDS words, each of which goes to all tasks and meets every shard; so neither driver nor
    task holds all items of a large table. With ``stats``: item_id and how many documents each task scored, as ``score``.
    """
    spark = index.sparkSession
    n_docs, n_words = index.agg(F.sum("docs"), F.sum("words")).first()
    kind = items.schema[item_id].dataType.simpleString()
    out = None
    for block in item_blocks(items, item_id, text, MARKS, QUERY_WORDS):
        if not n_docs:
            break
        words = [np.unique(np.frombuffer(x, np.uint64)) for x in block.column("words").to_pylist()]
        terms = np.unique(np.concatenate(words))
        queries = [np.searchsorted(terms, w).tolist() for w in words]
        with batches_of(spark, 4):
            held = {r["term"]: r["df"] for r in index.select("vocabulary", "starts").mapInArrow(_holders(terms), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
            weights = np.array([weight(n_docs, held[t]) if t in held else 0 for t in range(len(terms))], np.int64)
            found = store(index.mapInArrow(_search(terms, weights, queries, n_docs, n_words, k, stats), FOUND), "found")
        names = spark.createDataFrame(pa.table({"item": pa.array(range(block.num_rows), pa.int32()), "item_id": block.column("item")}))
        if not stats:
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # names is one block of items: bounded by QUERY_WORDS
        found = found.join(F.broadcast(names), "item").drop("item")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out.select(F.col("item_id").cast(kind).alias("item_id"), *([] if stats else [F.col("rank").cast("int").alias("rank")]), "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs`` (doc_id, text) and search them for each of ``items`` (item_id, text); extra columns are not read. Null and
    empty texts have no terms: they count in no sum and are found by no item. Empty tables give no rows."""
    return search(build_index(docs), items, k)
