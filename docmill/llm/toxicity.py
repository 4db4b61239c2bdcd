"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Training uses a bounded sample of labelled texts (``MAX_PER_CLASS`` of each label); scoring reads every text whole, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, mix, powers, small_batches, store

SIZES = (4, 6, 8)  # characters of an n-gram; a blank stands for any run's edge, so the longer ones hold whole words
BITS = 20  # n-grams are hashed to 2**BITS numbers
MAX_PER_CLASS = 4_000  # labelled texts of each label that are used, at most
MAX_FEATURES = 2_048  # n-grams kept, by their chi-square with the label
_CHUNK = 1 << 18
SMOOTHING = 0.3  # added to counts for the ratios
_UP = _DOWN = np.zeros(0, np.uint64)


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, number of the text, first text) of runs of whole texts; anything but letters and digits is a space."""
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size + len(texts[j] or "") < _CHUNK):
            part.append(" " + (texts[j] or "").lower() + " ")
            size += len(part[-1])
            j += 1
        x = np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        plain = (x < 48) | ((x > 57) & (x < 97)) | ((x > 122) & (x < 170))
        x[plain] = 32
        yield x, np.repeat(np.arange(i, j), [len(p) for p in part]), i
        i = j


def _grams(x: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hashed n-grams and their texts; none spans two texts."""
    global _UP, _DOWN
    if len(_UP) < len(x):
        _UP, _DOWN = powers(BASE, len(x)), powers(INVERSE, len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x + np.uint64(1)) * _UP[: len(x)], out=sums[1:])
    for n in SIZES:
        m = len(x) - n + 1
        if m > 0:
            one = doc[:m] == doc[n - 1 :]
            h = (sums[n:] - sums[:m]) * _DOWN[:m] + np.uint64(n)
            yield (mix(h[one]) >> np.uint64(64 - BITS)).astype(np.int64), doc[:m][one]


def _present(texts: list[str | None], index: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its distinct features in order); with ``index``, kept n-grams only, by their place."""
    bits = np.int64(1) << np.int64(BITS)
    for x, doc, first in _chunks(texts):
        keys = []
        for h, d in _grams(x, doc):
            if index is not None:
                h = index[h].astype(np.int64)
                d, h = d[h >= 0], h[h >= 0]
            keys.append(d * bits + h)
        found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        ids, starts = np.unique(found >> BITS, return_index=True)
        for i, part in zip(ids, np.split(found & (bits - 1), starts[1:]), strict=False):
            yield int(i), part


@dataclass
class Model:
    """``index``: hashed n-gram to feature or -1; ``weights``: of each feature, its log-count ratio included; ``bias``."""

    index: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.weights):
            for i, features in _present(texts, self.index):
                z[i] += self.weights[features].sum()
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Regularised logistic regression by accelerated gradient steps; ``rows`` are the features of each text, whose values are ``scale``."""
    n, k = len(y), len(scale)
    at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, (w * scale)[at], n)

    def back(e: np.ndarray) -> np.ndarray:
        return np.bincount(at, e[row], k) * scale

    v = np.ones(k)
    for _ in range(12):  # the largest curvature, by the power method
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / (0.25 * (float(v @ back(forward(v))) + n) / n + l2 / n)
    w, b, pw, pb = np.zeros(k), 0.0, np.zeros(k), 0.0
    for i in range(steps):
        m = i / (i + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        e = 1 / (1 + np.exp(-np.clip(forward(yw) + yb, -40, 40))) - y
        pw, pb = w, b
        w = yw - rate * (back(e) / n + l2 / n * yw)
        b = float(yb - rate * e.mean())
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = MAX_PER_CLASS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on the texts of ``docs`` whose ``doc_id`` has a 0/1 ``label``; null ids and labels are ignored, and of several labels of a document the largest counts.

    The sample is the first ``max_per_class`` ids of each label in the order of a hash, so it does not depend on how the
    tables are stored. The bias is set for the frequency of the labels in the whole table. Without rows of both labels the
    model has no features and scores every text alike.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    totals = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    n = [totals.get(0, 0), totals.get(1, 0)]
    constant = Model(np.full(1 << BITS, -1, np.int16), np.zeros(0, np.float32), float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    if not all(n):
        return constant
    ids = None
    for y in (0, 1):  # two bounded sorts: each task keeps max_per_class rows
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        ids = part if ids is None else ids.unionByName(part)
    ids = store(ids.withColumnRenamed("doc_id", "__id"), "toxicity-ids")  # at most 2 * max_per_class rows: small enough to send to all
    # One text an id, the least, however often the id is repeated: so the sample is bounded as its ids are.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.first("__y").alias("__y"), F.min("text").alias("text"))
    sample = store(sample.select("__y", "text"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            y = batch.column(0).to_pylist()
            for at in range(0, len(y), 512):
                for i, features in _present(batch.column(1).slice(at, 512).to_pylist()):
                    table[y[at + i], features] += 1
        at = np.flatnonzero(table.any(axis=0))
        yield pa.record_batch({"f": at, "c0": table[0, at].astype(np.int64), "c1": table[1, at].astype(np.int64)})

    seen = [0, 0]
    for r in sample.groupBy("__y").count().collect():
        seen[r[0]] = r[1]
    if not all(seen):
        return constant
    # At most 2**BITS rows whatever the input, of which the best max_features come to the driver.
    c = small_batches(sample).mapInArrow(count, "f bigint, c0 bigint, c1 bigint").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    p0, p1 = F.col("c0") / F.lit(seen[0]), F.col("c1") / F.lit(seen[1])
    pooled = (F.col("c0") + F.col("c1")) / F.lit(seen[0] + seen[1])
    chi = (p1 - p0) * (p1 - p0) / (pooled * (F.lit(1.0) - pooled) + F.lit(1e-9))
    top = c.where("c0 + c1 >= 3").withColumn("chi", chi).orderBy(F.desc("chi"), "f").limit(max_features).select("f", "c0", "c1").collect()
    if not top:
        return constant
    f, c0, c1 = (np.array([r[k] for r in top], np.int64) for k in range(3))
    ratio = np.log(((c1 + SMOOTHING) / (seen[1] + 2 * SMOOTHING)) / ((c0 + SMOOTHING) / (seen[0] + 2 * SMOOTHING))).astype(np.float32)
    index = np.full(1 << BITS, -1, np.int16)
    index[f] = np.arange(len(f), dtype=np.int16)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * batch.num_rows
            for i, features in _present(batch.column(1).to_pylist(), index):
                out[i] = features.astype(np.int16).tobytes()
            yield pa.record_batch({"y": batch.column(0), "x": pa.array(out, pa.binary())})

    rows = small_batches(sample).mapInArrow(lay, "y int, x binary").collect()  # the bounded sample
    rows.sort(key=lambda r: (r[0], r[1]))
    y = np.array([r[0] for r in rows], float)
    w, b = _logistic([np.frombuffer(r[1], np.int16) for r in rows], ratio.astype(float), y)
    prior = np.log(n[1] / n[0]) - np.log(seen[1] / seen[0])
    return Model(index, (w * ratio).astype(np.float32), float(b + prior))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of label 1; null and empty texts get the model's bias. Other columns and repeated rows pass as they are."""
    schema = docs.drop(out).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            s = np.concatenate([model.scores(column.slice(i, 512).to_pylist()) for i in range(0, max(1, len(column)), 512)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, out])

    return small_batches(docs.drop(out)).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0 (a null id: held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows that are not held out."""
    return train(docs, labels.where(~held_out()))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs.select("doc_id", "text"), fit_documents(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
