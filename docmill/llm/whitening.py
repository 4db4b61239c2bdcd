"""Whitening of embeddings from an exact covariance: products of digit slices in float64, merged as big integers.

Components c become integers x = floor(SCALE * c) + OFFSET. With n vectors of per-dimension sums S, the centred vectors times n,
y = n * x - S, are integers too. Each task splits them into limbs of LIMB bits with the sign of y. A product of two matrices of
limbs is a float64 BLAS call (GEMM) that makes no rounding error: a sum of ROWS products of two limbs stays under 2^53. The
products of limbs k and l count 2^(LIMB * (k + l)); a task recombines them as integers of any size, kept as digits of DIGIT
bits, one row a row of the matrix and digit. The digits of all tasks are summed in two rounds of exchanges; what comes to the
driver is one matrix of dimensions x dimensions, divided there by n^3 with one rounding an entry. Its eigenvectors are the components.

Nothing else depends on the order or the partitions of the rows: sums, covariance, components and deviations are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

SCALE, OFFSET = 1024.0, 100_000
LIMB = 16
ROWS = 1 << 15  # rows of one product: ROWS * 2^(2 * LIMB) is under 2^53
DIGIT = 32
COMPONENTS = 8
SALTS = 64  # first the digits of so many sets of tasks are summed, then those of all
LONG = 2**63 - 1


def good_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds neither nulls nor numbers that are not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.coalesce(F.col(vector).isNotNull() & ~odd, F.lit(False)))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list array as integers floor(SCALE * c) + OFFSET. Vectors shorter than ``width`` end in zeros;
    integers beyond 64 bits count as the nearest long. The matrix has Python integers only where int64 can't hold a sum of two."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    c = np.zeros((len(column), width))
    c[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * c)
    if np.abs(x).max(initial=0) < 2.0**61:
        return x.astype(np.int64) + OFFSET
    return np.array([[max(-LONG - 1, min(LONG, (int(v) if np.isfinite(v) else int(np.sign(v)) * 2 * LONG) + OFFSET)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _chunks(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, integers(part.column(column), width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as int64 where that holds all of them."""
    most = max(abs(s) for s in sums) if sums else 0
    if x.dtype != object and n * (int(np.abs(x).max(initial=0)) + 1) + most < LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as float64 matrices of limbs, the lowest first: the sum of limb k times 2^(LIMB * k) is ``y``."""
    sign = np.where(y < 0, -1, 1)
    rest, out = np.abs(y), []
    while not out or (rest != 0).any():
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64) * sign.astype(np.float64))
        rest = rest >> LIMB
    return out


class Gram:
    """The exact sum of y y^T over many matrices y, as sums of products of limbs by their place value."""

    def __init__(self, width: int) -> None:
        self.width, self.places = width, []

    def add(self, y: np.ndarray) -> None:
        parts = limbs(y)
        for k, a in enumerate(parts):
            for m in range(k, len(parts)):
                product = (a.T @ parts[m]).astype(np.int64)  # exact
                if m > k:
                    product = product + product.T
                while len(self.places) <= k + m:
                    self.places.append(np.zeros((self.width, self.width), np.int64))
                self.places[k + m] += product
        if max(int(np.abs(p).max(initial=0)) for p in self.places) >= 1 << 60:
            self.carry()

    def carry(self) -> None:
        """Hand what exceeds LIMB bits on to the next place; only the last place has a sign."""
        carry(self.places, LIMB)

    def digits(self) -> list[np.ndarray]:
        """The sum as digits of DIGIT bits, the lowest first; only the last one has a sign."""
        self.carry()
        per = DIGIT // LIMB
        return [sum(p << (LIMB * i) for i, p in enumerate(self.places[at : at + per])) for at in range(0, len(self.places), per)]


def carry(places: list[np.ndarray], bits: int) -> None:
    """Hand what exceeds ``bits`` bits of each place on to the next, until the last one is small; that one keeps its sign."""
    at = 0
    while at < len(places):
        last = at + 1 == len(places)
        if not last or int(np.abs(places[at]).max(initial=0)) >= 1 << bits:
            if last:
                places.append(np.zeros_like(places[at]))
            places[at + 1] += places[at] >> bits
            places[at] &= (1 << bits) - 1
        at += 1


def _sums(width: int):
    """(at, high, low): a task's sums of each dimension, in two halves; at -1 the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for _, x in _chunks(batches, "v", width):
            n += len(x)
            if x.dtype == object:
                sums = x.sum(axis=0).tolist()
            else:  # in halves, which no chunk's sum takes beyond 64 bits
                sums = [(h << 32) + low for h, low in zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
            total = [t + s for t, s in zip(total, sums, strict=True)]
        if n:
            flat = [n, *total]
            yield pa.record_batch({"at": pa.array(range(-1, width), pa.int32()), "high": pa.array([s >> 32 for s in flat], pa.decimal128(38, 0)), "low": pa.array([s & 0xFFFFFFFF for s in flat], pa.int64())})

    return run


def _products(width: int, n: int, sums: list[int]):
    """(salt, i, digit, values): each row of a task's Gram matrix, digit by digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(width)
        for _, x in _chunks(batches, "v", width):
            gram.add(centred(x, n, sums))
        salt = TaskContext.get().partitionId() % SALTS
        for d, m in enumerate(gram.digits() if gram.places else []):
            yield _digit_rows(np.full(width, salt), np.arange(width), np.full(width, d), list(m))

    return run


def _digit_rows(salt, i, d, values) -> pa.RecordBatch:
    return pa.record_batch({"salt": pa.array(salt, pa.int32()), "i": pa.array(i, pa.int32()), "digit": pa.array(d, pa.int32()), "m": pa.array([v.astype(np.int64).tobytes() for v in values], pa.binary())})


DIGITS = "salt int, i int, digit int, m binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows that agree in salt, i and digit, which lie one after another. Digits are summed without
    carrying: less than 2^31 of them can't leave a long."""
    last, held = None, None
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("salt", "i", "digit")), strict=True)
        for key, raw in zip(keys, batch.column("m").to_pylist(), strict=True):
            values = np.frombuffer(raw, np.int64)
            if key == last:
                held = held + values
                continue
            if last:
                yield _digit_rows([last[0]], [last[1]], [last[2]], [held])
            last, held = key, values
    if last:
        yield _digit_rows([last[0]], [last[1]], [last[2]], [held])


def fit_sums(vectors: DataFrame, vector: str = "embedding") -> tuple[int, int, list[int]]:
    """The width of the widest vector, the number of vectors and the exact sum of each dimension."""
    v = vectors.select(F.col(vector).alias("v"))
    width = v.agg(F.max(F.size("v"))).first()[0] or 0
    rows = v.mapInArrow(_sums(width), "at int, high decimal(38, 0), low bigint").groupBy("at").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38, 0)")).alias("low")).collect()
    total = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return width, total.get(-1, 0), [total.get(j, 0) for j in range(width)]


def exact_gram(vectors: DataFrame, width: int, n: int, sums: list[int], vector: str = "embedding") -> np.ndarray:
    """The sum of (n * x - S) (n * x - S)^T over all vectors, as Python integers."""
    rows = vectors.select(F.col(vector).alias("v")).mapInArrow(_products(width, n, sums), DIGITS)
    for keys in (["salt", "i"], ["i"]):
        rows = rows.repartition(*keys).sortWithinPartitions("salt", "i", "digit").mapInArrow(_merged, DIGITS)
        rows = rows.withColumn("salt", F.lit(0))
    out = np.zeros((width, width), object)
    for r in store(rows, "gram").collect():
        out[r["i"]] += np.frombuffer(r["m"], np.int64).astype(object) * (1 << (DIGIT * r["digit"]))
    return out


class Whitening:
    """n, the sums, the leading components as columns, their variances, and the trace of the covariance of x."""

    def __init__(self, width: int, n: int, sums: list[int], gram: np.ndarray, components: int = COMPONENTS) -> None:
        self.width, self.n, self.sums = width, n, sums
        v = np.array([[c / n**3 for c in row] for row in gram.tolist()]).reshape(width, width)  # integers: rounded once
        self.covariance, self.trace = v, sum(gram[j, j] for j in range(width)) / n**3
        values, vectors = np.linalg.eigh(v)
        k = min(components, width)
        self.variances, self.components = values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy()
        self.components *= np.where(self.components[np.abs(self.components).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        self.varies = self.variances > np.finfo(float).eps * width * max(0.0, float(values[-1]))  # else no variance is left

    def project(self, y: np.ndarray) -> np.ndarray:
        """The whitened components of rows of n * x - S; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (y.astype(np.float64) / self.n) @ self.components / np.sqrt(self.variances)
        z[:, ~self.varies] = np.nan
        return z


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all good vectors; None if there are none or they have no dimension."""
    v = good_vectors(vectors.select(vector), vector)
    width, n, sums = fit_sums(v, vector)
    if not n or not width:
        return None
    return Whitening(width, n, sums, exact_gram(v, width, n, sums, vector), components)


def _covariance(model: Whitening):
    """(i, j, v): a task's sums of whitened values (j is -1) and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _chunks(batches, "v", model.width):
            z = np.nan_to_num(model.project(centred(x, model.n, model.sums)))
            first += z.sum(axis=0)
            second += z.T @ z
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.record_batch({"i": pa.array([*range(k), *i.tolist()], pa.int32()), "j": pa.array([-1] * k + j.tolist(), pa.int32()), "v": np.concatenate([first, second.ravel()])})

    return run


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened values' covariance, taken from the rows, minus the identity; components without
    variance don't count."""
    rows = good_vectors(vectors.select(vector), vector).select(F.col(vector).alias("v")).mapInArrow(_covariance(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = len(model.variances)
    mean, second = np.zeros(k), np.zeros((k, k))
    for r in rows:
        if r["j"] < 0:
            mean[r["i"]] = r["v"] / model.n
        else:
            second[r["i"], r["j"]] = r["v"] / model.n
    off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(model.varies, model.varies)]
    return float(off.max(initial=0.0))


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for part, x in _chunks(batches, "v", model.width):
            y = centred(x, model.n, model.sums)
            z = model.project(y)
            if y.dtype != object and model.width * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
                deviation = (y * y).sum(axis=1)
            else:
                deviation = np.array([min(LONG, sum(int(c) * int(c) for c in row)) for row in y.tolist()], np.int64)
            row = pa.array(np.repeat(np.arange(len(z)), k))
            flat = z.ravel()
            yield pa.record_batch([part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.repeat(deviation, k)), pa.array(flat, pa.float64(), mask=np.isnan(flat))], names=["row", "component", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """(row, component, deviation, whitened) for each row of ``vectors`` that has a good vector and each component; ``row`` has
    the columns ``keep``, or all. The model, which grows with the number of dimensions only, goes to the tasks."""
    rows = good_vectors(vectors, vector).select(F.struct(*(keep or vectors.columns)).alias("row"), F.col(vector).alias("v"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_whitened(model), f"row {kind}, component int, deviation bigint, whitened double")


def whiten_embeddings(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each good vector and component.

    Vectors that are null or hold null or non-finite entries are dropped. Vectors of different lengths are taken as if the shorter
    ended in zeros. Repeated rows and ids count each; a null vec_id stays null. There are as many components as dimensions, if these
    are fewer than ``components``. A component without variance (one vector, equal vectors, dependent dimensions) has a null
    ``whitened``, and ``explained`` is 0 if nothing varies; ``identity_error`` is over the others. A deviation beyond 64 bits counts
    as the largest long. Extra columns are not read. Without good vectors there are no rows.
    """
    vectors = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    model = fit(vectors, "v", components)
    if model is None:
        empty = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {empty}")
    error = identity_error(vectors, model, "v")
    shares = [max(0.0, float(e)) / model.trace if model.trace else 0.0 for e in model.variances]
    explained: Column = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("component"))
    rows = whiten(vectors, model, "v", ["vec_id"])
    return rows.select("row.vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
