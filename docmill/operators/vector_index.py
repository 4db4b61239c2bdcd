"""A stored index for nearest vectors by cosine: cells around trained centroids, read a few at a time, ranked exactly.

``path/vectors`` holds the vectors, a folder a cell; ``path/cells-<n>`` the cells: centroid, number of vectors, and the least cosine
between centroid and vector. That number bounds what a cell can offer a query: if the query is at angle a from the centroid and
the farthest vector at angle r, no vector of the cell is nearer to the query than a - r. So a search may either read the ``probe``
cells with the nearest centroids (recall is measured, see :func:`probes_for`), or go on to every cell whose bound reaches the k-th best found:
that result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import exists, written
from .retrieval import nearest_in_scope

SAMPLE = 16_384  # vectors that centroids are trained on, at most: those with the least hashes of their ids
MOST_CELLS = 4_096
ROUNDS = 10
CELL_ROWS = 16_384  # rows of a cell that one task compares with queries at a time
TUNE = 1_024  # queries that the number of cells is fitted on, at most: those with the least hashes of their ids
NOWHERE = -1  # the cell of vectors without a direction (null, empty, zero, odd lengths), whose similarity to anything is 0
SLACK = 1e-9


def _units(rows: list, width: int) -> np.ndarray:
    """Unit vectors; a row of zeros for what has no direction."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        if v is not None and len(v) == width and None not in v:
            x = np.asarray(v, np.float64)
            n = float(np.sqrt((x * x).sum()))
            if np.isfinite(n) and n > 0:
                out[i] = x / n
    return out


def train(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; an empty cell gets the vector that is worst served."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        served = near[np.arange(len(sample)), own]
        for c in np.flatnonzero(norms == 0):
            worst = int(served.argmin())
            sums[c], norms[c], served[worst] = sample[worst], 1.0, 2.0
        centres = sums / norms[:, None]
    return centres


def _placed(centres: np.ndarray, column: int):
    """Rows with their cell and the cosine to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column(column).to_pylist(), centres.shape[1])
            near = x @ centres.T
            cell = near.argmax(axis=1) if len(near) else np.zeros(0, np.int64)
            far = near[np.arange(len(near)), cell] if len(near) else np.zeros(0)
            some = x.any(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(some, cell, NOWHERE), pa.int32()), pa.array(np.where(some, far, 0.0))], names=[*batch.schema.names, "cell", "__near"])

    return run


def _promising(centres: np.ndarray, numbers: np.ndarray, least: np.ndarray, limit: int | None):
    """(query_id, q, cell, place, bound) of each query: its cells, the nearest centroid first, all or the first ``limit``."""
    far = np.arccos(np.clip(least, -1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column(1).to_pylist(), centres.shape[1])
            angle = np.arccos(np.clip(x @ centres.T, -1, 1))
            bound = np.where(numbers[None, :] == NOWHERE, 0.0, np.where(x.any(axis=1)[:, None], np.cos(np.maximum(0, angle - far[None, :])), 0.0))
            order = np.argsort(angle, axis=1, kind="stable")[:, :limit]
            row = np.repeat(np.arange(len(x)), order.shape[1])
            yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(numbers[order.ravel()], pa.int32()), pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), len(x))), pa.array(bound[row, order.ravel()])], names=["query_id", "q", "cell", "place", "bound"])

    return run


class VectorIndex:
    """An index that :func:`build_index` stored; the driver holds its cells, of which there are MOST_CELLS at most."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        n = 0
        while exists(spark, f"{self.path}/cells-{n + 1}/_SUCCESS"):
            n += 1
        if not n:
            raise FileNotFoundError(f"no vector index in {path}")
        self.version = n
        cells = spark.read.parquet(f"{self.path}/cells-{n}").orderBy("cell").collect()
        self.id_col, self.vector = cells[0]["id_col"], cells[0]["vector"]
        width = max(len(c["centroid"]) for c in cells)
        self.numbers = np.array([c["cell"] for c in cells], np.int64)
        self.sizes = {c["cell"]: c["n"] for c in cells}
        self.least = np.array([c["least"] for c in cells])
        self.centres = np.array([[*c["centroid"], *[0.0] * (width - len(c["centroid"]))] for c in cells]).reshape(len(cells), width)

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """All vectors, or those of some cells, of which only the folders are read."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin([int(c) for c in cells]))

    def add(self, vectors: DataFrame) -> VectorIndex:
        """The index with more vectors: they go to the cells there are, whose bounds follow. Ids that are stored already are left out."""
        new = vectors.join(self.vectors().select(self.id_col), self.id_col, "left_anti")
        _store(self.spark, self.path, new, self.id_col, self.vector, self.centres[self.numbers != NOWHERE], self.version + 1)
        return VectorIndex(self.spark, self.path)

    def cells_of(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(query_id, q, cell, place, bound) of ``queries`` (query_id, q)."""
        kinds = queries.schema
        q = queries.select("query_id", "q")
        return q.mapInArrow(_promising(self.centres, self.numbers, self.least, limit), f"query_id {kinds['query_id'].dataType.simpleString()}, q {kinds['q'].dataType.simpleString()}, cell int, place int, bound double")

    def _ranked(self, asked: DataFrame, k: int) -> DataFrame:
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
        rows = self.vectors(wanted).withColumnRenamed(self.vector, "embedding")
        parts = F.lit(1)
        for c, n in self.sizes.items():  # a large cell is several groups
            if n > CELL_ROWS:
                parts = F.when(F.col("cell") == c, ceil(n / CELL_ROWS)).otherwise(parts)
        return nearest_in_scope(rows, asked.select("query_id", "q", "cell"), ["cell"], k, self.id_col, parts).select("query_id", self.id_col, "similarity", "rank")

    def search(self, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): each query's ``k`` nearest (ties: by id), in the ``probe`` cells with the nearest centroids; exactly, without
        ``probe``: cells are added until no other can hold a vector as near as the k-th found."""
        if probe is not None:
            return self._ranked(written(self.cells_of(queries, probe), "asked"), k)
        asked = written(self.cells_of(queries), "asked")
        first = written(self._ranked(asked.where(f"place < {max(1, ceil(sqrt(len(self.numbers)) / 2))}"), k), "first")
        reached = first.groupBy("query_id").agg(F.max("rank").alias("found"), F.min("similarity").alias("least"))
        rest = asked.where(f"place >= {max(1, ceil(sqrt(len(self.numbers)) / 2))}").join(reached, "query_id", "left")
        rest = written(rest.where(F.coalesce(F.col("found") < k, F.lit(True)) | (F.col("bound") >= F.col("least") - SLACK)).drop("found", "least"), "rest")
        more = self._ranked(rest, k).unionByName(first).drop("rank")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), self.id_col))
        return more.withColumn("rank", rank).where(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, sample: int = TUNE) -> int:
        """The least ``probe`` at which these queries, or a sample of ``sample`` of them, find the share ``recall`` of their exact k nearest: their
        neighbours' cells are looked up in each query's order of cells, so that one exact search answers for every ``probe``. All vectors
        are searched, whatever the sample; what recall other queries reach is to be measured by :meth:`search`."""
        queries = written(queries.select("query_id", "q").orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "tune")
        asked = written(self.cells_of(queries), "asked")
        true = self.search(queries, k).select("query_id", F.col(self.id_col).alias("__id"))
        at = self.vectors().select(F.col(self.id_col).alias("__id"), "cell")
        places = true.join(at, "__id").join(asked.select("query_id", "cell", "place"), ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
        total, seen = sum(r["n"] for r in places), 0
        for r in places:
            seen += r["n"]
            if seen >= recall * total:
                return r["place"] + 1
        return len(self.numbers)


def _store(spark: SparkSession, path: str, vectors: DataFrame, id_col: str, vector: str, centres: np.ndarray, version: int) -> None:
    at = vectors.columns.index(vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    rows = written(vectors.mapInArrow(_placed(centres, at), f"{kinds}, cell int, __near double"), "placed")
    # The rows of a cell come from few tasks, a large cell from several.
    rows.drop("__near").repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(4))).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    now = {r["cell"]: (r["n"], r["least"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("__near").alias("least")).collect()}
    before = {r["cell"]: (r["n"], r["least"]) for r in spark.read.parquet(f"{path}/cells-{version - 1}").collect()} if version > 1 else {}
    table = []
    for c in sorted(now.keys() | before.keys()):
        (n, least), (m, other) = now.get(c, (0, 1.0)), before.get(c, (0, 1.0))
        table.append((c, centres[c].tolist() if c != NOWHERE else [0.0] * centres.shape[1], n + m, min(least, other), id_col, vector))
    spark.createDataFrame(table, "cell int, centroid array<double>, n bigint, least double, id_col string, vector string").coalesce(1).write.parquet(f"{path}/cells-{version}")


def build_index(vectors: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Store all of ``vectors`` under ``path``. Centroids are trained on the driver from a sample of bounded size; every vector is indexed.

    Without ``cells`` there are as many as the square root of the rows, MOST_CELLS at most. Vectors that are null, empty, zero, not finite or of
    another length than the sample's most frequent one are in a cell of their own.
    """
    spark, path = vectors.sparkSession, path.rstrip("/")
    rows = [r[0] for r in vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col), id_col).select(vector).limit(sample).collect()]
    lengths = [len(r) for r in rows]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    units = _units(rows, width)
    units = units[units.any(axis=1)]
    n = cells or ceil(sqrt(vectors.count()))
    centres = train(units, max(1, min(n, MOST_CELLS, len(units)))) if len(units) else np.zeros((1, width))
    _store(spark, path, vectors, id_col, vector, centres, 1)
    return VectorIndex(spark, path)
