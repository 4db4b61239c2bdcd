"""Exact top-k by inner product with no random access to the lists (upper and lower score bounds over sorted lists).

Each dimension of a block of candidates is a list sorted by value. A query reads it from the end that its weight's sign
favours, all lists a step deeper at a time. What a candidate has not shown yet in a list is at most the last value read there
and at least the list's far end, so each candidate has an upper and a lower bound from what was read of it alone. Reading
stops when no candidate outside the few that are left can reach the k-th best; the final scores of these few are then
resolved. A task reads several blocks one after another for a block of queries and takes each query's k best along, so later
blocks end sooner. Many queries read a run of a list together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, store

QUERY_BLOCK = 512
TOGETHER = 128  # queries that read a list together
CELLS = 1 << 18  # components of a block of candidates, about
GROUP = 4  # blocks of candidates that a task reads one after another
HEAD = 8  # the first 1 / HEAD of a task's first block is read by itself, for a first limit
STEPS = (1 / 16, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8)  # parts of the lists after which bounds are looked at
FEW = 2  # reading stops when at most 1 / FEW of a block can still qualify: resolving these costs less than reading on
FOUND = "query_id bigint, vec_id bigint, score bigint"
LONG = 2**63 - 1


class Lists:
    """The sorted lists of one block of candidates: (ids, integer matrix), one list a dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.n, self.d = x.shape
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # row j: the candidates by their value in dimension j
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.rank = np.empty((self.n, self.d), np.int32)  # where each candidate stands in each list
        np.put_along_axis(self.rank, self.order.T, np.arange(self.n, dtype=np.int32)[:, None], axis=0)


def _kth(low: np.ndarray, k: int):
    """The k-th largest number."""
    if len(low) < k:
        return None
    return np.sort(low)[len(low) - k] if low.dtype == object else np.partition(low, len(low) - k)[len(low) - k]


def _cut(score):
    """Python integers as the nearest long; other numbers are smaller."""
    if isinstance(score, np.ndarray):
        return score if score.dtype != object else np.array([_cut(int(x)) for x in score.ravel()], object).reshape(score.shape)
    return max(-LONG - 1, min(LONG, score))


class Query:
    """One query: its id, its k best (-score, id) so far, sorted, and how many entries of the lists were read for it."""

    def __init__(self, own: int) -> None:
        self.own, self.best, self.entries = own, [], 0


def read(lists: Lists, state: list[Query], w: np.ndarray, k: int) -> None:
    """The queries ``state``, whose weights are the rows of ``w``, read the lists of one block."""
    n = lists.n
    up, down = np.maximum(w, 0), np.minimum(w, 0)  # read from the top, from the bottom
    floor = [-s.best[k - 1][0] if len(s.best) >= k else None for s in state]  # the k-th scores of earlier blocks
    ends = _cut(up @ lists.values[:, -1] + down @ lists.values[:, 0])
    live = np.array([i for i, f in enumerate(floor) if f is None or ends[i] >= f], np.int64)  # else not even the heads of the lists qualify
    sums = np.zeros((n, len(live)), w.dtype)
    before = 0
    for step, part in enumerate(STEPS):
        if not len(live):
            return
        depth = max(before, min(n, int(n * part) + 1))
        u, v = up[live], down[live]
        top, bottom = slice(n - depth, n - before), slice(before, depth)
        for j in range(lists.d):
            for weights, run in ((u[:, j], top), (v[:, j], bottom)):
                if weights.any():
                    who = lists.order[j, run]
                    part = sums.take(who, axis=0)  # apart, as numpy is slow at adding to chosen rows in place
                    part += np.multiply.outer(lists.values[j, run], weights)
                    sums[who] = part
        for i, m in zip(live.tolist(), (w[live] != 0).sum(axis=1).tolist(), strict=True):
            state[i].entries += (depth - before) * m
        before = depth
        unseen = np.concatenate([lists.rank < n - depth, lists.rank >= depth], axis=1).astype(w.dtype)
        last = np.concatenate([u * lists.values[:, n - depth], v * lists.values[:, depth - 1]], axis=1)
        high = _cut(sums + unseen @ last.T)
        limits = [floor[i] for i in live.tolist()]
        if None in limits:
            far = np.concatenate([u * lists.values[:, 0], v * lists.values[:, -1]], axis=1)
            low = _cut(sums + unseen @ far.T)
        keep = np.ones(len(live), bool)
        for c, i in enumerate(live.tolist()):
            s, inside = state[i], lists.ids != state[i].own
            limit = limits[c] if limits[c] is not None else _kth(low[inside, c], k)
            if limit is not None:
                inside &= high[:, c] >= limit
            if step == len(STEPS) - 1 or inside.sum() <= max(2 * k, n // FEW):
                keep[c] = False
                who = np.flatnonzero(inside)
                exact = _cut(lists.x[who] @ w[i])  # final scores of those that can still qualify
                if limit is not None:
                    who, exact = who[exact >= limit], exact[exact >= limit]
                s.best = sorted([*s.best, *zip((-exact).tolist(), lists.ids[who].tolist(), strict=True)])[:k]
        if not keep.all():
            live, sums = live[keep], np.ascontiguousarray(sums[:, keep])


def exact_kind(q: np.ndarray, x: np.ndarray) -> type:
    """The smallest kind of number that holds all sums of products and their bounds exactly: floats, or object (Python integers)."""
    if q.dtype == object or x.dtype == object:
        return object
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * 4 * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def as_kind(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object or x.dtype == object:
        return x.astype(kind)
    return np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def top_k(queries: tuple[np.ndarray, np.ndarray], blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> list[Query]:
    """The queries (ids, integer matrix) after they have read all blocks (ids, integer matrix), each with its k best rows; ties
    go to the smaller id, and a query is no candidate of its own."""
    qid, q = queries
    state = [Query(i) for i in qid.tolist()]
    for ids, x in _with_head(blocks):
        d = max(q.shape[1], x.shape[1])
        q, x = _wide(q, d), _wide(x, d)
        kind = exact_kind(q, x)
        lists, w = Lists(ids, as_kind(x, kind)), as_kind(q, kind)
        for at in range(0, len(state), TOGETHER):
            read(lists, state[at : at + TOGETHER], w[at : at + TOGETHER], k)
    return state


def _with_head(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, (ids, x) in enumerate(blocks):
        cut = len(ids) // HEAD if i == 0 else 0
        if cut:
            yield ids[:cut], x[:cut]
        yield ids[cut:], x[cut:]


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, d - m.shape[1]))) if m.shape[1] < d else m


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ids and integer matrix of an array of structs (id, v, x); shorter vectors end in zeros."""
    ids = column.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    v = column.field(1)
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.float64)
    out[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    if not np.isinf(out).any():
        return ids, out
    # Scaled components beyond the range of doubles: exact integers from the vectors themselves.
    rows = [[int(c) if np.isfinite(c) else int(raw[j]) * 64 for j, c in enumerate(row)] for row, raw in zip(out.tolist(), column.field(2).to_pylist(), strict=True)]
    return ids, np.array(rows, object).reshape(out.shape)


def quantise(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add ``v``: floor(64 * x) of each component x as a double, itself kept as a double, and ``x``, the vector itself where a
    scaled component leaves the range of doubles (else null). Rows with a null vector, or one that holds a null or not finite
    component, go; columns named ``v`` and ``x`` are replaced."""

    def scaled(x: Column) -> Column:
        y = x.cast("double") * F.lit(64.0)
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)  # larger doubles are integers

    wide = F.exists(vector, lambda x: F.abs(x.cast("double")) > F.lit(2.0**1017))
    good = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(good, F.lit(False))).withColumn("__x", F.when(wide, F.col(vector).cast("array<double>")))
    return rows.withColumn("v", F.transform(vector, scaled)).withColumn("x", F.col("__x")).drop("__x")


def _blocks(df: DataFrame, id_col: str, size: int, name: str) -> tuple[DataFrame, int]:
    """(name, rows): the rows in blocks of about ``size``, and the number of blocks. Repeated rows are dealt apart."""
    blocks = max(1, -(-df.count() // size))
    deal = F.pmod(F.xxhash64(id_col, F.monotonically_increasing_id()), F.lit(blocks).cast("bigint")).cast("int")
    rows = df.select(deal.alias(name), F.struct(F.col(id_col).cast("bigint").alias("id"), "v", "x").alias("r"))
    return rows.groupBy(name).agg(F.collect_list("r").alias("rows")), blocks


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows of ``vectors`` (columns id, ``v`` and ``x`` of :func:`quantise`), itself not counted.

    Ties go to the smaller id. Vectors of different lengths are compared as if the shorter ended in zeros. A row with a null id
    takes no part. Repeated ids are rows of their own. With fewer than k candidates all are returned; empty tables give none.
    A score beyond 64 bits counts as the nearest long.

    The stated queries meet all rows, block by block: every block of queries reads every block of candidates, GROUP of them in
    one task. A query's rank then sorts k rows a group of blocks.
    """
    vectors, queries = vectors.where(F.col(id_col).isNotNull()), queries.where(F.col(id_col).isNotNull())
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    q, nq = _blocks(queries, id_col, QUERY_BLOCK, "qb")
    c, nc = _blocks(vectors, id_col, max(64, CELLS // width), "cb")
    groups = -(-nc // GROUP)
    # Rows of a task: the block of queries (cb -1), then its blocks of candidates.
    asked = q.select("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cg"), F.lit(-1).alias("cb"), "rows")
    read = c.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.expr(f"cb div {GROUP}").cast("int").alias("cg"), "cb", "rows")
    dealt = asked.unionByName(read).repartition(nq * groups, "qb", "cg").sortWithinPartitions("qb", "cg", "cb")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py(), batch.column(3).slice(i, 1).flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = tasks(batches)
        row = next(rows, None)
        while row is not None:
            key, cb, asked_rows = row
            row = next(rows, None)
            if cb != -1:  # no query in this block
                continue

            def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                nonlocal row
                while row is not None and row[0] == key:
                    yield _matrix(row[2])
                    row = next(rows, None)

            found = [(s.own, j, -int(score)) for s in top_k(_matrix(asked_rows), blocks(), k) for score, j in s.best]
            a = np.array(found, np.int64).reshape(-1, 3)
            yield pa.record_batch({"query_id": a[:, 0], "vec_id": a[:, 1], "score": a[:, 2]})

    with batches_of(vectors.sparkSession, 1):
        found = store(dealt.mapInArrow(run, FOUND), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The query: rows whose vec_id is divisible by ``every`` against all other rows."""
    v = quantise(embeddings.select("vec_id", "embedding"))
    return search(v, v.where(F.col("vec_id") % every == 0), k)
