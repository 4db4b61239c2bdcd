"""Mixing sources to target weights by Pfair scheduling. The rows see DataFrame functions only; the schedule of the blocks, one
row a block, is worked out on the driver."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_rows

BLOCK = 65_536  # size units of a block, at least
MAX_BLOCKS = 1 << 19  # blocks of all sources, about: where there would be more, each is larger


def schedule(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(place of the source, k, slot, release, deadline) of all blocks, by slot; source i has ``blocks[i]`` of them.

    Block k of a source whose part of all weights is w is released at floor(k / w) and due by ceil((k + 1) / w), in exact
    integers. Each slot takes, of the released blocks, the one with the earliest deadline (ties: the first source). The
    windows can all be met, so at every slot a source that has not ended is less than one block from w times the slots.
    """
    ratios = [w.as_integer_ratio() for w in weights]
    common = math.lcm(*(d for _, d in ratios))
    n = [a * (common // d) for a, d in ratios]
    q = sum(n)
    ready = [(-(-q // n[i]), i, 0, 0) for i in range(len(n)) if blocks[i] > 0]
    later: list[tuple[int, int, int]] = []  # (release, source, k)
    heapify(ready)
    slot = 0
    while ready or later:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            release, i, k = heappop(later)
            heappush(ready, (-(-(k + 1) * q // n[i]), i, k, release))
        deadline, i, k, release = heappop(ready)
        yield i, k, slot, release, deadline
        if k + 1 < blocks[i]:
            heappush(later, ((k + 1) * q // n[i], i, k + 1))
        slot += 1


def plan_blocks(rounds: list[tuple[dict[str, float], dict[str, int]]]) -> pa.Table:
    """The schedules of (weights, blocks) by source, one round after another: one row a block."""
    schema = pa.schema([("__t_source", pa.string()), *[(k, pa.int64()) for k in ("__j", "__slot", "__release", "__deadline")], ("round", pa.int32())])
    tables = [schema.empty_table()]
    for r, (weights, blocks) in enumerate(rounds):
        names = sorted(weights)
        flat = array("q")
        for row in schedule([weights[k] for k in names], [blocks[k] for k in names]):
            flat.extend(row)
        cells = np.frombuffer(flat, np.int64).reshape(-1, 5)
        columns = [pa.array(names, pa.string()).take(pa.array(cells[:, 0])), *(pa.array(cells[:, i]) for i in range(1, 5)), pa.array(np.full(len(cells), r, np.int32))]
        tables.append(pa.Table.from_arrays(columns, schema=schema))
    return pa.concat_tables(tables)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: Column | None = None, block: int = BLOCK, source: str = "source", order: list[str] | None = None, power: float = 0.7) -> DataFrame:
    """Interleave the sources of ``docs`` so that at every slot each has had its weight's part of the slots, to less than one block.

    Rows of a source are put in the order of a hash of ``order`` and the size and cut into blocks of ``block`` units of ``size`` (default:
    characters of the text plus 1); a row belongs to the block in which it starts. Block k gets ``release``, ``deadline`` and
    ``slot``; reading the rows by (``slot``, ``place``) gives the mixture. ``weights`` that are not given are the sources'
    sizes to the power ``power``; sources without a weight, or with weight 0, follow after all others by the same rule
    (weights from sizes). No row is dropped or repeated: when a source ends, its slots stay empty and the others go on in
    their proportions. A null source is a source of its own, named ''; it shares that name with an empty one. Columns named
    like the results are replaced.

    There may be any number of sources. A corpus of more than MAX_BLOCKS blocks gets blocks of a MAX_BLOCKS-th of its size, so
    the driver, which schedules them, never holds more than MAX_BLOCKS rows and two a source. A row longer than a block leaves the blocks after the one in which it starts without rows: the
    deviation is less than one block in blocks, but what a source has had in units may differ by its longest row more.
    """
    spark = docs.sparkSession
    order = order or ["doc_id"]
    size = F.length(F.coalesce(F.col("text"), F.lit(""))) + 1 if size is None else size
    docs = docs.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("__size", size.cast("bigint"))
    found = docs.groupBy("__source").agg(F.sum("__size").alias("n")).toArrow()
    sizes = dict(zip(found.column(0).to_pylist(), (n or 0 for n in found.column(1).to_pylist()), strict=True))
    block = max(int(block), -(-sum(sizes.values()) // MAX_BLOCKS))
    # A row of size 0 may begin where the last block ends.
    blocks = {k: n // block + 1 for k, n in sizes.items()}
    table = plan_blocks([(group, blocks) for group in _rounds({k: float(n) + 1 for k, n in sizes.items()}, weights, power)])
    plan = spark.createDataFrame(table)
    if table.num_rows <= 2 * MAX_BLOCKS:  # more rows only where there are as many sources
        plan = F.broadcast(plan)
    rows = _blocks(docs, order, block)
    rows = rows.drop("slot", "release", "deadline", "round").join(plan, (F.col("__source") == F.col("__t_source")) & (F.col("block") == F.col("__j")), "left")
    rows = rows.withColumns({"slot": F.col("__slot"), "release": F.col("__release"), "deadline": F.col("__deadline")})
    return rows.drop("__source", "__size", "__start", "__t_source", "__j", "__slot", "__release", "__deadline")


def _rounds(sizes: dict[str, float], weights: dict[str, float] | None, power: float) -> list[dict[str, float]]:
    """Weights of the sources that have one, then of the others."""
    first = {k: w for k, w in (weights or {k: v**power for k, v in sizes.items()}).items() if k in sizes and w > 0}
    rest = {k: v**power for k, v in sizes.items() if k not in first}
    return [x for x in (first, rest) if x]


def _blocks(docs: DataFrame, order: list[str], block: int) -> DataFrame:
    rows = number_rows(docs, ["__source"], [*[F.col(c) for c in order], F.col("__size")], "__start", F.col("__size"))
    return rows.withColumn("block", F.expr(f"__start div {int(block)}")).withColumn("place", F.col("__start") % int(block))
