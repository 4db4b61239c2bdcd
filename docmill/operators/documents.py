"""Imperative steps within a document: its rows come as one list, many documents to an Arrow batch."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def per_document(rows: DataFrame, step: Callable[[list], list[tuple]], schema: str | StructType, key: str = "doc_id") -> DataFrame:
    """Apply ``step`` to the rows (named tuples, in no order) of each document; it returns the other columns of ``schema``,
    which begins with the key. A list is one document's rows, so its size does not grow with the input."""
    names = [c for c in rows.columns if c != key]
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, record = to_arrow_schema(kinds), namedtuple("Line", names)
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            at, out = [], []
            for i, items in enumerate(lists.to_pylist()):
                found = step([record(**x) for x in items])
                at += [i] * len(found)
                out += found
            columns = [ids.take(pa.array(at, pa.int32())), *[pa.array([r[k] for r in out], f.type) for k, f in enumerate(list(target)[1:])]]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return rows.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("rows")).mapInArrow(run, kinds)
