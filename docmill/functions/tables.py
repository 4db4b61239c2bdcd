"""Table functions for SQL: the lines of a text, and the first line with each key of each document.

``register(spark)`` makes them known by name::

    select d.doc_id, f.* from documents d, lateral text_key_values(d.text) f
    select * from first_keys(table(select doc_id, line_no, key, value from lines))

The engine's own operators say the same as expressions (``lines.text_fields``), which stay in the JVM and are what large tables should
take; these serve where a query is written as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")


class KeyValues:
    """(line_no from 1, key, value) of each line of a text that has a key and a value: at the first colon, else two parts around bars."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("text_key_values takes a text")
        return AnalyzeResult(StructType().add("line_no", IntegerType()).add("key", StringType()).add("value", StringType()))

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        for i, line in enumerate(BREAK.split(text or "")):
            line = " ".join(line.split())
            if ":" in line:
                key, _, value = line.partition(":")
            else:
                parts = [p.strip() for p in line.split("|") if p.strip()]
                if "|" not in line or len(parts) != 2:
                    continue
                key, value = parts
            if key.strip() and value.strip():
                yield i + 1, key.strip(), value.strip()


class FirstKeys:
    """Of a table with doc_id, line_no, key and value: the first line with each key of each document, numbered from 1.

    The table is dealt by doc_id and read in the order of line_no, which :meth:`analyze` asks for; a task holds the keys of one document.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or not {"doc_id", "line_no", "key", "value"} <= set(lines.dataType.names):
            raise ValueError("first_keys takes a table with doc_id, line_no, key and value")
        kind = lines.dataType["doc_id"].dataType
        schema = StructType().add("doc_id", kind).add("pos", IntegerType()).add("line_no", IntegerType()).add("key", StringType()).add("value", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("line_no")])

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["key"] is not None and row["key"] not in self.seen:
            self.seen.add(row["key"])
            yield row["doc_id"], len(self.seen), row["line_no"], row["key"], row["value"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_key_values", udtf(KeyValues))
    spark.udtf.register("first_keys", udtf(FirstKeys))
