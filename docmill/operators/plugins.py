"""Model boundaries: engines that are loaded once in each task and fed Arrow batches.

The library holds no weights. An engine is a factory that returns an object with ``extract_batch(rows) -> rows`` (lists of
dicts); deterministic stand-ins are registered here for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written

LINES = "doc_id bigint, line_no int, text string, confidence double, engine string"


class Engine(Protocol):
    def extract_batch(self, rows: list[dict]) -> list[list[dict]]: ...


ENGINES: dict[str, Callable[[], Engine]] = {}


def register(name: str) -> Callable:
    def put(factory: Callable[[], Engine]) -> Callable[[], Engine]:
        ENGINES[name] = factory
        return factory

    return put


def run_engine(rows: DataFrame, name: str, schema: str = LINES, batch: int = 64) -> DataFrame:
    """Apply an engine to rows, ``batch`` at a time. A batch that fails is tried again row by row; rows that fail alone give nothing."""
    if name not in ENGINES:
        raise KeyError(f"no engine {name}; there are {sorted(ENGINES)}")
    factory = ENGINES[name]
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        engine, target = factory(), to_arrow_schema(kinds)
        for arrow in batches:
            items = arrow.to_pylist()
            for at in range(0, len(items), batch):
                part = items[at : at + batch]
                try:
                    found = engine.extract_batch(part)
                except Exception:  # an engine may fail in any way; its rows are tried alone
                    found = []
                    for item in part:
                        try:
                            found += engine.extract_batch([item])
                        except Exception:
                            found.append([])
                yield pa.RecordBatch.from_pylist([x for f in found for x in f], schema=target)

    return rows.mapInArrow(run, kinds)


@register("lines")
class LineEngine:
    """Stands for a recogniser: the text's lines with a confidence by their length."""

    name = "lines"

    def extract_batch(self, rows: list[dict]) -> list[list[dict]]:
        return [
            [{"doc_id": r["doc_id"], "line_no": i, "text": t, "confidence": min(1.0, len(t) / 100), "engine": self.name} for i, t in enumerate((r["text"] or "").split("\n"), 1) if t.strip()]
            for r in rows
        ]


@register("brittle")
class BrittleEngine(LineEngine):
    """Fails on a batch that holds an empty text, as a recogniser does on a broken image."""

    name = "brittle"

    def extract_batch(self, rows: list[dict]) -> list[list[dict]]:
        if any(not r["text"] for r in rows):
            raise ValueError("cannot read")
        return super().extract_batch(rows)


@register("sure")
class SureEngine(LineEngine):
    """Stands for a fast recogniser: the same lines, all of good confidence."""

    name = "sure"

    def extract_batch(self, rows: list[dict]) -> list[list[dict]]:
        return [[{**x, "confidence": 0.9} for x in found] for found in super().extract_batch(rows)]


#: What the stand-in of a vision model answers to every page: fixed values.
CANNED_FIELDS = [
    ("familienname", "Müller", 0.95), ("vorname", "Hans", 0.93), ("geburtsdatum", "15.03.1985", 0.91), ("geburtsort", "Berlin", 0.88), ("staatsangehoerigkeit", "Deutsch", 0.92),
    ("strasse", "Hauptstraße", 0.85), ("hausnummer", "42", 0.97), ("postleitzahl", "10115", 0.96), ("wohnort", "Berlin", 0.94),
]
CANNED = "doc_id bigint, field_name string, raw_value string, confidence double"


@register("canned")
class CannedEngine:
    """Stands for a vision model: the same nine fields for every page."""

    def extract_batch(self, rows: list[dict]) -> list[list[dict]]:
        return [[{"doc_id": r["doc_id"], "field_name": f, "raw_value": v, "confidence": c} for f, v, c in CANNED_FIELDS] for r in rows]


FAST_ENGINES = ["apple-vision", "apple", "vision", "tiered"]


def engine_of_setting(setting: Column, fast_available: Column) -> Column:
    """``apple-vision`` if the setting names it (or ``tiered``) and it is available; else ``surya``. Case and outer blanks do not count."""
    return F.when(F.lower(F.trim(setting)).isin(*FAST_ENGINES) & fast_available, "apple-vision").otherwise("surya")


def run_tiered(rows: DataFrame, fast: str, full: str, min_lines: int = 3, min_confidence: float = 0.55) -> DataFrame:
    """The fast engine's lines, but those of the full one for pages with fewer than ``min_lines`` lines or a mean confidence under
    ``min_confidence``, if it has at least as many there. Only such pages are read by both."""
    first = written(run_engine(rows, fast), "tiered")
    seen = first.groupBy("doc_id").agg(F.count("*").alias("__n"), F.avg("confidence").alias("__c"))
    weak = rows.join(seen, "doc_id", "left").where((F.coalesce("__n", F.lit(0)) < min_lines) | (F.col("__c") < min_confidence))
    second = written(run_engine(weak.select(*rows.columns), full), "tiered")
    better = second.groupBy("doc_id").agg(F.count("*").alias("__m")).join(seen, "doc_id", "left").where(F.col("__m") >= F.coalesce("__n", F.lit(0))).select("doc_id")
    return first.join(better, "doc_id", "left_anti").unionByName(second.join(better, "doc_id", "left_semi"))
