"""Document types by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import TYPE_KEYWORDS, UNKNOWN


def keyword_counts(text: Column, keywords: dict[str, list[str]]) -> dict[str, Column]:
    """How many of each type's words a text contains, whatever their case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {kind: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for kind, words in keywords.items()}


def classify(text: Column, keywords: dict[str, list[str]] | None = None, unknown: str = UNKNOWN) -> Column:
    """The type with most words (ties: the first); ``unknown`` if no word occurs. The words are literals, so this is a projection, not a join."""
    counts = keyword_counts(text, TYPE_KEYWORDS if keywords is None else keywords)
    best = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, c) in enumerate(counts.items())]))
    return F.when(best["n"] > 0, best["kind"]).otherwise(F.lit(unknown))


def classify_documents(docs: DataFrame, keywords: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    return docs.withColumn("document_type", classify(F.col(text), keywords))


def label_from_filename(name: Column, labels: list[tuple[str, str]], other: str = "") -> Column:
    """The value of the first pair whose key is in the file name."""
    out = F.lit(other)
    for key, value in reversed(labels):
        out = F.when(F.lower(name).contains(key), value).otherwise(out)
    return out
