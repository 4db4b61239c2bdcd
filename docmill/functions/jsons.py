"""JSON that models and logs produce: salvage from fences and prose, and schema-forced reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _object(s: Column) -> Column:
    """The text if it is a JSON object, else null."""
    parsed = F.try_parse_json(s)
    return F.when(parsed.isNotNull() & F.ltrim(s).startswith("{"), s)


def unfenced(s: Column) -> Column:
    """Without the fences of a code block."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*\z", ""))


def braces(s: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))


def salvage(s: Column) -> Column:
    """The JSON object in a model's answer: the whole answer without fences, else what its outer braces hold, else null."""
    t = unfenced(s)
    return F.coalesce(_object(t), _object(braces(t)))


def salvage_loose(s: Column) -> Column:
    """Outer braces first, then the fenced block, then the whole text; objects only."""
    fenced = F.nullif(F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return F.coalesce(_object(braces(s)), _object(F.trim(fenced)), _object(F.trim(s)))


def read_strict(s: Column, schema: str) -> Column:
    """The struct of ``schema`` (DDL), or null if the text is no object of that shape."""
    field = f"{schema}, _bad string"
    parsed = F.from_json(salvage(s), field, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(parsed["_bad"].isNull(), parsed.dropFields("_bad"))
