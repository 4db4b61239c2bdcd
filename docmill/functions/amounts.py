"""German amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first amount in a text.
AMOUNT = r"(\d{1,3}(?:\.\d{3})+(?:,\d{2})?|\d+(?:,\d{2})?)\s*(?:€|EUR)?"


def parse_amount(s: Column) -> Column:
    """The first amount of a text as a double. A decimal comma makes dots thousands; without one, so do three digits after the last dot."""
    raw = F.nullif(F.regexp_extract(s, AMOUNT, 1), F.lit(""))
    comma = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    dots = F.when(raw.rlike(r"\.\d{3}\z"), F.replace(raw, F.lit("."), F.lit(""))).otherwise(raw)
    return F.when(raw.contains(","), comma).otherwise(dots).try_cast("double")


def parse_whole(s: Column) -> Column:
    """A text that is nothing but an amount (currency apart) as a double, else null; used to compare values."""

    def number(t: Column) -> Column:
        comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        dots = F.when(t.rlike(r"\.\d{3}\z"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
        return F.when(t.rlike(r"^[0-9.,]+\z"), F.when(t.contains(","), comma).otherwise(dots).try_cast("double"))

    return F.transform(F.array(F.trim(F.regexp_replace(s, r"€|EUR", ""))), number)[0]


def close(a: Column, b: Column) -> Column:
    """Equal to half a cent."""
    return F.abs(a - b) < F.lit(0.005)


def german_amount(x: Column) -> Column:
    """``45236.0`` as ``45.236,00``."""
    return F.translate(F.format_number(x, 2), ",.", ".,")
