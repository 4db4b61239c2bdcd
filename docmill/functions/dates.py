"""German dates and the rules on them; rules take the day on which they are applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: day, month and year of this or the last century.
DATE = r"(0[1-9]|[12]\d|3[01])\.(0[1-9]|1[0-2])\.((?:19|20)\d{2})"


def has_date_shape(s: Column) -> Column:
    return F.coalesce(F.trim(s).rlike("^" + DATE + r"\z"), F.lit(False))


def parse_date(s: Column, as_of: Column, allow_future: bool = False) -> Column:
    """The date of a text of that shape; null for impossible days and, unless allowed, for days after ``as_of``."""
    d = F.when(has_date_shape(s), F.try_to_date(F.trim(s), "dd.MM.yyyy"))
    return d if allow_future else F.when(d <= as_of, d)


def find_date(s: Column) -> Column:
    """The first date in a text with stray blanks and repeated dots, as text."""
    clean = F.regexp_replace(F.replace(s, F.lit(" "), F.lit("")), r"\.{2,}", ".")
    return F.nullif(F.regexp_extract(clean, r"(?<![\p{L}\p{N}_])" + DATE + r"(?![\p{L}\p{N}_])", 0), F.lit(""))


def birthdate_message(s: Column, as_of: Column, max_age_days: int = 54_750) -> Column:
    """Null if the birth date holds, else why not."""
    d = parse_date(s, as_of)
    return F.when(d.isNull(), "Ungueltiges Geburtsdatum (nicht parsierbar).").when(F.datediff(as_of, d) > max_age_days, "Geburtsdatum unplausibel (aelter als 150 Jahre).")


def expiry_message(s: Column, as_of: Column) -> Column:
    d = parse_date(s, as_of, allow_future=True)
    return F.when(d.isNull(), "Ungueltiges Ablaufdatum (nicht parsierbar).").when(d < as_of, "Dokument ist abgelaufen.")


def move_in_message(s: Column, as_of: Column) -> Column:
    return F.when(parse_date(s, as_of).isNull(), "Ungueltiges Einzugsdatum.")
