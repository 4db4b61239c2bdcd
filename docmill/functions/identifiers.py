"""Checks of tax ids, account numbers, postal codes, streets and document numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import IBAN_LENGTHS
from .text import is_truncated, strip


def _bound(s: Column, f) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(s), f)[0]


def _digit(s: Column, i: Column) -> Column:
    return F.substr(s, i, F.lit(1)).cast("int")


def check_digit(ten: Column) -> Column:
    """The ISO 7064 MOD 11,10 check digit of ten digits."""
    step = lambda p, i: F.when((_digit(ten, i) + p) % 10 == 0, F.lit(20)).otherwise((_digit(ten, i) + p) % 10 * 2) % 11
    return (F.lit(11) - F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(10), step)) % 10


def tax_id_valid(s: Column) -> Column:
    """Eleven digits (blanks, ``-`` and ``/`` apart), no leading 0, one digit two or three times among the first ten and no other repeated, and the check digit."""
    def valid(d: Column) -> Column:
        ten = F.substring(d, 1, 10)
        counts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.length(ten) - F.length(F.replace(ten, k.cast("string"), F.lit(""))))
        repeated = F.filter(counts, lambda c: c > 1)
        return (F.size(repeated) == 1) & F.coalesce(F.get(repeated, F.lit(0)).isin(2, 3), F.lit(False)) & (check_digit(ten) == _digit(d, F.lit(11)))

    return _bound(F.regexp_replace(s, r"[ /-]", ""), lambda d: F.when(d.rlike(r"^[1-9][0-9]{10}\z"), valid(d)).otherwise(False))


def iban_remainder(s: Column) -> Column:
    """The account number, moved and spelt in digits, modulo 97."""
    moved = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    value = lambda i: F.ascii(F.substr(moved, i, F.lit(1)))
    step = lambda r, i: F.when(value(i) >= 65, (r * 100 + value(i) - 55) % 97).otherwise((r * 10 + value(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


def iban_valid(s: Column) -> Column:
    """Country and check digits, the country's length if it is known, and remainder 1; blanks and ``-`` do not count."""
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])

    def valid(t: Column) -> Column:
        length = F.try_element_at(lengths, F.substring(t, 1, 2))
        return F.coalesce(F.length(t) == length, F.lit(True)) & (iban_remainder(t) == 1)

    return _bound(F.upper(F.regexp_replace(s, "[ -]", "")), lambda t: F.when(t.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+\z"), valid(t)).otherwise(False))


def postal_code_valid(s: Column) -> Column:
    return F.coalesce(F.regexp_replace(s, "[ -]", "").rlike(r"^[0-9]{5}\z"), F.lit(False))


def street_valid(s: Column) -> Column:
    """2 to 100 characters of letters, digits, blanks and ``-./``, one of them a letter, and not cut off."""
    t = strip(s)
    ok = F.length(t).between(2, 100) & ~is_truncated(t) & t.rlike(r"^[A-Za-zÄÖÜäöüß0-9\s\-./]+\z") & t.rlike(r"[A-Za-zÄÖÜäöüß]")
    return F.coalesce(ok, F.lit(False))


def tax_id_text(s: Column) -> Column:
    """The digits, if there are eleven, else the text."""
    d = F.regexp_replace(s, r"[^0-9]", "")
    return F.when(F.length(d) == 11, d).otherwise(s)


def document_number(s: Column) -> Column:
    """Letters and digits in upper case, the first nine if there are as many; null without any."""
    t = F.upper(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    return F.nullif(F.when(F.length(t) >= 9, F.substring(t, 1, 9)).otherwise(t), F.lit(""))


def tax_class(s: Column) -> Column:
    """The first of I to VI that stands as a word."""
    return F.nullif(F.regexp_extract(F.upper(s), r"\b(I{1,3}|IV|V|VI)\b", 1), F.lit(""))


def assessment_year(s: Column) -> Column:
    """The first year of this or the last century, else the text."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"((19|20)[0-9]{2})", 1), F.lit("")), s)


def postal_code(s: Column) -> Column:
    """The first word of five digits."""
    return F.nullif(F.regexp_extract(s, r"\b([0-9]{5})\b", 1), F.lit(""))
