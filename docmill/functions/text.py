"""Text functions over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"
LINE_BREAK = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"


def squeeze(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, SPACE + "+", " "))


def strip(s: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+\z", "")


def blank(s: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(s) == "", F.lit(True))


def lines(s: Column) -> Column:
    """The lines of a text; an empty or null text has none, and a break at the end opens no further line."""

    def without_end(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)

    split = F.transform(F.array(F.split(s, LINE_BREAK)), without_end)[0]  # the array binds the parts, so that they are made once
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(split)


def alnum_key(s: Column) -> Column:
    """Lower case, letters and digits only: the form in which labels are compared."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def field_name(s: Column, empty: str = "", longest: int = 80) -> Column:
    """A label as a field name: other characters than letters and digits as one underscore, none at the ends, ``field_`` before a leading digit."""
    name = F.regexp_replace(F.regexp_replace(F.lower(strip(s)), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+\z", "")
    name = F.when(name.rlike(r"^\p{N}"), F.concat(F.lit("field_"), name)).otherwise(name)
    name = F.substring(name, 1, longest)
    return F.when(name == "", F.lit(empty)).otherwise(name)


def strip_markup(s: Column) -> Column:
    """Without the tags that recognisers put into lines (bold, line break)."""
    return F.regexp_replace(s, r"</?b>|<br\s*/?>", " ")


def strip_tags(s: Column) -> Column:
    """Every tag as a blank, squeezed."""
    return squeeze(F.regexp_replace(s, r"<[^>]+>", " "))


def unescape(s: Column) -> Column:
    """The five named entities of XML and the no-break space, the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return s


def receipt_text(s: Column) -> Column:
    """The form in which receipt fields are compared: no location tokens or tags, lower case, a small character set."""
    s = F.regexp_replace(unescape(F.coalesce(s, F.lit(""))), r"<\|LOC_[0-9]+\|>|<[^>]+>", " ")
    return squeeze(F.regexp_replace(F.lower(s), r"[^a-z0-9./:& -]+", " "))


def split_at(s: Column, separators: list[str], both: bool = False) -> Column:
    """(key, value) at the first separator *of the list* that occurs (not the first in the text).

    With ``both``, a separator counts only if both sides are not blank. Without any, null.
    """
    out = F.lit(None).cast("struct<key:string,value:string>")
    for sep in reversed(separators):
        at = F.instr(s, sep)
        key, value = strip(F.substr(s, F.lit(1), at - 1)), strip(F.substr(s, at + len(sep)))
        here = (at > 0) & ((key != "") & (value != "") if both else F.lit(True))
        out = F.when(here, F.struct(key.alias("key"), value.alias("value"))).otherwise(out)
    return out


def field_kind(s: Column) -> Column:
    """Guess: 6 digits or more and one of ``./-`` is a date; half of the characters digits, a number; else text."""
    digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
    return F.when((digits >= 6) & s.rlike(r"[./-]"), "date").when(digits >= F.greatest(F.lit(1), F.floor(F.length(s) / 2)), "number").otherwise("text")


def is_truncated(s: Column) -> Column:
    """Ends with an ellipsis or dots that stand for one."""
    return s.endswith("…") | s.endswith("...") | s.endswith("..")


def title(name: Column) -> Column:
    """A field name as a description."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def prompt_tokens(s: Column) -> Column:
    """Words / 0.75."""
    return F.when(blank(s), F.lit(0.0)).otherwise(F.size(F.split(squeeze(s), " ")) / F.lit(0.75))


def correction_tokens(s: Column) -> Column:
    """12 and one for every 3.5 characters."""
    return (F.lit(12) + F.floor(F.length(s) / F.lit(3.5))).cast("bigint")


def search_terms(s: Column, most: int = 8, shortest: int = 4) -> Column:
    """Up to eight terms of four or more of letters, digits, ``_`` and ``-``."""
    words = F.transform(F.split(s, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", ""))
    return F.slice(F.filter(words, lambda w: F.length(w) >= shortest), 1, most)


def error_rate(distance: Column, truth_length: Column, pred_length: Column) -> Column:
    """Edits by length of the truth; an empty truth: 0 if the prediction is empty too, else 1."""
    return F.when(truth_length == 0, F.when(pred_length == 0, 0.0).otherwise(1.0)).otherwise(distance / truth_length)


def char_error_rate(pred: Column, truth: Column) -> Column:
    return error_rate(F.levenshtein(pred, truth), F.length(truth), F.length(pred))


def words(s: Column) -> Column:
    """The words of a text; none for a blank one."""
    return F.filter(F.split(s, SPACE + "+"), lambda w: w != "")


def _word_distance(a: Column, b: Column) -> Column:
    """Edits between two lists of words. If one has no word but one at most, that is the other's number of words, less one if the word is among
    them; else each distinct word of both becomes one character, and the built-in counts characters."""

    def code(ws: Column, vocabulary: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: _letter(F.array_position(vocabulary, w))), "")

    spelt = F.transform(F.array(F.array_distinct(F.concat(a, b))), lambda v: F.levenshtein(code(a, v), code(b, v)))[0]
    most, least = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return F.when(a == b, 0).when(least <= 1, most - F.arrays_overlap(a, b).cast("int")).otherwise(spelt)


def _of_words(a: Column, b: Column, made: Callable[[Column, Column], Column]) -> Column:
    """What ``made`` makes of the words of two texts, which are split once; null if a text is null."""
    both = F.transform(F.array(F.struct(words(a).alias("a"), words(b).alias("b"))), lambda x: made(x["a"], x["b"]))[0]
    return F.when(a.isNotNull() & b.isNotNull(), both)


def word_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over words."""
    return _of_words(a, b, _word_distance)


def _letter(k: Column) -> Column:
    """A character for k: one of the first 94 as ASCII from ``!`` on, else the k-th code point from U+10000 on, as four-byte UTF-8: one for each
    of 1 048 576 distinct words, none a surrogate."""
    c = k.cast("int") + 0xFFFF

    def byte(shift: int, lead: int, mask: int) -> Column:
        return F.hex((F.shiftright(c, shift).bitwiseAND(F.lit(mask)) + lead).cast("bigint"))

    far = F.decode(F.unhex(F.concat(byte(18, 0xF0, 0x07), byte(12, 0x80, 0x3F), byte(6, 0x80, 0x3F), byte(0, 0x80, 0x3F))), "UTF-8")
    return F.when(k <= 94, F.char(k + 32)).otherwise(far)


def word_error_rate(pred: Column, truth: Column) -> Column:
    return _of_words(pred, truth, lambda p, t: error_rate(_word_distance(p, t), F.size(t), F.size(p)))


def folded(s: Column) -> Column:
    """For comparison without case: lower case with the sharp s as ss."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one decimal from KB on."""
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    scaled = n / F.pow(F.lit(1024.0), step)
    unit = F.element_at(F.array(F.lit("B"), F.lit("KB"), F.lit("MB"), F.lit("GB")), step + 1)
    return F.when(step == 0, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", F.round(scaled, 1)), F.lit(" "), unit))


def duration(ms: Column) -> Column:
    """Milliseconds as ``12ms`` or ``3.4s``."""
    return F.when(ms < 1000, F.concat(F.round(ms).cast("bigint").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", F.round(ms / 1000.0, 1)), F.lit("s")))


def percent(x: Column) -> Column:
    """A part of 1 as ``12.3%``."""
    return F.concat(F.format_string("%.1f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 100), F.lit("%"))


def summary_text(label: Column, form: Column, quality: Column, text: Column) -> Column:
    """Label, form, quality and the first 2000 characters of the text, a line each; an empty text adds no line."""
    label = F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown"))
    return F.concat_ws("\n", F.concat(F.lit("label="), label), F.concat(F.lit("form_type="), form), F.concat(F.lit("quality="), F.format_string("%.2f", quality)), F.nullif(F.substring(text, 1, 2000), F.lit("")))
