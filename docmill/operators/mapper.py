"""Recognised lines to the fields of a document type.

What a line says by itself (its label, its value under every kind of field, whether it looks like a label) is worked out in
the JVM. Only the passes in which lines are used up one after another run in Python, a document at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import AMOUNT_FIELDS, BELOW, BELOW_X, DATE_FIELDS, DEFAULT_CONFIDENCE, ID_CARD, LABELS, RIGHT_SLACK, SAME_ROW, SOURCE_FACTORS
from ..functions import amounts, dates, identifiers
from ..functions import text as T
from .documents import per_document

MAPPED = "doc_id {id}, field_name string, value string, confidence double, raw_text string, source string, line_no int"


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _by_type(doc_type: Column, of: Callable[[list[tuple[str, str]]], Column]) -> Column:
    """What ``of`` makes of a type's synonyms (name, field), given in the order in which they win: the longest first, then the dictionary's order.

    A literal type leaves its own branch alone in the plan.
    """
    out = F
    for t, fields in LABELS.items():
        names: dict[str, str] = {}
        for f, synonyms in fields.items():
            for n in synonyms:
                names.setdefault(_plain(n), f)
        out = out.when(doc_type == t, of(sorted(names.items(), key=lambda x: -len(x[0]))))
    return out


def match_label(key: Column, doc_type: Column) -> Column:
    """The field of the longest synonym of the type that fits a label (ties: the first in the dictionary), or null.

    Synonyms under four characters must equal it; others may be contained in it or, from four characters on, contain it.
    """

    def best(k: Column) -> Column:
        def first(names: list[tuple[str, str]]) -> Column:
            out = F.when(k == "", F.lit(None).cast("string"))
            for name, field in names:
                inside = F.contains(k, F.lit(name)) | ((F.length(k) >= 4) & F.contains(F.lit(name), k))
                out = out.when(k == name if len(name) < 4 else inside, field)
            return out

        return _by_type(doc_type, first)

    return F.transform(F.array(T.alnum_key(key)), best)[0]  # the array binds the key, so that it is made once


def looks_like_label(text: Column, doc_type: Column) -> Column:
    """A synonym of three or more characters is in the line, and the line has at most four more."""

    def any_fits(k: Column) -> Column:
        def some(names: list[tuple[str, str]]) -> Column:
            out = F
            for n in sorted({len(name) for name, _ in names if len(name) >= 3}):
                # Names of n characters fit lines of at most n + 4: for a longer line none of them is looked for.
                out = out.when(F.length(k) <= n + 4, reduce(or_, [F.contains(k, F.lit(name)) for name, _ in names if len(name) >= n]))
            return out

        return _by_type(doc_type, some)

    return F.coalesce(F.transform(F.array(T.alnum_key(text)), any_fits)[0], F.lit(False))


KINDS = {"postleitzahl": "plz", "steueridentifikationsnummer": "tax_id", "dokumentnummer": "number", "steuerklasse": "tax_class", "veranlagungszeitraum": "year"}


def kind_of(field: str) -> str:
    return "amount" if field in AMOUNT_FIELDS else "date" if field in DATE_FIELDS else KINDS.get(field, "text")


def _kinds(t: Column) -> dict[str, Column]:
    """The value of a squeezed text without markup under each kind of field; null where it has none."""
    return {
        "amount": amounts.parse_amount(t).cast("string"), "date": dates.find_date(t), "plz": identifiers.postal_code(t), "tax_id": F.nullif(identifiers.tax_id_text(t), F.lit("")),
        "number": identifiers.document_number(t), "tax_class": identifiers.tax_class(t), "year": F.nullif(identifiers.assessment_year(t), F.lit("")), "text": F.nullif(t, F.lit("")),
    }


def coerced(s: Column, wanted: Column | None = None) -> Column:
    """The value of a text under each kind of field, or under those in the array ``wanted`` alone; null where it has none."""

    def values(t: Column) -> Column:
        return F.struct(*[(c if wanted is None else F.when(F.array_contains(wanted, k), c)).alias(k) for k, c in _kinds(t).items()])

    return F.transform(F.array(T.squeeze(T.strip_markup(s))), values)[0]


def coerce(field: Column, s: Column) -> Column:
    """The value of a text for a field given as a column; it is worked out under that field's kind alone."""

    def chosen(t: Column) -> Column:
        kinds, out = _kinds(t), F
        for kind, names in ((k, [f]) for f, k in KINDS.items()):
            out = out.when(field.isin(names), kinds[kind])
        return out.when(field.isin(list(DATE_FIELDS)), kinds["date"]).when(field.isin(list(AMOUNT_FIELDS)), kinds["amount"]).otherwise(kinds["text"])

    return F.transform(F.array(T.squeeze(T.strip_markup(s))), chosen)[0]


def _bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once a row: filters on it, and columns made of it, aren't rewritten in terms of what it is made of."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _labelled(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank with ``t`` (squeezed), ``kv``, ``inline`` (a label and a value in one line) and ``field``, which the label names."""
    rows = _bound(lines, "t", T.squeeze(F.col("text"))).where("t <> ''")
    rows = _bound(rows, "kv", T.split_at(F.col("t"), [":", "=", "\t"]))
    inline = (F.col("kv.key") != "") & (F.col("kv.value") != "")
    label = F.when(inline, F.col("kv.key")).when((F.col("kv.key") != "") & (F.col("kv.value") == ""), F.col("kv.key")).when(F.coalesce(F.col("kv.value"), F.lit("")) == "", F.col("t")).otherwise("")
    return _bound(rows.withColumn("inline", F.coalesce(inline, F.lit(False))), "field", match_label(label, F.col("doc_type")))


def _own() -> Column:
    """The inline value under the kind of the line's field."""
    return F.when(F.col("inline") & F.col("field").isNotNull(), coerce(F.col("field"), F.col("kv.value")))


def _confidence() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).cast("double"), F.lit(1.0)))


def read_lines(lines: DataFrame) -> DataFrame:
    """Lines with what each says by itself: label, inline value, coercions, and the three shapes looked for without a label."""
    rows = _bound(_labelled(lines), "labelish", looks_like_label(F.col("t"), F.col("doc_type")))
    # A whole line is a value only for a label of its document that has none in its own line, and only under that label's kind.
    kinds = F.create_map(*[F.lit(x) for f in sorted({f for fields in LABELS.values() for f in fields}) for x in (f, kind_of(f))])
    asked = F.collect_set(F.when(~F.col("inline"), F.element_at(kinds, F.col("field")))).over(Window.partitionBy("doc_id"))
    value = ~F.col("labelish") & F.col("x1").isNotNull() & (F.size("asked") > 0)
    rows = rows.withColumn("own", _own()).withColumn("asked", asked)
    rows = _bound(rows, "whole", F.when(value, coerced(F.col("t"), F.col("asked"))))
    shown = F.regexp_replace(F.col("t"), r"[^A-Za-zÄÖÜäöüß\s\-]", "")
    letters, upper = F.length(F.regexp_replace(shown, r"[^A-Za-zÄÖÜäöüß]", "")), F.length(F.regexp_replace(shown, r"[^A-ZÄÖÜ]", ""))
    surname = F.length(T.strip(shown)).between(2, 40) & (letters > 0) & (upper >= F.greatest(F.lit(2), letters - 1)) & (F.col("x1") >= 0.30) & ~F.col("labelish")
    return rows.select(
        "doc_id", "doc_type", "line_no", "t", _confidence().alias("confidence"), "x1", "y1", "x2", "y2", "inline", "field", "labelish", F.col("text").contains("<b>").alias("bold"),
        "own", *[F.col(f"whole.{k}").alias(f"whole_{k}") for k in ("amount", "date", "plz", "tax_id", "number", "tax_class", "year", "text")],
        F.nullif(F.regexp_extract(F.replace(F.col("t"), F.lit(" "), F.lit("")), r"\b([0-9]{11})\b", 1), F.lit("")).alias("p_tax"), F.when(~F.col("t").rlike(r"[0-9]{6,}"), identifiers.postal_code(F.col("t"))).alias("p_plz"),
        F.nullif(F.regexp_extract(F.col("t"), r"\b" + dates.DATE + r"\b", 0), F.lit("")).alias("p_date"), F.coalesce(surname, F.lit(False)).alias("surname"),
    )


class _Page:
    """The lines of one document and which of them are used up."""

    def __init__(self, rows: list) -> None:
        self.rows = rows
        self.used = [False] * len(rows)
        self.fields: dict[str, tuple] = {}

    def put(self, field: str, value: str | None, line, source: str) -> None:
        """Give a field a value, unless it has one of at least that confidence."""
        if value is None:
            return
        confidence = min(line.confidence * SOURCE_FACTORS.get(source, 0.7), 1.0)
        if field not in self.fields or self.fields[field][1] < confidence:
            self.fields[field] = (value, confidence, line.t, source, line.line_no)

    def free(self):
        return ((i, r) for i, r in enumerate(self.rows) if not self.used[i])

    def settled(self, field: str) -> bool:
        return field in self.fields and self.fields[field][3] == "inline"

    def neighbour(self, at: int) -> int | None:
        """The line that holds a label's value: the nearest to the right in its row, else the nearest below."""
        a = self.rows[at]
        if a.x1 is None:
            return None
        mid = (a.y1 + a.y2) / 2
        right, below = [], []
        for i, b in self.free():
            if i == at or b.x1 is None or b.labelish or b.bold:
                continue
            drop = (b.y1 + b.y2) / 2 - mid
            if abs(drop) <= SAME_ROW and b.x1 >= a.x1 and b.x1 - a.x2 >= RIGHT_SLACK:
                right.append((b.x1 - a.x2, i))
            elif 0 < drop <= BELOW and abs(b.x1 - a.x1) <= BELOW_X:
                below.append((drop, i))
        found = right or below
        return min(found)[1] if found else None

    def level(self, a, b) -> bool:
        ca, cb = (a.y1 + a.y2) / 2, (b.y1 + b.y2) / 2
        return abs(ca - cb) <= SAME_ROW or b.y1 <= ca <= b.y2


def _assign(lines: list) -> list[tuple]:
    page = _Page(sorted(lines, key=lambda r: r.line_no))
    doc_type = page.rows[0].doc_type
    for i, r in page.free():
        if r.inline and r.field is not None and not page.settled(r.field):
            page.put(r.field, r.own, r, "inline")
            page.used[i] = True
    for i, r in page.free():
        if r.inline or r.field is None or page.settled(r.field):
            continue
        j = page.neighbour(i)
        if j is not None:
            v = page.rows[j]
            page.put(r.field, getattr(v, "whole_" + kind_of(r.field)), v, "spatial-right" if page.level(r, v) else "spatial-below")
            page.used[j] = True
    for i, r in page.free():
        for field, value in (("steueridentifikationsnummer", r.p_tax), ("postleitzahl", r.p_plz), ("geburtsdatum", r.p_date)):
            if value is not None and field in LABELS.get(doc_type, {}) and field not in page.fields:
                page.put(field, value, r, "pattern")
                page.used[i] = True
                break
    if doc_type == ID_CARD and "familienname" not in page.fields:
        names = [(r.y1, i) for i, r in page.free() if r.surname and r.y1 < 1.0]
        if names:
            i = min(names)[1]
            page.put("familienname", page.rows[i].t, page.rows[i], "card-surname")
            page.used[i] = True
    rest = [(f"_line_{i + 1:04d}", r.t, min(r.confidence * 0.5, 0.49), r.t, "unmapped", r.line_no) for i, r in page.free()]
    return [(f, *v) for f, v in page.fields.items()] + rest


def map_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, confidence, raw_text, source, line_no) of recognised lines.

    Passes: inline values, values beside or below their labels, values by shape, a card's surname, and what is left.
    """
    rows = read_lines(lines).where("doc_id is not null")
    return per_document(rows, _assign, MAPPED.format(id=dict(rows.dtypes)["doc_id"]))


def inline_fields(lines: DataFrame) -> DataFrame:
    """The first pass alone, set-based: per document and field the inline value of highest confidence (ties: the earlier line)."""
    rows = _bound(_labelled(lines).where("inline and field is not null"), "value", _own()).where("value is not null").withColumn("confidence", _confidence())
    best = F.row_number().over(Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), "line_no"))
    return rows.withColumn("r", best).where("r = 1").select("doc_id", F.col("field").alias("field_name"), "value", "confidence", "line_no")


def spatial_pairs(lines: DataFrame) -> DataFrame:
    """Set-based association: for each label line (``is_label``) its nearest value line, right before below.

    Columns in: doc_id, line_no, is_label, x1, y1, x2, y2. An equality on doc_id carries the join; the rest are ranges
    within one document.
    """
    a = lines.where("is_label").select("doc_id", *[F.col(c).alias(f"a_{c}") for c in ("line_no", "x1", "y1", "x2", "y2")])
    b = lines.where("not is_label").select("doc_id", *[F.col(c).alias(f"b_{c}") for c in ("line_no", "x1", "y1", "x2", "y2")])
    drop = (F.col("b_y1") + F.col("b_y2")) / 2 - (F.col("a_y1") + F.col("a_y2")) / 2
    gap = F.col("b_x1") - F.col("a_x2")
    right = (F.abs(drop) <= SAME_ROW) & (F.col("b_x1") >= F.col("a_x1")) & (gap >= RIGHT_SLACK)
    below = (drop > 0) & (drop <= BELOW) & (F.abs(F.col("b_x1") - F.col("a_x1")) <= BELOW_X)
    rows = a.join(b, "doc_id").withColumn("side", F.when(right, 0).when(below, 1)).where("side is not null").withColumn("distance", F.when(F.col("side") == 0, gap).otherwise(drop))
    best = F.row_number().over(Window.partitionBy("doc_id", "a_line_no").orderBy("side", "distance", "b_line_no"))
    return rows.withColumn("r", best).where("r = 1").select("doc_id", F.col("a_line_no").alias("label_line"), F.col("b_line_no").alias("value_line"), F.when(F.col("side") == 0, "right").otherwise("below").alias("side"))
