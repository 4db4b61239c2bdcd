"""From texts to lines to labelled fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import LOW_CONFIDENCE, MAX_FIELDS, MAX_LINE_CHARS, MAX_LINES, MAX_VALUE_CHARS
from ..functions import text as T


def text_lines(docs: DataFrame, text: str = "text", most: int = MAX_LINES) -> DataFrame:
    """(doc_id, line_no from 1, text squeezed) of the first ``most`` lines of each document; blank lines keep their number but go."""
    rows = docs.select("doc_id", F.posexplode(F.slice(T.lines(F.col(text)), 1, most)).alias("pos", "line"))
    # As an array of one that is unfolded, the squeezed line is made once, and not again in every filter that uses it.
    rows = rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.explode(F.array(T.squeeze(F.col("line")))).alias("text"))
    return rows.where(F.col("text") != "")


def key_value(line: Column) -> Column:
    """(key, value) of a line: at the first colon, else two parts that are not blank around bars; null if there is none."""
    parts = F.filter(F.transform(F.split(line, r"\|"), T.strip), lambda p: p != "")
    colon = F.struct(T.strip(F.substring_index(line, ":", 1)).alias("key"), T.strip(F.substr(line, F.instr(line, ":") + 1)).alias("value"))
    bar = F.struct(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))
    return F.when(line.contains(":"), colon).when(line.contains("|") & (F.size(parts) == 2), bar)


def text_fields(docs: DataFrame, text: str = "text", most_lines: int | None = MAX_LINES, most_chars: int | None = MAX_LINE_CHARS, most_fields: int | None = MAX_FIELDS, value_chars: int | None = MAX_VALUE_CHARS) -> DataFrame:
    """Field rows of plain texts: (doc_id, pos, field_name, value, confidence, status, raw_text).

    The first line with a name wins. By default the first 5 000 lines are read, lines over 500 characters are skipped, and a
    document gives at most its first 200 fields, in order; None for a limit lifts it. A document is one row, so its lines are
    steps over an array: there is no shuffle and no sort.
    """
    array = T.lines(F.col(text)) if most_lines is None else F.slice(T.lines(F.col(text)), 1, most_lines)
    some = F.filter(array, lambda x: x.contains(":") | x.contains("|"))  # no other line has a key and a value
    plain = F.transform(some, T.squeeze)
    if most_chars is not None:
        plain = F.filter(plain, lambda x: F.length(x) <= most_chars)
    pairs = F.filter(F.transform(plain, lambda x: F.struct(x.alias("raw_text"), key_value(x).alias("kv"))), lambda x: (x["kv"]["key"] != "") & (x["kv"]["value"] != ""))
    named = F.filter(F.transform(pairs, lambda x: F.struct(x["raw_text"].alias("raw_text"), x["kv"]["value"].alias("value"), T.field_name(x["kv"]["key"]).alias("field_name"))), lambda x: x["field_name"] != "")
    rows = docs.select("doc_id", named.alias("__f")).withColumn("__names", F.transform("__f", lambda x: x["field_name"]))
    first = F.filter("__f", lambda x, i: F.array_position("__names", x["field_name"]) == i + 1)
    rows = rows.select("doc_id", F.posexplode(first if most_fields is None else F.slice(first, 1, most_fields)).alias("p", "x"))
    confidence = F.when(F.length("x.value") >= 2, 0.65).otherwise(0.30)
    value = F.col("x.value") if value_chars is None else F.substring("x.value", 1, value_chars)
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), "x.field_name", value.alias("value"), confidence.alias("confidence"), downgrade(F.lit("EXTRACTED"), confidence).alias("status"), F.col("x.raw_text").alias("raw_text"))


def downgrade(status: Column, confidence: Column, corrected: Column | None = None) -> Column:
    """EXTRACTED under the threshold is LOW_CONFIDENCE; a correction overrides everything."""
    out = F.when((status == "EXTRACTED") & (confidence < LOW_CONFIDENCE), "LOW_CONFIDENCE").otherwise(status)
    return out if corrected is None else F.when(corrected, "CORRECTED").otherwise(out)


def with_text_fallback(fields: DataFrame, docs: DataFrame, text: str = "text", most: int | None = 5_000) -> DataFrame:
    """A ``_text`` row (the first ``most`` characters; None: the whole text) for each document without fields."""
    shown = F.col(text) if most is None else F.substring(text, 1, most)
    none = docs.join(fields.select("doc_id").distinct(), "doc_id", "left_anti")
    blank = F.coalesce(F.col(text), F.lit("")) == ""
    row = none.select(
        "doc_id", F.lit(1).alias("pos"), F.lit("_text").alias("field_name"), F.when(~blank, shown).alias("value"), F.when(blank, 0.0).otherwise(0.35).alias("confidence"),
        F.when(blank, "UNRESOLVED").otherwise("LOW_CONFIDENCE").alias("status"), shown.alias("raw_text"),
    )
    return fields.unionByName(row)


def structural_map(lines: DataFrame) -> DataFrame:
    """Field rows of recognised lines: name from the label (else ``line_NNNN``), made unique within the document by a suffix.

    Names that meet a suffixed name get the next free suffix by a second numbering.
    """
    kv = T.split_at(T.squeeze(F.col("text")), [":", "=", "|"], both=True)
    rows = lines.withColumn("kv", kv).withColumn("base", F.when(F.col("kv").isNotNull(), T.field_name(F.col("kv.key"), "field")).otherwise(F.concat(F.lit("line_"), F.lpad(F.col("line_no").cast("string"), 4, "0"))))
    value = F.coalesce("kv.value", T.squeeze(F.col("text")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("line_no")))
    rows = rows.withColumn("name", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("line_no")))
    name = F.when(F.col("again") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("again").cast("string")))
    return rows.select("doc_id", "line_no", name.alias("field_name"), value.alias("value"), T.field_kind(value).alias("kind"))


def status_counts(fields: DataFrame) -> DataFrame:
    """Per document: counts of unresolved, failed and corrected fields, of all, and the mean confidence (0 without any)."""
    return fields.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "UNRESOLVED").alias("unresolved_count"),
        F.count_if(F.col("status") == "VALIDATION_FAILURE").alias("validation_failure_count"),
        F.count_if(F.col("status") == "CORRECTED").alias("corrected_count"),
        F.count("*").alias("n_fields"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("overall_confidence"),
    )
