"""What a page comes to when nothing was read from it, what a model is told of what was read, and answers of a two-pass model as fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DEGRADED_MB, ERROR_CODES, OTHER_HTTP_ERROR, UNKNOWN

COLUMNS = ["doc_id", "document_type", "field_name", "value", "status", "confidence", "validation_message"]
NOTHING = "No readable fields found"
ERROR = "Pipeline error: "
LEAST_READ = 0.25  # an unresolved page's confidence is its legibility, but no more than this


def _row(pages: DataFrame, document_type: Column, name: str, value: Column, confidence: Column, message: Column) -> DataFrame:
    return pages.select("doc_id", document_type.alias("document_type"), F.lit(name).alias("field_name"), value.cast("string").alias("value"), F.lit("UNRESOLVED").alias("status"), confidence.cast("double").alias("confidence"), message.cast("string").alias("validation_message"))


def refusal_rows(pages: DataFrame) -> DataFrame:
    """``_refusal`` for each page with a ``refusal``: the reason as value and message, no confidence, an unknown type."""
    some = pages.where("refusal is not null")
    return _row(some, F.lit(UNKNOWN), "_refusal", F.col("refusal"), F.lit(0.0), F.col("refusal"))


def error_rows(pages: DataFrame) -> DataFrame:
    """``_error`` for each page that was not refused and has an ``error``: no value, no confidence, the type as far as it was known."""
    some = pages.where("refusal is null and error is not null")
    return _row(some, F.coalesce("document_type", F.lit(UNKNOWN)), "_error", F.lit(None), F.lit(0.0), F.concat(F.lit(ERROR), "error"))


def unresolved_rows(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """``_unresolved`` for each page that was read to the end, but has no row in ``fields``."""
    some = pages.where("refusal is null and error is null").join(fields.select("doc_id").distinct(), "doc_id", "left_anti")
    confidence = F.greatest(F.lit(0.0), F.least(F.coalesce("legibility", F.lit(0.0)), F.lit(LEAST_READ)))
    return _row(some, F.coalesce("document_type", F.lit(UNKNOWN)), "_unresolved", F.lit(None), confidence, F.lit(NOTHING))


def page_results(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """Field rows of all ``pages`` (doc_id, document_type, legibility, refusal, error): the one row that says why a page was refused or broke
    off, whatever was read of it; else its ``fields`` (doc_id, field_name, value, status, confidence), or the row that says there are none.
    """
    read = pages.where("refusal is null and error is null").select("doc_id", F.coalesce("document_type", F.lit(UNKNOWN)).alias("document_type"))
    known = fields.select("doc_id", "field_name", "value", "status", "confidence").join(read, "doc_id").withColumn("validation_message", F.lit(None).cast("string"))
    return known.select(COLUMNS).unionByName(refusal_rows(pages)).unionByName(error_rows(pages)).unionByName(unresolved_rows(pages, fields))


def known_context(fields: DataFrame) -> DataFrame:
    """(doc_id, field_name, context) of the fields that have a value: what was read, as it was read, else the value."""
    some = fields.where("value is not null and value <> ''")
    return some.select("doc_id", "field_name", F.coalesce(F.nullif("raw_text", F.lit("")), "value").alias("context"))


def context_maps(fields: DataFrame) -> DataFrame:
    """(doc_id, context): the known context of each document as a map, for a prompt; of repeated names the first by value counts."""
    one = known_context(fields).groupBy("doc_id", "field_name").agg(F.min("context").alias("context"))
    return one.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "context")))).alias("context"))


def is_object(json: Column) -> Column:
    return F.coalesce(F.ltrim(json).startswith("{"), F.lit(False))


def mapped_answers(answers: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, confidence, raw_text, bbox, source) of ``answers`` (doc_id, value_map, structural_map), JSON objects by field name.

    An entry of the value map that is no object is left out. A raw value that is missing, empty or one of the words null and None is no
    value. The box is that of the structural map's entry of the same name, as JSON; null where that entry or its box is no object.
    """
    maps = answers.select("doc_id", F.from_json("value_map", "map<string, string>").alias("v"), F.from_json("structural_map", "map<string, string>").alias("s"))
    rows = maps.select("doc_id", F.explode("v").alias("field_name", "entry"), "s").where(is_object(F.col("entry")))
    rows = rows.withColumns({"e": F.from_json("entry", "raw_value string, confidence_0_to_1 string"), "t": F.try_element_at("s", "field_name")})
    box = F.when(is_object(F.col("t")), F.get_json_object("t", "$.estimated_bbox"))
    raw, score = F.col("e.raw_value"), F.coalesce(F.col("e.confidence_0_to_1").try_cast("double"), F.lit(0.0))
    value = F.when(~raw.isin("", "null", "None"), raw)
    confidence = F.when(F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return rows.select("doc_id", "field_name", value.alias("value"), confidence.alias("confidence"), F.coalesce(raw, F.lit("")).alias("raw_text"), F.when(is_object(box), box).alias("bbox"), F.lit("inline").alias("source"))


def error_code(status: Column, other: str = OTHER_HTTP_ERROR) -> Column:
    """The code that an HTTP status is answered with; ``other`` for statuses without one of their own, and for null."""
    codes = F.create_map(*[F.lit(x) for kv in ERROR_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, status.cast("int")), F.lit(other))


def health(ram_mb: Column, most: float = DEGRADED_MB) -> Column:
    """``degraded`` above so many MB in use, else ``ok``; unknown use counts as none."""
    return F.when(F.coalesce(ram_mb, F.lit(0)) > most, "degraded").otherwise("ok")


def ingestion_report(manifest: DataFrame, files: DataFrame, stored: DataFrame, elapsed_s: float, key: str = "filename") -> DataFrame:
    """One row on an ingestion: records of the manifest whose file is there (scanned), whose file is a valid image (prepared), contents that
    were new (stored), what was left out (files that are missing or not valid), and new contents a second.

    ``files`` has ``key``, ``image_id`` and ``valid``, ``stored`` the image_id of what was there before. A content is stored once.
    """
    met = manifest.select(key).join(files.select(key, "image_id", F.coalesce("valid", F.lit(False)).alias("valid"), F.lit(True).alias("there")), key, "left")
    good = met.where("there and valid")
    new = good.select("image_id").distinct().join(stored.select("image_id"), "image_id", "left_anti").agg(F.count("*").alias("records_stored"))
    counts = met.agg(F.count("there").alias("samples_scanned"), F.count_if("valid").alias("records_prepared"), F.count_if(~F.coalesce("there", F.lit(False)) | ~F.col("valid")).alias("skipped"))
    rate = F.round(F.try_divide(F.col("records_stored"), F.lit(float(elapsed_s))), 4)
    return counts.join(F.broadcast(new)).select("samples_scanned", "records_prepared", "records_stored", "skipped", F.coalesce(rate, F.lit(0.0)).alias("records_per_second"))  # one row each
