"""Corrections and examples as prompt text, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import TOKEN_BUDGET, TOKEN_HEADER
from ..functions import text as T


def within_budget(rows: DataFrame, by: list[str], order: list[Column], text: str, budget: int = TOKEN_BUDGET, header: int = TOKEN_HEADER) -> DataFrame:
    """The rows of each group, in order, before the first that would exceed the budget; later ones are left out even if they would fit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Costs are positive, so once the running sum is over the budget it stays over.
    used = rows.withColumn("tokens", T.correction_tokens(F.col(text))).withColumn("used", F.sum("tokens").over(w) + header)
    return used.where(F.col("used") <= budget)


def _ordered(item: Column, order: str, most: int | None) -> Column:
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), item.alias("__i")))), lambda x: x["__i"])
    return items if most is None else F.slice(items, 1, most)


def correction_block(corrections: DataFrame, by: list[str], order: str, most: int = 5) -> DataFrame:
    """One text a group: numbered corrections between blank lines."""
    line = F.concat(F.lit("Similar document: '"), F.coalesce("original", F.lit("")), F.lit("' was corrected to '"), F.coalesce("corrected", F.lit("")), F.lit("'."), F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" Reason: "), F.col("reason"))).otherwise(""))
    items = corrections.groupBy(*by).agg(_ordered(line, order, most).alias("items"))
    numbered = F.transform("items", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))
    return items.select(*by, F.concat(F.lit("\nLEARNED CORRECTIONS (apply these patterns):\n\n"), F.array_join(numbered, "\n"), F.lit("\n")).alias("block"))


def field_block(corrections: DataFrame, by: list[str], order: str, most: int = 5) -> DataFrame:
    """One text a group: a heading, a bullet for each correction, and a closing line."""
    line = F.concat(F.lit("- Field '"), F.coalesce("field", F.lit("unknown")), F.lit("': '"), F.coalesce("original", F.lit("")), F.lit("' was corrected to '"), F.coalesce("corrected", F.lit("")), F.lit("'. Reason: "), F.coalesce("reason", F.lit("N/A")))
    items = corrections.groupBy(*by).agg(_ordered(line, order, most).alias("items"))
    return items.select(*by, F.concat(F.lit("=== LEARNED CORRECTIONS (apply these patterns) ===\n"), F.array_join("items", "\n"), F.lit("\n=== END LEARNED CORRECTIONS ===")).alias("block"))


def example_block(examples: DataFrame, by: list[str], order: str, most: int = 5) -> DataFrame:
    """One text a group: learned images as numbered examples, 400 characters of text each."""
    text = F.substring(T.squeeze(F.coalesce("ocr_text", F.lit(""))), 1, 400)
    line = F.concat(F.lit("label="), F.coalesce(F.nullif("label_name", F.lit("")), F.lit("unknown")), F.lit("; form_type="), F.coalesce(F.nullif("form_type", F.lit("")), F.lit("Unbekannt")), F.lit("; quality="), F.format_string("%.2f", F.coalesce("quality_score", F.lit(0.0))), F.lit("; ocr='"), text, F.lit("'"))
    items = examples.groupBy(*by).agg(_ordered(line, order, most).alias("items"))
    numbered = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return items.select(*by, F.concat(F.lit("=== LEARNED IMAGE EXAMPLES (use as OCR/quality patterns) ===\n"), F.array_join(numbered, "\n"), F.lit("\n=== END LEARNED IMAGE EXAMPLES ===")).alias("block"))


def field_guide(catalog: DataFrame) -> DataFrame:
    """(doc_type, guide): a line for each field of (doc_type, ord, field, kind, required, pattern)."""
    line = F.concat(F.lit("- "), F.col("field"), F.lit(" ("), F.col("kind"), F.when(F.col("required"), "").otherwise(", optional"), F.lit("): "), T.title(F.col("field")), F.coalesce(F.concat(F.lit(" [pattern: "), F.col("pattern"), F.lit("]")), F.lit("")))
    return catalog.groupBy("doc_type").agg(_ordered(line, "ord", None).alias("items")).select("doc_type", F.array_join("items", "\n").alias("guide"))


def prompt(document_type: Column, guide: Column, few_shot: Column, output: Column) -> Column:
    """An instruction with the field guide, the corrections if there are any, and the recognised text."""
    shots = F.when(F.coalesce(few_shot, F.lit("")) != "", F.concat(few_shot, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("Document type: "), document_type, F.lit("\n\nFields:\n"), guide, F.lit("\n\n"), shots, F.lit("Recognised text:\n"), output)
