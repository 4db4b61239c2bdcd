"""Deterministic rules on fields: presence, pattern, business rule, and rules across fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import LABELS, LOW_CONFIDENCE, MAX_SALARY, NULLISH, PATTERNS, REQUIRED
from ..functions import dates, identifiers


def matches_pattern(field: Column, value: Column) -> Column:
    """Whether the value has its field's shape; fields without a pattern pass. White space is ASCII's."""
    out = F.lit(True)
    for name, pattern in PATTERNS.items():
        out = F.when(field == name, value.rlike(rf"^(?:{pattern})\z")).otherwise(out)
    return out


def rule_message(field: Column, value: Column, number: Column, as_of: Column) -> Column:
    """Null if the field's business rule holds, else why it does not. ``number`` is the value of amount fields."""
    def amount(name: str, top: int | None, positive: bool) -> Column:
        low = F.when(number <= 0, f"{name} muss groesser als 0 sein.") if positive else F.when(number < 0, f"{name} darf nicht negativ sein.")
        out = F.when(number.isNull(), f"{name} muss eine Zahl sein.").otherwise(low)
        return out if top is None else F.coalesce(out, F.when(number > top, f"{name} unplausibel hoch."))

    rules = {
        "geburtsdatum": dates.birthdate_message(value, as_of),
        "gueltig_bis": dates.expiry_message(value, as_of),
        "zu_versteuerndes_einkommen": amount("zu_versteuerndes_einkommen", None, False),
        "festgesetzte_steuer": amount("festgesetzte_steuer", None, False),
        "brutto_lohn": amount("brutto_lohn", MAX_SALARY, True),
        "netto_lohn": amount("netto_lohn", MAX_SALARY, True),
        "steueridentifikationsnummer": F.when(~identifiers.tax_id_valid(value), "Steuer-ID hat ungueltige Pruefsumme."),
        "postleitzahl": F.when(~identifiers.postal_code_valid(value), "PLZ muss genau 5 Ziffern enthalten."),
        "strasse": F.when(~identifiers.street_valid(value), "Strassenname ist ungueltig oder unvollstaendig."),
        "einzugsdatum": dates.move_in_message(value, as_of),
    }
    out = F.lit(None).cast("string")
    for name, message in rules.items():
        out = F.when(field == name, message).otherwise(out)
    return out


def validate_fields(fields: DataFrame, as_of: str) -> DataFrame:
    """Add status and validation_message to (field_name, value, …): one projection, no shuffle.

    A null value is UNRESOLVED; then the pattern, then the business rule; what passes is EXTRACTED. ``as_of`` is the day of the rules.
    """
    f, v, day = F.col("field_name"), F.col("value"), F.to_date(F.lit(as_of))
    number = v.try_cast("double")
    message = F.when(v.isNull(), "Feld konnte nicht extrahiert werden.").when(~matches_pattern(f, v), F.concat(F.lit("Wert '"), v, F.lit("' entspricht nicht dem erwarteten Format fuer '"), f, F.lit("'."))).otherwise(rule_message(f, v, number, day))
    rows = fields.withColumn("validation_message", message)
    return rows.withColumn("status", F.when(v.isNull(), "UNRESOLVED").when(F.col("validation_message").isNotNull(), "VALIDATION_FAILURE").otherwise("EXTRACTED"))


def check_net_against_gross(fields: DataFrame) -> DataFrame:
    """Net pay above gross pay fails. The partner's value comes by a window over the document, so there is no join back."""
    number = F.col("value").try_cast("double")
    w = Window.partitionBy("doc_id")
    gross = F.max(F.when(F.col("field_name") == "brutto_lohn", number)).over(w)
    bad = (F.col("field_name") == "netto_lohn") & (number > gross)
    message = F.concat(F.lit("Nettolohn ("), number.cast("string"), F.lit(") uebersteigt Bruttolohn ("), gross.cast("string"), F.lit(")."))
    bad = F.coalesce(bad, F.lit(False))
    rows = fields.withColumn("__bad", bad).withColumn("__message", message)
    return rows.withColumn("status", F.when(F.col("__bad"), "VALIDATION_FAILURE").otherwise(F.col("status"))).withColumn("validation_message", F.when(F.col("__bad"), F.col("__message")).otherwise(F.col("validation_message"))).drop("__bad", "__message")


def check_city_of_postal_code(fields: DataFrame) -> DataFrame:
    """No table of cities belongs to the rules: the fields pass as they are."""
    return fields


def missing_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, doc_type, field_name) of required fields that a document lacks or that have no value."""
    need = F.lit(None).cast("array<string>")
    for kind in LABELS:
        need = F.when(F.col("doc_type") == kind, F.array(*[F.lit(f) for f in REQUIRED[kind]])).otherwise(need)
    have = fields.groupBy("doc_id", "doc_type").agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("field_name"))).alias("have"))
    return have.select("doc_id", "doc_type", F.explode(F.array_except(need, "have")).alias("field_name"))


def null_if_nullish(value: Column) -> Column:
    """The texts that stand for no value become null."""
    return F.when(~value.isin(*NULLISH), value)


def overlay_model_values(fields: DataFrame, model: DataFrame, confidence: float = 0.55) -> DataFrame:
    """A model's values (doc_id, field_name, value) replace those of lower confidence; null-like ones do nothing."""
    m = model.select("doc_id", "field_name", null_if_nullish(F.col("value")).alias("__value"))
    rows = fields.join(m, ["doc_id", "field_name"], "left")
    take = F.col("__value").isNotNull() & (F.lit(confidence) > F.coalesce("confidence", F.lit(0.0)))
    return rows.withColumn("value", F.when(take, F.col("__value")).otherwise(F.col("value"))).withColumn("confidence", F.when(take, confidence).otherwise(F.col("confidence"))).drop("__value")


def structure_missing(fields: DataFrame, model: DataFrame, enabled: bool = False, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Add ``from_model``: a model's rows (doc_id, field_name, value, confidence) fill the fields that have no value or less
    confidence than ``threshold``, where theirs is higher. Null-like values do nothing, fields that do not exist are not added,
    and unless ``enabled`` nothing changes."""
    if not enabled:
        return fields.withColumn("from_model", F.lit(False))
    m = model.select("doc_id", "field_name", null_if_nullish(F.col("value")).alias("__value"), F.col("confidence").alias("__c"))
    rows = fields.join(m, ["doc_id", "field_name"], "left")
    asked = F.col("value").isNull() | (F.coalesce("confidence", F.lit(0.0)) < threshold)
    take = F.coalesce(asked & F.col("__value").isNotNull() & (F.col("__c") > F.coalesce("confidence", F.lit(0.0))), F.lit(False))
    rows = rows.withColumn("from_model", take)
    return rows.withColumn("value", F.when(F.col("from_model"), F.col("__value")).otherwise(F.col("value"))).withColumn("confidence", F.when(F.col("from_model"), F.col("__c")).otherwise(F.col("confidence"))).drop("__value", "__c")
