"""Two field maps of a document, and predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import AMOUNT_FIELDS
from ..functions import amounts
from ..functions import text as T


def compare_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, field_name, side, low): a full join of structure (``a``) and values (``b``, with confidence and raw_value)."""
    left = a.select("doc_id", "field_name", F.lit(True).alias("__a")).distinct()
    right = b.select("doc_id", "field_name", "confidence", "raw_value", F.lit(True).alias("__b")).dropDuplicates(["doc_id", "field_name"])
    rows = left.join(right, ["doc_id", "field_name"], "full_outer")
    side = F.when(F.col("__b").isNull(), "missing_in_b").when(F.col("__a").isNull(), "orphan_in_b").otherwise("both")
    low = F.col("__a") & F.col("__b") & (F.coalesce("confidence", F.lit(1.0)) < 0.5)
    empty = (side == "both") & ~F.coalesce(low, F.lit(False)) & F.coalesce(F.col("raw_value"), F.lit("")).isin("", "null", "None")
    return rows.select("doc_id", "field_name", side.alias("side"), F.coalesce(low, F.lit(False)).alias("low"), empty.alias("empty"))


def consistency(compared: DataFrame) -> DataFrame:
    """Per document: sizes of the differences, the intersection and the union, and the score that they give, from 0 to 1."""
    n = F.count("*")
    both, left, right, low = F.count_if(F.col("side") == "both"), F.count_if(F.col("side") == "missing_in_b"), F.count_if(F.col("side") == "orphan_in_b"), F.count_if("low")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - (left + right) - low * 0.5) / n))
    return compared.groupBy("doc_id").agg(both.alias("matched"), left.alias("missing_in_b"), right.alias("orphan_in_b"), low.alias("low_confidence"), n.alias("total_fields"), score.alias("score"))


def capped(score: Column, mean_confidence: Column) -> Column:
    """A score from a single pass is no better than its mean confidence."""
    return F.least(score, mean_confidence)


def compared_fields(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, field_name, pred, truth, exact, cer, wer) of labelled fields.

    Amounts are compared as numbers where both are numbers, and as text with two decimals where one is; other values without
    case. Truth that is blank or named ``_…`` is left out.
    """
    t = truth.select("doc_id", "field_name", T.squeeze(F.col("value")).alias("truth")).where("truth <> '' and not startswith(field_name, '_')")
    p = pred.select("doc_id", "field_name", T.squeeze(F.col("value")).alias("pred"))
    rows = t.join(p, ["doc_id", "field_name"], "left").withColumn("pred", F.coalesce("pred", F.lit("")))
    amount = F.col("field_name").isin(*AMOUNT_FIELDS)
    rows = rows.withColumn("pf", F.when(amount, amounts.parse_whole(F.col("pred")))).withColumn("tf", F.when(amount, amounts.parse_whole(F.col("truth"))))
    pf, tf = F.col("pf"), F.col("tf")
    def shown(text: Column, number: Column) -> Column:
        return F.when(amount, F.when(number.isNotNull(), F.format_string("%.2f", number)).otherwise(text)).otherwise(T.folded(text))

    rows = rows.withColumn("cp", shown(F.col("pred"), pf)).withColumn("ct", shown(F.col("truth"), tf))
    exact = F.when(amount, F.coalesce(amounts.close(pf, tf), F.lit(False))).otherwise(F.col("cp") == F.col("ct"))
    return rows.select("doc_id", "field_name", "pred", "truth", exact.alias("exact"), T.char_error_rate(F.col("cp"), F.col("ct")).alias("cer"), T.word_error_rate(F.col("cp"), F.col("ct")).alias("wer"))


def false_positives(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Predicted fields that have a value, are not named ``_…`` and are not labelled, in documents that have labels."""
    labelled = truth.where(~T.blank(F.col("value")))
    some = pred.where(~T.blank(F.col("value")) & ~F.col("field_name").startswith("_"))
    return some.join(labelled.select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti").join(labelled.select("doc_id").distinct(), "doc_id", "left_semi")


def evaluation(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of micro metrics: compared, exact, tp, fn, fp, mean error rates, precision, recall, F1; zeros without data."""
    rows = compared_fields(truth, pred)
    fp = false_positives(truth, pred).agg(F.count("*").alias("fp"))
    m = rows.agg(F.count("*").alias("compared"), F.count_if("exact").alias("exact"), F.count_if(F.col("pred") != "").alias("tp"), F.count_if(F.col("pred") == "").alias("fn"), F.coalesce(F.avg("cer"), F.lit(0.0)).alias("mean_cer"), F.coalesce(F.avg("wer"), F.lit(0.0)).alias("mean_wer"))
    m = m.join(fp)  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp").cast("double")
    m = m.withColumn("precision", ratio(tp, tp + F.col("fp"))).withColumn("recall", ratio(tp, tp + F.col("fn")))
    return m.withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))).withColumn("exact_rate", ratio(F.col("exact").cast("double"), F.col("compared")))


def receipt_compare(pred: DataFrame, gold: DataFrame, fields: list[str]) -> DataFrame:
    """Per document of ``gold`` and field: normalised predicted and expected text and whether they agree; absent ones are ''."""
    docs = gold.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name"))
    g = gold.select("doc_id", "field_name", F.col("value").alias("expected"))
    p = pred.select("doc_id", "field_name", F.col("value").alias("predicted"))
    rows = docs.join(g, ["doc_id", "field_name"], "left").join(p, ["doc_id", "field_name"], "left")
    e, q = T.receipt_text(F.col("expected")), T.receipt_text(F.col("predicted"))
    return rows.select("doc_id", "field_name", q.alias("predicted"), e.alias("expected"), ((e != "") & (q == e)).alias("exact"))
