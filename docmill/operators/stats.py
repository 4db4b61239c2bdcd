"""Statistics over audits, corpora, corrections and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import SCORE_WEIGHTS
from ..sources.workspace import written
from .corpus import number_in_order, running_totals
from .selection import exact_percentiles


def audit_stats(audit: DataFrame) -> DataFrame:
    """One row: total, mean confidence, unresolved fields a record, mean time over the records that have one. Zeros for an empty log."""
    n = F.count("*")
    return audit.agg(
        n.alias("total_extractions"),
        F.coalesce(F.round(F.sum(F.coalesce("overall_confidence", F.lit(0.0))) / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.round(F.sum(F.coalesce("unresolved_count", F.lit(0))) / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("unresolved_rate"),
        F.coalesce(F.round(F.avg("processing_time_ms"), 2), F.lit(0.0)).alias("avg_processing_time_ms"),
    )


def audit_by_type(audit: DataFrame, unknown: str = "Unbekannt") -> DataFrame:
    return audit.groupBy(F.coalesce("document_type", F.lit(unknown)).alias("document_type")).agg(F.count("*").alias("n"))


def models_used(audit: DataFrame) -> DataFrame:
    """(kind, model): the distinct models, which are few whatever the log's length."""
    pairs = F.array(F.struct(F.lit("vlm").alias("kind"), F.col("vlm_model").alias("model")), F.struct(F.lit("llm").alias("kind"), F.col("llm_model").alias("model")))
    return audit.select(F.explode(pairs).alias("p")).select("p.kind", "p.model").where("model <> ''").distinct()


def history(audit: DataFrame, limit: int = 50, document_type: str | None = None) -> DataFrame:
    """The latest records, newest first (ties: by id)."""
    rows = audit if document_type is None else audit.where(F.col("document_type") == document_type)
    return rows.orderBy(F.desc("timestamp"), "extraction_id").limit(limit)


def history_filter(audit: DataFrame, view: str = "all", query: str = "") -> DataFrame:
    """Records with unresolved fields (``review``), corrected ones (``corrected``) or none unresolved (``complete``), whose type or id contains ``query``."""
    keep = {"review": F.col("unresolved_count") > 0, "corrected": F.col("corrected_count") > 0, "complete": F.col("unresolved_count") == 0}.get(view, F.lit(True))
    q = query.strip().lower()
    return audit.where(keep & (F.lower("document_type").contains(q) | F.lower("extraction_id").contains(q)))


def correction_stats(corrections: DataFrame) -> DataFrame:
    """(kind, name, n): total, by field and by document type, in one pass; empty names are left out."""
    rows = corrections.groupingSets([(), ("field",), ("doc_type",)], "field", "doc_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.first("field").alias("f"), F.first("doc_type").alias("d"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "field").otherwise("doc_type")
    name = F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("field")).otherwise(F.col("doc_type"))
    return rows.select(kind.alias("kind"), name.alias("name"), "n").where("kind = 'total' or name <> ''")


def corpus_stats(images: DataFrame) -> DataFrame:
    """Counts, means and coverages of the learned corpus: one row, zeros when it is empty."""
    n = F.count("*")
    def part(c: Column) -> Column:
        return F.coalesce(F.count_if(c) / F.nullif(n, F.lit(0)), F.lit(0.0))

    return images.agg(
        n.alias("total"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"), F.coalesce(F.avg(F.length("ocr_text")), F.lit(0.0)).alias("avg_ocr_chars"),
        part(F.length("ocr_text") > 0).alias("ocr_coverage"), part(F.length("visual_hash") > 0).alias("hash_coverage"),
    )


def top_labels(images: DataFrame, k: int = 20, label: str = "label_name") -> DataFrame:
    """The most frequent labels (ties: by name); a blank one counts as ``unknown``."""
    name = F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("unknown"))
    return images.groupBy(name.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def learning_score(coverage: Column, quality: Column, ocr_coverage: Column, ocr_chars: Column, vector_index: Column) -> Column:
    """Weighted score of 100, two decimals."""
    one = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    a, b, c, d, e = SCORE_WEIGHTS
    total = one(coverage) * a + one(quality) * b + one(ocr_coverage) * c + F.least(ocr_chars / 600.0, F.lit(1.0)) * d + F.when(vector_index, 1.0).otherwise(0.55) * e
    return F.round(total * 100, 2)


def mean4(x: Column) -> Column:
    return F.coalesce(F.round(F.avg(x), 4), F.lit(0.0))


def percentile4(x: Column, p: float) -> Column:
    """Linearly interpolated percentile, four decimals, 0 for no rows."""
    return F.coalesce(F.round(F.percentile(x, p), 4), F.lit(0.0))


def exact4(rows: DataFrame, by: list[str], x: str | Column, shares: dict[str, float]) -> DataFrame:
    """Percentiles by selection, four decimals: no task holds a group's values, as it does for ``percentile``."""
    found = exact_percentiles(rows, by, x, shares)
    return found.select(*by, *[F.round(n, 4).alias(n) for n in shares])


def latency_report(runs: DataFrame, by: list[str], seconds: str = "seconds", chars: str | None = None) -> DataFrame:
    """Per group: runs, mean, p50, p95, runs a second, and, with ``chars``, mean characters and the share that is not empty."""
    out = [F.count("*").alias("n"), mean4(F.col(seconds)).alias("mean_s"), F.coalesce(F.round(F.try_divide(F.count("*"), F.sum(seconds)), 4), F.lit(0.0)).alias("per_s")]
    if chars:
        out += [mean4(F.col(chars)).alias("mean_chars"), F.round(F.count_if(F.col(chars) > 0) / F.count("*"), 4).alias("non_empty_rate")]
    cut = exact4(runs, by, seconds, {"p50_s": 0.5, "p95_s": 0.95})
    cut = cut.select(*[F.col(c).alias(f"__{c}") for c in by], "p50_s", "p95_s")
    means = runs.groupBy(*by).agg(*out)
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = means.join(cut, on, "left").drop(*[f"__{c}" for c in by])
    names = [*by, "n", "mean_s", "p50_s", "p95_s", "per_s", *(["mean_chars", "non_empty_rate"] if chars else [])]
    return rows.fillna(0.0, ["p50_s", "p95_s"]).select(*names)


def progress(ticks: DataFrame, total: float) -> DataFrame:
    """Per run: processed, elapsed, rate and remaining seconds from (run, at_s, processed)."""
    p = ticks.groupBy("run").agg(F.max("processed").alias("processed"), (F.max("at_s") - F.min("at_s")).alias("elapsed_s"))
    rate = F.try_divide(F.col("processed").cast("double"), F.col("elapsed_s"))
    return p.withColumn("per_s", F.coalesce(F.round(rate, 4), F.lit(0.0))).withColumn("eta_s", F.round(F.try_divide(F.lit(total) - F.col("processed"), rate), 2)).withColumn("pct", F.round(F.least(F.col("processed") / total * 100, F.lit(100.0)), 3))


def score_series(points: DataFrame, keep: int = 48) -> DataFrame:
    """The last ``keep`` points of (run, at, score) after equal neighbours are collapsed, with the change from the one before.

    Neighbours meet by their numbers in an equality join; the only window is over the last points of a run.
    """
    rows = number_in_order(points.select("run", "at", "score"), ["at"], "__n", "run")
    last = rows.select("run", (F.col("__n") + 1).alias("__n"), F.col("score").alias("__before"))
    kept = rows.join(last, ["run", "__n"], "left").where("__before is null or __before <> score").select("run", "at", "score")
    kept = number_in_order(kept, ["at"], "__k", "run")
    count = kept.groupBy("run").agg(F.max("__k").alias("__last"))
    tail = kept.join(count, "run").where(F.col("__k") >= F.col("__last") - keep)  # keep + 1 of a run
    delta = F.coalesce(F.col("score") - F.lag("score").over(Window.partitionBy("run").orderBy("__k")), F.lit(0.0))
    return tail.withColumn("delta", delta).where(F.col("__k") > F.col("__last") - keep).select("run", "at", "score", "delta")


def _streaks(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items with ``n`` (their number in the run), ``island`` (new items so far) and ``elapsed`` seconds, and of each island ``base``, the number
    of the new item that begins it (0: none), and ``last``, that of its last item."""
    seconds = F.col("seconds") if "seconds" in items.columns else F.lit(0)
    rows = written(running_totals(items, ["at"], "run", {"n": F.lit(1).cast("bigint"), "island": F.col("is_new").cast("bigint"), "elapsed": seconds}), "runs")
    islands = rows.groupBy("run", "island").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    return rows, islands.select("run", F.when(F.col("island") == 0, 0).otherwise(F.col("first")).alias("base"), "last")


def plateau(items: DataFrame, window: int) -> DataFrame:
    """Per run of (run, at, is_new): the first item at which ``window`` items in a row brought nothing new, or null; and the longest such
    row. Runs are numbered by many tasks and stretches are aggregated, so no run is one task."""
    rows, islands = _streaks(items)
    per = islands.groupBy("run").agg(F.min(F.when(F.col("last") - F.col("base") >= window, F.col("base") + window)).alias("n"), F.max(F.col("last") - F.col("base")).alias("longest"))
    return per.join(rows.select("run", "n", F.col("at").alias("stop_at")), ["run", "n"], "left").select("run", "stop_at", "longest")


def stops(items: DataFrame, max_seconds: float | None = None, limit: int | None = None, window: int | None = None) -> DataFrame:
    """(run, stop_at, reason) of the runs that end early, of items (run, at, is_new, seconds): the first item at which so many
    seconds are over, that is one too many, or that is the last of ``window`` in a row without anything new. If several hold
    at once, the first of these is the reason. None lifts a rule. No run is one task."""
    rows, islands = _streaks(items)
    found = rows.where("false").select("run", "n", F.lit(0).alias("place"), F.lit("").alias("reason"))
    if max_seconds is not None:
        found = found.unionByName(rows.where(F.col("elapsed") >= max_seconds).groupBy("run").agg(F.min("n").alias("n")).select("run", "n", F.lit(0).alias("place"), F.lit("seconds").alias("reason")))
    if limit is not None:
        found = found.unionByName(rows.where(F.col("n") == limit + 1).select("run", "n", F.lit(1).alias("place"), F.lit("limit").alias("reason")))
    if window is not None:
        ends = islands.where(F.col("last") - F.col("base") >= window).groupBy("run").agg(F.min(F.col("base") + window).alias("n"))
        found = found.unionByName(ends.select("run", "n", F.lit(2).alias("place"), F.lit("plateau").alias("reason")))
    first = found.groupBy("run").agg(F.min(F.struct("n", "place", "reason")).alias("x")).select("run", "x.n", "x.reason")
    return first.join(rows.select("run", "n", F.col("at").alias("stop_at")), ["run", "n"]).select("run", "stop_at", "reason")


def heartbeats(items: DataFrame, interval: int) -> DataFrame:
    """(run, beat, at, items): a run's last item and their number in each interval of ``at`` in which it has any."""
    return items.groupBy("run", F.floor(F.col("at") / F.lit(interval)).alias("beat")).agg(F.max("at").alias("at"), F.count("*").alias("items"))


def resume_set(items: DataFrame, every: int = 50) -> DataFrame:
    """The items (run, at) that a run has stored as done, if it stores its set after every so many items and then breaks off."""
    rows = number_in_order(items, ["at"], "__n", "run")
    counts = rows.groupBy(F.col("run").alias("__run")).agg(F.count("*").alias("__c"))
    rows = rows.join(counts, F.col("run").eqNullSafe(F.col("__run")))
    return rows.where(F.col("__n") <= F.expr(f"__c div {int(every)} * {int(every)}")).select(*items.columns)
