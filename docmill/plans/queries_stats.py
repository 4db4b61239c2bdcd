"""Queries that summarise: audits, corpora, corrections, benchmarks, progress, splits, streams, synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, identifiers
from ..operators import corpus, outcomes, stats, synth
from .queries import Source, query


@query("q_A02_audit_stats", "select count(*) as total_extractions, round(sum(overall_confidence) / count(*), 4) as avg_confidence, round(cast(sum(unresolved_count) as double) / count(*), 4) as unresolved_rate, round(avg(processing_time_ms), 2) as avg_processing_time_ms from ({v_audit}) v")
def audit_stats(s: Source) -> DataFrame:
    return stats.audit_stats(s.v("v_audit"))


@query("q_P26_empty_stats", "select cast(0 as bigint) as total_extractions, cast(0 as double) as avg_confidence, cast(0 as double) as unresolved_rate, cast(0 as double) as avg_processing_time_ms")
def empty_stats(s: Source) -> DataFrame:
    return stats.audit_stats(s.v("v_audit").where("extraction_id is null"))


@query("q_A02_audit_by_type", "select document_type, count(*) as n from ({v_audit}) v group by document_type")
def audit_by_type(s: Source) -> DataFrame:
    return stats.audit_by_type(s.v("v_audit"))


@query("q_U06_models_used", "select distinct 'vlm' as kind, vlm_model as model from ({v_audit}) v where vlm_model <> '' union select distinct 'llm', llm_model from ({v_audit}) w where llm_model <> ''")
def models_used(s: Source) -> DataFrame:
    return stats.models_used(s.v("v_audit"))


@query("q_O05_audit_history", "select extraction_id, timestamp, document_type from ({v_audit}) v where document_type = 'purchase' order by timestamp desc, extraction_id limit 50")
def audit_history(s: Source) -> DataFrame:
    return stats.history(s.v("v_audit"), 50, "purchase").select("extraction_id", "timestamp", "document_type")


@query("q_P19_history_filter", "select extraction_id from ({v_audit}) v where unresolved_count > 0 and (contains(lower(document_type), 'ic') or contains(lower(extraction_id), 'ic'))")
def history_filter(s: Source) -> DataFrame:
    return stats.history_filter(s.v("v_audit"), "review", " IC ").select("extraction_id")


@query("q_P23_audit_projection", "select extraction_id, document_type, vlm_model, llm_model, overall_confidence, unresolved_count from ({v_audit}) v")
def audit_projection(s: Source) -> DataFrame:
    return s.v("v_audit").select("extraction_id", "document_type", "vlm_model", "llm_model", "overall_confidence", "unresolved_count")


@query("q_P27_merged_stats", "select (select count(*) from ({v_audit}) a) as extractions, (select count(*) from ({v_corr}) c) as corrections, (select count(*) from ({v_images}) i) as images")
def merged_stats(s: Source) -> DataFrame:
    one = lambda v, name: s.v(v).agg(F.count("*").alias(name))
    return one("v_audit", "extractions").join(one("v_corr", "corrections")).join(one("v_images", "images"))


@query("q_A03_correction_stats", "select 'total' as kind, '' as name, count(*) as n from ({v_corr}) v union all select 'field', field, count(*) from ({v_corr}) v where field <> '' group by field union all select 'doc_type', doc_type, count(*) from ({v_corr}) v where doc_type <> '' group by doc_type")
def correction_stats(s: Source) -> DataFrame:
    return stats.correction_stats(s.v("v_corr"))


@query("q_A04_corpus_stats", "select count(*) as total, round(avg(quality_score), 6) as avg_quality, round(avg(length(ocr_text)), 6) as avg_ocr_chars, round(cast(count(*) filter (where ocr_text <> '') as double) / count(*), 6) as ocr_coverage, round(cast(count(*) filter (where visual_hash <> '') as double) / count(*), 6) as hash_coverage from ({v_images}) v")
def corpus_stats(s: Source) -> DataFrame:
    c = stats.corpus_stats(s.v("v_images"))
    return c.withColumns({x: F.round(x, 6) for x in c.columns if x != "total"})


@query("q_A05_top_labels", "select label_name as label, count(*) as n from ({v_images}) v group by label_name order by n desc, label limit 20")
def top_labels(s: Source) -> DataFrame:
    return stats.top_labels(s.v("v_images"))


@query("q_A18_learning_score", "select round((0.36::double * least(cast(count(*) as double) / 50000, 1) + 0.22::double * avg(quality_score) + 0.18::double * (cast(count(*) filter (where ocr_text <> '') as double) / count(*)) + 0.14::double * least(avg(length(ocr_text)) / 600, 1) + 0.1::double * 0.55::double) * 100, 2) as score from ({v_images}) v")
def learning_score(s: Source) -> DataFrame:
    c = stats.corpus_stats(s.v("v_images"))
    return c.select(stats.learning_score(F.col("total") / 50_000, F.col("avg_quality"), F.col("ocr_coverage"), F.col("avg_ocr_chars"), F.lit(False)).alias("score"))


@query("q_A08_latency_report", "select event_type, count(*) as n, round(avg(value), 4) as mean_s, round(quantile_cont(value, 0.5), 4) as p50_s, round(quantile_cont(value, 0.95), 4) as p95_s, round(count(*) / sum(value), 4) as per_s from events group by event_type")
def latency_report(s: Source) -> DataFrame:
    return stats.latency_report(s.t("events"), ["event_type"], "value")


@query("q_A09_throughput_report", "select lang, count(*) as n, round(avg(n_chars), 4) as mean_s, round(quantile_cont(cast(n_chars as double), 0.5), 4) as p50_s, round(quantile_cont(cast(n_chars as double), 0.95), 4) as p95_s, round(cast(count(*) as double) / sum(n_chars), 4) as per_s, round(avg(n_chars), 4) as mean_chars, cast(1 as double) as non_empty_rate from documents group by lang")
def throughput_report(s: Source) -> DataFrame:
    return stats.latency_report(s.t("documents").withColumn("seconds", F.col("n_chars").cast("double")), ["lang"], "seconds", "n_chars")


@query("q_A11_percentiles", "select round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95, round(avg(l_extendedprice), 4) as mean from lineitem")
def percentiles(s: Source) -> DataFrame:
    rows = s.t("lineitem")
    mean = rows.agg(stats.mean4(F.col("l_extendedprice")).alias("mean"))
    return stats.exact4(rows, [], "l_extendedprice", {"p50": 0.5, "p95": 0.95}).join(F.broadcast(mean))  # one row each


@query("q_A12_line_confidence", "select doc_id, count(*) as n, round(avg(confidence), 6) as mean_confidence from ({v_boxes}) v group by doc_id")
def line_confidence(s: Source) -> DataFrame:
    return s.v("v_boxes").groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("q_A13_page_box", "select doc_id, round(min(x1), 6) as x1, round(min(y1), 6) as y1, round(max(x2), 6) as x2, round(max(y2), 6) as y2, min(confidence) as confidence from ({v_boxes}) v group by doc_id")
def page_box(s: Source) -> DataFrame:
    b = s.v("v_boxes").groupBy("doc_id").agg(*[f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"), (F.min, "confidence"))])
    return b.withColumns({c: F.round(c, 6) for c in ("x1", "y1", "x2", "y2")})


@query("q_A17_ingestion_report", "select count(*) as scanned, count(distinct sha256(text)) as stored, count(*) - count(distinct sha256(text)) as skipped from documents")
def ingestion_report(s: Source) -> DataFrame:
    h = F.sha2(F.col("text").cast("binary"), 256)
    return s.t("documents").groupBy(h).agg(F.count("*").alias("n")).agg(F.sum("n").alias("scanned"), F.count("*").alias("stored"), (F.sum("n") - F.count("*")).alias("skipped"))


@query("q_A20_session_cards", "select count(*) as extractions, round(avg(overall_confidence) * 100, 4) as avg_confidence_pct, cast(sum(unresolved_count) as bigint) as unresolved, cast(sum(corrected_count) as bigint) as corrected from ({v_audit}) v")
def session_cards(s: Source) -> DataFrame:
    return s.v("v_audit").agg(F.count("*").alias("extractions"), F.round(F.avg("overall_confidence") * 100, 4).alias("avg_confidence_pct"), F.sum("unresolved_count").alias("unresolved"), F.sum("corrected_count").alias("corrected"))


@query("q_A21_queue_counts", "select status, count(*) as n from ({v_status}) v group by status")
def queue_counts(s: Source) -> DataFrame:
    return s.v("v_status").groupBy("status").agg(F.count("*").alias("n"))


@query("q_P21_health", "select user_id, case when max(value) > 50 then 'degraded' else 'ok' end as status from events group by user_id")
def health(s: Source) -> DataFrame:
    return s.t("events").groupBy("user_id").agg(F.when(F.max("value") > 50, "degraded").otherwise("ok").alias("status"))


@query("q_FM10_progress_rates", """with p as (select user_id as run, count(*) as processed, date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) as elapsed_s from events group by user_id)
    select run, processed, cast(elapsed_s as double) as elapsed_s, coalesce(round(cast(processed as double) / nullif(elapsed_s, 0), 4), 0) as per_s, round((500 - processed) / (cast(processed as double) / nullif(elapsed_s, 0)), 2) as eta_s, round(least(cast(processed as double) / 500 * 100, 100), 3) as pct from p""")
def progress_rates(s: Source) -> DataFrame:
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ticks = s.t("events").select(F.col("user_id").alias("run"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at_s"), k.cast("bigint").alias("processed"))
    return stats.progress(ticks, 500.0)


@query("q_W09_score_series", """with b as (select user_id as run, event_id as "at", round(value) as score, lag(round(value)) over (partition by user_id order by event_id) as before from events), c as (select run, "at", score from b where before is null or before <> score),
    d as (select *, coalesce(score - lag(score) over (partition by run order by "at"), 0) as delta, row_number() over (partition by run order by "at" desc) as r from c) select run, "at", score, delta from d where r <= 48""")
def score_series(s: Source) -> DataFrame:
    return stats.score_series(s.t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.round("value").alias("score")))


@query("q_W08_ingest_plateau", """with i as (select user_id as run, event_id as "at", event_type = 'purchase' as is_new from events), g as (select *, sum(cast(is_new as int)) over (partition by run order by "at" rows unbounded preceding) as island from i),
    k as (select *, sum(1 - cast(is_new as int)) over (partition by run, island order by "at" rows unbounded preceding) as streak from g) select run, min(case when streak >= 8 then "at" end) as stop_at, cast(max(streak) as bigint) as longest from k group by run""")
def ingest_plateau(s: Source) -> DataFrame:
    return stats.plateau(s.t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), (F.col("event_type") == "purchase").alias("is_new")), 8)


@query("q_O11_train_val_split", "with r as (select doc_id, row_number() over (order by md5('0:' || cast(doc_id as varchar)), doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= cast(floor(n * 0.1) as bigint) then 'val' else 'train' end as part from r")
def train_val_split(s: Source) -> DataFrame:
    return corpus.split_exactly(s.t("documents").select("doc_id"), "doc_id", 0.1)


@query("q_O08_prune_archives", "select event_type, event_id, row_number() over (partition by event_type order by event_id desc) > 10 as remove from events")
def prune_archives(s: Source) -> DataFrame:
    return corpus.keep_newest(s.t("events"), ["event_type"], F.col("event_id"), 10).select("event_type", "event_id", "remove")


@query("q_O07_log_tail", "select event_id from (select event_id from events order by event_id desc limit 60)")
def log_tail(s: Source) -> DataFrame:
    return s.t("events").orderBy(F.desc("event_id")).limit(60).select("event_id")


@query("q_O10_path_order", "select url, row_number() over (order by url, page_id) as n from pages")
def path_order(s: Source) -> DataFrame:
    return corpus.number_in_order(s.t("pages").select("url", "page_id"), ["url", "page_id"]).select("url", "n")


@query("q_P22_error_codes", "select r_regionkey, case r_regionkey when 0 then 'BAD_REQUEST' when 1 then 'NOT_FOUND' else 'INTERNAL_ERROR' end as code from region")
def error_codes(s: Source) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for kv in ((400, "BAD_REQUEST"), (404, "NOT_FOUND")) for x in kv])
    http = F.element_at(F.array(F.lit(400), F.lit(404), F.lit(500), F.lit(502), F.lit(503)), F.col("r_regionkey") + 1)
    return s.t("region").select("r_regionkey", F.coalesce(F.try_element_at(codes, http), F.lit("INTERNAL_ERROR")).alias("code"))


@query("q_P18_skip_malformed", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where event_id % 6 <> 0")
def skip_malformed(s: Source) -> DataFrame:
    line = F.when(F.col("event_id") % 6 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = s.t("events").select("event_id", F.from_json(line, "k bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad is null").select("event_id", "r.k")


@query("q_P11_refusals", "select doc_id, '_refusal' as field_name, 'UNRESOLVED' as status, cast(0 as double) as confidence from ({v_status}) v where confidence < 0.2 group by doc_id")
def refusals(s: Source) -> DataFrame:
    return s.v("v_status").where("confidence < 0.2").select("doc_id").distinct().select("doc_id", F.lit("_refusal").alias("field_name"), F.lit("UNRESOLVED").alias("status"), F.lit(0.0).alias("confidence"))


@query("q_P16_known_context", "select doc_id, line_no, coalesce(nullif(text, ''), 'none') as shown from ({v_form_lines}) v where confidence >= 0.7")
def known_context(s: Source) -> DataFrame:
    return s.v("v_form_lines").where("confidence >= 0.7").select("doc_id", "line_no", F.coalesce(F.nullif("text", F.lit("")), F.lit("none")).alias("shown"))


PAGES = """select doc_id, nullif(lang, 'fr') as document_type, (n_chars % 100) / 100.0 as legibility, case when n_chars % 7 = 0 then 'too dark' end as refusal, case when n_chars % 7 < 2 then 'broken' end as error from documents"""


def _pages(s: Source) -> tuple[DataFrame, DataFrame]:
    d, k = s.t("documents"), F.col("n_chars") % 7
    pages = d.select("doc_id", F.nullif("lang", F.lit("fr")).alias("document_type"), ((F.col("n_chars") % 100) / 100.0).alias("legibility"), F.when(k == 0, "too dark").alias("refusal"), F.when(k < 2, "broken").alias("error"))
    fields = d.where(k % 3 != 2).select("doc_id", F.lit("source").alias("field_name"), F.col("source").alias("value"), F.when(k == 3, "").otherwise(F.upper("lang")).alias("raw_text"), F.lit("EXTRACTED").alias("status"), F.lit(0.9).alias("confidence"))
    return pages, fields


@query("q_P11_page_results", f"""with p as ({PAGES}), f as (select doc_id, source as value from documents where (n_chars % 7) % 3 <> 2)
    select doc_id, 'Unbekannt' as document_type, '_refusal' as field_name, refusal as value, 'UNRESOLVED' as status, cast(0 as double) as confidence, refusal as validation_message from p where refusal is not null
    union all select doc_id, coalesce(document_type, 'Unbekannt'), '_error', null, 'UNRESOLVED', 0, 'Pipeline error: ' || error from p where refusal is null and error is not null
    union all select doc_id, coalesce(document_type, 'Unbekannt'), '_unresolved', null, 'UNRESOLVED', greatest(0, least(cast(legibility as double), 0.25)), 'No readable fields found' from p where error is null and doc_id not in (select doc_id from f)
    union all select doc_id, coalesce(document_type, 'Unbekannt'), 'source', value, 'EXTRACTED', 0.9, null from p join f using (doc_id) where error is null""")
def page_results(s: Source) -> DataFrame:
    """Refused and broken pages have one row whatever was read of them; pages without a field have one, too."""
    return outcomes.page_results(*_pages(s))


@query("q_P16_known_values", "select doc_id, 'source' as field_name, case when n_chars % 7 = 3 then source else upper(lang) end as context from documents where (n_chars % 7) % 3 <> 2 and source <> ''")
def known_values(s: Source) -> DataFrame:
    return outcomes.known_context(_pages(s)[1])


@query("q_P16_context_maps", "select doc_id, 'source=' || case when n_chars % 7 = 3 then source else upper(lang) end as context from documents where (n_chars % 7) % 3 <> 2 and source <> ''")
def context_maps(s: Source) -> DataFrame:
    rows = outcomes.context_maps(_pages(s)[1])
    return rows.select("doc_id", F.array_join(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("context"))


@query("q_J03_structure_boxes", """select doc_id, 'text' as field_name, case when n_chars % 4 = 0 then null else lang end as value, case when n_chars % 3 = 0 then 1.0::double else 0.5::double end as confidence,
        case when n_chars % 4 = 0 then 'null' else lang end as raw_text, case when n_chars % 5 > 1 then '{"x":' || doc_id || '}' end as bbox, 'inline' as source from documents
    union all select doc_id, 'empty', null, 0, '', null, 'inline' from documents""")
def structure_boxes(s: Source) -> DataFrame:
    """Answers of a two-pass model as JSON; some entries are no objects, some boxes are missing or no objects."""
    d, k = s.t("documents"), F.col("n_chars")
    values = F.format_string('{"text": {"raw_value": "%s", "confidence_0_to_1": %s}, "empty": {"confidence_0_to_1": "high"}, "list": [1], "word": "x"}', F.when(k % 4 == 0, "null").otherwise(F.col("lang")), F.when(k % 3 == 0, "7").otherwise("0.5"))
    boxes = F.when(k % 5 == 0, '{"text": 5}').when(k % 5 == 1, '{"text": {"estimated_bbox": [1]}}').otherwise(F.format_string('{"text": {"estimated_bbox": {"x":%d}}}', "doc_id"))
    return outcomes.mapped_answers(d.select("doc_id", values.alias("value_map"), boxes.alias("structural_map")))


@query("q_P22_error_map", "select o_orderkey, case 400 + o_orderkey % 31 when 400 then 'BAD_REQUEST' when 404 then 'NOT_FOUND' when 413 then 'FILE_TOO_LARGE' when 422 then 'VALIDATION_ERROR' when 429 then 'RATE_LIMITED' else 'HTTP_ERROR' end as code, case when o_orderkey % 31 * 1000 > 14000 then 'degraded' else 'ok' end as health from orders")
def error_map(s: Source) -> DataFrame:
    k = F.col("o_orderkey") % 31
    return s.t("orders").select("o_orderkey", outcomes.error_code(k + 400).alias("code"), outcomes.health(k * 1000).alias("health"))


@query("q_A17_whole_report", """with m as (select doc_id, sha256(text) as image_id, n_chars % 5 > 0 as there, n_chars % 3 > 0 as valid from documents),
    n as (select count(distinct image_id) as n from m where there and valid and image_id not in (select sha256(text) from documents where n_chars % 7 = 0))
    select count(*) filter (where there) as samples_scanned, count(*) filter (where there and valid) as records_prepared, any_value(n) as records_stored, count(*) filter (where not (there and valid)) as skipped, round(any_value(n) / 8.0::double, 4) as records_per_second from m, n""")
def whole_report(s: Source) -> DataFrame:
    d = s.t("documents").withColumn("image_id", F.sha2(F.col("text").cast("binary"), 256))
    files = d.where("n_chars % 5 > 0").select("doc_id", "image_id", (F.col("n_chars") % 3 > 0).alias("valid"))
    return outcomes.ingestion_report(d, files, d.where("n_chars % 7 = 0").select("image_id"), 8.0, "doc_id")


# --- synthetic data ----------------------------------------------------------------------------------------------------


@query("q_D04_synthetic_records", "select 'Gehaltsausweis' as document_type, cast(500 as bigint) as n, cast(500 as bigint) as good union all select 'Meldebescheinigung', 500, 500 union all select 'Personalausweis', 500, 500 union all select 'Steuerbescheid', 500, 500")
def synthetic_records(s: Source) -> DataFrame:
    """2000 records must all pass the rules of their types."""
    r = synth.records(s.spark, 2_000)
    f = lambda k: F.try_element_at(F.col("fields"), F.lit(k))
    good = (
        F.when(F.col("document_type") == "Steuerbescheid", identifiers.tax_id_valid(f("steueridentifikationsnummer")) & (amounts.parse_amount(f("zu_versteuerndes_einkommen")) > 0))
        .when(F.col("document_type") == "Gehaltsausweis", identifiers.tax_id_valid(f("steueridentifikationsnummer")) & (amounts.parse_amount(f("netto_lohn")) <= amounts.parse_amount(f("brutto_lohn"))))
        .when(F.col("document_type") == "Meldebescheinigung", identifiers.postal_code_valid(f("postleitzahl")) & identifiers.street_valid(f("strasse")))
        .otherwise(f("dokumentnummer").rlike("^[A-Z0-9]{9}$"))
    )
    return r.groupBy("document_type").agg(F.count("*").alias("n"), F.count_if(good).alias("good"))


@query("q_D02_synthetic_ibans", "select i as id, true as ok from range(0, 1000) t(i)")
def synthetic_ibans(s: Source) -> DataFrame:
    return s.spark.range(1_000).select("id", identifiers.iban_valid(synth.iban(F.col("id"))).alias("ok"))


@query("q_D01_synthetic_tax_ids", "select i as id, true as ok from range(0, 1000) t(i)")
def synthetic_tax_ids(s: Source) -> DataFrame:
    return s.spark.range(1_000).select("id", identifiers.tax_id_valid(synth.tax_id(F.col("id"))).alias("ok"))


@query("q_D05_seed_fan_out")
def seed_fan_out(s: Source) -> DataFrame:
    return synth.records(s.spark, 200, 7)


# --- streams -----------------------------------------------------------------------------------------------------------


@query("q_ST03_stream_ingest_dedup", "select sha256(text) as image_id from documents group by 1")
def stream_ingest_dedup(s: Source) -> DataFrame:
    """Documents as a stream of files: what is stored equals the distinct contents."""
    import uuid

    from ..sources.workspace import shared_folder
    from ..streaming.ingest import start_ingest

    root = f"{shared_folder(s.spark)}/ingest-{uuid.uuid4().hex}"
    s.t("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("image_id"), "doc_id").write.parquet(f"{root}/in")
    start_ingest(s.spark, f"{root}/in", "image_id string, doc_id bigint", f"{root}/out", f"{root}/checkpoint", files_per_batch=4)
    return s.spark.read.parquet(f"{root}/out").select("image_id")
