"""Queries over texts: lines, fields, names, kinds, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsons, udfs
from ..functions import text as T
from ..operators import classify, corpus, fewshot, lines, retrieval
from ..sources import files
from .queries import Source, query

# Oracle pieces. In the tables white space is blanks and line feeds only.
SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
NAME = "regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
LINES = f"""
    l as (select doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 5000)) as line, generate_subscripts(list_slice(string_split(text, chr(10)), 1, 5000), 1) as line_no from documents),
    s as (select doc_id, line_no, {SQ.format('line')} as text from l where trim(line) <> '')"""
KV = f"""
    k as (select doc_id, line_no, text, case when contains(text, ':') then trim(split_part(text, ':', 1)) else trim(split_part(text, '|', 1)) end as key,
            case when contains(text, ':') then trim(substr(text, instr(text, ':') + 1)) else trim(split_part(text, '|', 2)) end as value from s
        where length(text) <= 500 and (contains(text, ':') or (contains(text, '|') and len(list_filter(string_split(text, '|'), lambda p: trim(p) <> '')) = 2))),
    n as (select *, {NAME.format('key')} as nm from k where key <> '' and value <> ''),
    f as (select *, case when regexp_matches(nm, '^\\p{{N}}') then substr('field_' || nm, 1, 80) else substr(nm, 1, 80) end as field_name from n where nm <> ''),
    r as (select *, row_number() over (partition by doc_id, field_name order by line_no) as r from f),
    o as (select *, row_number() over (partition by doc_id order by line_no) as pos from r where r = 1)"""
KV_ROWS = "select doc_id, cast(pos as int) as pos, field_name, substr(value, 1, 1000) as value, case when length(value) >= 2 then cast(0.65 as double) else cast(0.3 as double) end as confidence, 'LOW_CONFIDENCE' as status, text as raw_text from o where pos <= 200"


@query("q_P01_kv_fields", f"with {LINES}, {KV} {KV_ROWS}")
def kv_fields(s: Source) -> DataFrame:
    return lines.text_fields(s.t("documents"))


@query("q_P02_text_fallback", f"""with {LINES}, {KV}, x as ({KV_ROWS})
    select * from x union all
    select doc_id, cast(1 as int), '_text', case when text <> '' then substr(text, 1, 5000) end, case when text <> '' then cast(0.35 as double) else cast(0 as double) end, case when text <> '' then 'LOW_CONFIDENCE' else 'UNRESOLVED' end, substr(text, 1, 5000)
    from documents where doc_id not in (select doc_id from x)""")
def text_fallback(s: Source) -> DataFrame:
    return lines.with_text_fallback(lines.text_fields(s.t("documents")), s.t("documents"))


@query("q_A01_doc_status_summary", f"""with {LINES}, {KV}, x as ({KV_ROWS})
    select doc_id, count(*) filter (where status = 'UNRESOLVED') as unresolved_count, count(*) filter (where status = 'VALIDATION_FAILURE') as validation_failure_count, count(*) filter (where status = 'CORRECTED') as corrected_count,
        count(*) as n_fields, round(avg(confidence), 6) as overall_confidence from x group by doc_id""")
def doc_status_summary(s: Source) -> DataFrame:
    return lines.status_counts(lines.text_fields(s.t("documents"))).withColumn("overall_confidence", F.round("overall_confidence", 6))


@query("q_A01_status_counts", """select doc_id, count(*) filter (where status = 'UNRESOLVED') as unresolved_count, count(*) filter (where status = 'VALIDATION_FAILURE') as validation_failure_count, count(*) filter (where status = 'CORRECTED') as corrected_count,
    count(*) as n_fields, round(avg(confidence), 6) as overall_confidence from ({v_status}) v group by doc_id""")
def status_counts(s: Source) -> DataFrame:
    return lines.status_counts(s.v("v_status")).withColumn("overall_confidence", F.round("overall_confidence", 6))


@query("q_W01_numbered_lines", f"with {LINES} select doc_id, line_no, '_line_' || lpad(cast(line_no as varchar), 4, '0') as field_name, text from s")
def numbered_lines(s: Source) -> DataFrame:
    rows = lines.text_lines(s.t("documents"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.concat(F.lit("_line_"), F.lpad(F.col("line_no").cast("string"), 4, "0")).alias("field_name"), "text")


@query("q_FS01_squeeze", "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed from documents")
def squeeze(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query("q_FS02_alnum_key", "select doc_id, line_no, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as key from ({v_form_lines}) v")
def alnum_key(s: Source) -> DataFrame:
    return s.v("v_form_lines").select("doc_id", "line_no", T.alnum_key(F.col("text")).alias("key"))


@query("q_FS03_field_name", f"""with n as (select doc_id, line_no, {NAME.format('text')} as nm from (""" + "{v_form_lines}" + """) v)
    select doc_id, line_no, case when nm = '' then 'field' when regexp_matches(nm, '^\\p{N}') then substr('field_' || nm, 1, 80) else substr(nm, 1, 80) end as field_name from n""")
def field_name(s: Source) -> DataFrame:
    return s.v("v_form_lines").select("doc_id", "line_no", T.field_name(F.col("text"), "field").alias("field_name"))


@query("q_FS04_strip_markup", "select page_id, regexp_replace(html, '</?b>|<br\\s*/?>', ' ', 'g') as plain from pages")
def strip_markup(s: Source) -> DataFrame:
    return s.t("pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


@query("q_FS05_html_text", "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as plain from pages")
def html_text(s: Source) -> DataFrame:
    return s.t("pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@query("q_FS06_receipt_text", """with u as (select page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as h from pages)
    select page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(h, '<\\|LOC_[0-9]+\\|>|<[^>]+>', ' ', 'g')), '[^a-z0-9./:& -]+', ' ', 'g'), '\\s+', ' ', 'g')) as plain from u""")
def receipt_text(s: Source) -> DataFrame:
    return s.t("pages").select("page_id", T.receipt_text(F.col("html")).alias("plain"))


@query("q_P03_inline_split", """select doc_id, line_no, case when contains(text, ':') then trim(split_part(text, ':', 1)) when contains(text, '=') then trim(split_part(text, '=', 1)) end as key,
    case when contains(text, ':') then trim(substr(text, instr(text, ':') + 1)) when contains(text, '=') then trim(substr(text, instr(text, '=') + 1)) end as value from ({v_form_lines}) v""")
def inline_split(s: Source) -> DataFrame:
    return s.v("v_form_lines").withColumn("kv", T.split_at(F.col("text"), [":", "=", "\t"])).select("doc_id", "line_no", "kv.key", "kv.value")


@query("q_P04_strict_split", f"""with {LINES}, p as (select doc_id, line_no, text, case when contains(text, ':') and trim(split_part(text, ':', 1)) <> '' and trim(substr(text, instr(text, ':') + 1)) <> '' then ':' when contains(text, '=') and trim(split_part(text, '=', 1)) <> '' and trim(substr(text, instr(text, '=') + 1)) <> '' then '='
        when contains(text, '|') and trim(split_part(text, '|', 1)) <> '' and trim(substr(text, instr(text, '|') + 1)) <> '' then '|' end as sep from s)
    select doc_id, line_no, trim(split_part(text, sep, 1)) as key, trim(substr(text, instr(text, sep) + 1)) as value from p where sep is not null""")
def strict_split(s: Source) -> DataFrame:
    rows = lines.text_lines(s.t("documents")).withColumn("kv", T.split_at(F.col("text"), [":", "=", "|"], both=True)).where("kv is not null")
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "kv.key", "kv.value")


@query("q_W04_structural_map", """with k as (select doc_id, line_no, text, case when contains(text, ':') and trim(substr(text, instr(text, ':') + 1)) <> '' then ':' when contains(text, '=') then '=' when contains(text, '|') then '|' end as sep from ({v_form_lines}) v),
    b as (select doc_id, line_no, case when sep is null then 'line_' || lpad(cast(line_no as varchar), 4, '0') else regexp_replace(regexp_replace(lower(trim(split_part(text, sep, 1))), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') end as base, case when sep is null then text else trim(substr(text, instr(text, sep) + 1)) end as value from k),
    r as (select *, row_number() over (partition by doc_id, base order by line_no) as r from b),
    d as (select *, length(regexp_replace(value, '[^0-9]', '', 'g')) as n from r)
    select doc_id, line_no, case when r = 1 then base else base || '_' || cast(r as varchar) end as field_name, value, case when n >= 6 and regexp_matches(value, '[./-]') then 'date' when n >= greatest(1, length(value) // 2) then 'number' else 'text' end as kind from d""")
def structural_map(s: Source) -> DataFrame:
    return lines.structural_map(s.v("v_form_lines"))


@query("q_FS17_inferred_types", f"with {LINES}, d as (select *, length(regexp_replace(text, '[^0-9]', '', 'g')) as n from s) select doc_id, line_no, case when n >= 6 and regexp_matches(text, '[./-]') then 'date' when n >= greatest(1, length(text) // 2) then 'number' else 'text' end as kind from d")
def inferred_types(s: Source) -> DataFrame:
    return lines.text_lines(s.t("documents")).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), T.field_kind(F.col("text")).alias("kind"))


@query("q_FS19_truncated", "select doc_id, (strasse like '%…' or strasse like '%...' or strasse like '%..') as truncated from ({v_person}) v")
def truncated(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", T.is_truncated(F.col("strasse")).alias("truncated"))


@query("q_FS20_search_terms", "select conv_id, turn, list_slice(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_-]', '', 'g')), lambda w: length(w) >= 4), 1, 8) as terms from conversations")
def search_terms(s: Source) -> DataFrame:
    return s.t("conversations").select("conv_id", "turn", T.search_terms(F.col("text")).alias("terms"))


@query("q_FS21_description", "select distinct field_name, case field_name when 'brutto_lohn' then 'Brutto Lohn' when 'netto_lohn' then 'Netto Lohn' else upper(substr(field_name, 1, 1)) || substr(field_name, 2) end as description from ({v_fields}) v")
def description(s: Source) -> DataFrame:
    return s.v("v_fields").select("field_name").distinct().select("field_name", T.title(F.col("field_name")).alias("description"))


@query("q_FS22_prompt_tokens", "select doc_id, case when trim(text) = '' then 0.0 else round(cast(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) as double) / cast(0.75 as double), 6) end as tokens from documents")
def prompt_tokens(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", F.round(T.prompt_tokens(F.col("text")), 6).alias("tokens"))


@query("q_FS23_correction_tokens", "select conv_id, turn, cast(12 + floor(cast(length(text) as double) / 3.5) as bigint) as tokens from conversations")
def correction_tokens(s: Source) -> DataFrame:
    return s.t("conversations").select("conv_id", "turn", T.correction_tokens(F.col("text")).alias("tokens"))


@query("q_W05_token_budget", """with t as (select conv_id, turn, cast(12 + floor(cast(length(text) as double) / 3.5) as bigint) as tokens from conversations),
    u as (select *, cast(8 + sum(tokens) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as used from t) select conv_id, turn, tokens, used from u where used <= 250""")
def token_budget(s: Source) -> DataFrame:
    return fewshot.within_budget(s.t("conversations"), ["conv_id"], [F.col("turn")], "text").select("conv_id", "turn", "tokens", "used")


@query("q_FS24_few_shot_block", """with n as (select *, row_number() over (partition by field, doc_type order by k) as i from ({v_corr}) v)
    select field, doc_type, chr(10) || 'LEARNED CORRECTIONS (apply these patterns):' || chr(10) || chr(10) || string_agg('  ' || cast(i as varchar) || '. Similar document: ''' || original || ''' was corrected to ''' || corrected || '''.' || case when reason <> '' then ' Reason: ' || reason else '' end, chr(10) order by i) || chr(10) as block
    from n where i <= 5 group by field, doc_type""")
def few_shot_block(s: Source) -> DataFrame:
    return fewshot.correction_block(s.v("v_corr"), ["field", "doc_type"], "k")


@query("q_FS24_field_block", """with n as (select *, row_number() over (partition by doc_type order by k) as i from ({v_corr}) v)
    select doc_type, '=== LEARNED CORRECTIONS (apply these patterns) ===' || chr(10) || string_agg('- Field ''' || field || ''': ''' || original || ''' was corrected to ''' || corrected || '''. Reason: ' || reason, chr(10) order by i) || chr(10) || '=== END LEARNED CORRECTIONS ===' as block from n where i <= 5 group by doc_type""")
def field_block(s: Source) -> DataFrame:
    return fewshot.field_block(s.v("v_corr"), ["doc_type"], "k")


@query("q_O13_example_block", """with n as (select *, row_number() over (partition by form_type order by image_id) as i, case when quality_score = floor(quality_score) then '' end as z from ({v_images}) v)
    select form_type, '=== LEARNED IMAGE EXAMPLES (use as OCR/quality patterns) ===' || chr(10) || string_agg(cast(i as varchar) || '. label=' || label_name || '; form_type=' || form_type || '; quality=' || printf('%.2f', quality_score) || '; ocr=''' || substr(trim(regexp_replace(ocr_text, '\\s+', ' ', 'g')), 1, 400) || '''', chr(10) order by i) || chr(10) || '=== END LEARNED IMAGE EXAMPLES ===' as block
    from n where i <= 5 group by form_type""")
def example_block(s: Source) -> DataFrame:
    return fewshot.example_block(s.v("v_images"), ["form_type"], "image_id")


@query("q_FS25_prompt", """with n as (select *, row_number() over (partition by doc_type order by k) as i from ({v_corr}) v),
    b as (select doc_type, '=== LEARNED CORRECTIONS (apply these patterns) ===' || chr(10) || string_agg('- Field ''' || field || ''': ''' || original || ''' was corrected to ''' || corrected || '''. Reason: ' || reason, chr(10) order by i) || chr(10) || '=== END LEARNED CORRECTIONS ===' as block from n where i <= 5 group by doc_type)
    select k, 'Document type: ' || c.doc_type || chr(10) || chr(10) || 'Fields:' || chr(10) || field || chr(10) || chr(10) || block || chr(10) || chr(10) || 'Recognised text:' || chr(10) || original as prompt from ({v_corr}) c join b using (doc_type)""")
def prompts(s: Source) -> DataFrame:
    c = s.v("v_corr")
    return c.join(fewshot.field_block(c, ["doc_type"], "k"), "doc_type").select("k", fewshot.prompt(F.col("doc_type"), F.col("field"), F.col("block"), F.col("original")).alias("prompt"))


@query("q_FS26_field_guide")
def field_guide(s: Source) -> DataFrame:
    from .. import catalog

    c = catalog.field_catalog(s.spark).withColumn("ord", F.row_number().over(Window.partitionBy("doc_type").orderBy("field")))
    return fewshot.field_guide(c)


@query("q_FS27_german_amount", """select o_orderkey, replace(replace(replace(format('{:,.2f}', round(o_totalprice, 2)), ',', '#'), '.', ','), '#', '.') as shown from orders""")
def german_amount(s: Source) -> DataFrame:
    from ..functions.amounts import german_amount as shown

    return s.t("orders").select("o_orderkey", shown(F.round("o_totalprice", 2)).alias("shown"))


@query("q_FS28_tagged", "select c_custkey, '<s_name>' || c_name || '</s_name><s_segment>' || c_mktsegment || '</s_segment>' as tagged from customer")
def tagged(s: Source) -> DataFrame:
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return s.t("customer").select("c_custkey", corpus.tagged(m).alias("tagged"))


@query("q_FS29_human_formats", """select doc_id, case when n_chars < 1024 then cast(n_chars as varchar) || ' B' else printf('%.1f', round(cast(n_chars as double) / 1024, 1)) || ' KB' end as size, case when n_chars < 1000 then cast(n_chars as varchar) || 'ms' else printf('%.1f', round(cast(n_chars as double) / 1000, 1)) || 's' end as duration from documents""")
def human_formats(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", T.human_size(F.col("n_chars")).alias("size"), T.duration(F.col("n_chars")).alias("duration"))


@query("q_FS30_content_hash", "select doc_id, sha256(text) as image_id from documents")
def content_hash(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("image_id"))


@query("q_P25_summary_text", "select image_id, 'label=' || label_name || chr(10) || 'form_type=' || form_type || chr(10) || 'quality=' || printf('%.2f', quality_score) || case when ocr_text <> '' then chr(10) || substr(ocr_text, 1, 2000) else '' end as summary from ({v_images}) v")
def summary_text(s: Source) -> DataFrame:
    return s.v("v_images").select("image_id", T.summary_text(F.col("label_name"), F.col("form_type"), F.col("quality_score"), F.col("ocr_text")).alias("summary"))


@query("q_FS10_similarity")
def similarity(s: Source) -> DataFrame:
    return s.v("v_truth").join(s.v("v_pred").withColumnRenamed("value", "pred"), ["doc_id", "field_name"]).select("doc_id", "field_name", udfs.similarity(F.col("pred"), F.col("value")).alias("similarity"))


@query("q_FA01_hashed_embedding")
def hashed_embedding(s: Source) -> DataFrame:
    return s.t("benchmark").select("item_id", udfs.hashed_embedding(F.col("text")).alias("embedding"))


@query("q_FJ01_json_salvage", "select event_id, props as found from events where event_id % 5 <> 4 union all select event_id, null from events where event_id % 5 = 4")
def json_salvage(s: Source) -> DataFrame:
    k = F.col("event_id") % 5
    wrapped = F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 1, F.col("props")).when(k == 2, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" Done."))).when(k == 3, F.concat(F.lit("```\n"), F.col("props"), F.lit("```"))).otherwise(F.lit("no { object"))
    return s.t("events").select("event_id", jsons.salvage(wrapped).alias("found"))


@query("q_FJ02_json_block", "select event_id, props as found from events")
def json_block(s: Source) -> DataFrame:
    return s.t("events").select("event_id", udfs.json_block(F.concat(F.lit("Answer } first: "), F.col("props"), F.lit(" and {\"x\": \"}\"}"))).alias("found"))


@query("q_FJ03_json_loose", "select event_id, props as found from events")
def json_loose(s: Source) -> DataFrame:
    return s.t("events").select("event_id", jsons.salvage_loose(F.concat(F.lit("The answer: "), F.col("props"), F.lit("."))).alias("found"))


@query("q_FJ05_schema_forced_json", "select event_id, case when event_id % 4 <> 3 then cast(json_extract(props, '$.k') as bigint) end as k, event_id % 4 <> 3 as ok from events")
def schema_forced_json(s: Source) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 3, F.lit('{"k": "not a number"}')).otherwise(F.col("props"))
    parsed = jsons.read_strict(text, "k bigint")
    return s.t("events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.col("p").isNotNull().alias("ok"))


@query("q_FJ04_payload_json", """select image_id, to_json({'filename': image_id || '.png', 'label_name': label_name, 'form_type': form_type, 'quality_score': quality_score, 'ocr_text': substr(label_name, 1, 2000)}) as payload from ({v_images}) v""")
def payload_json(s: Source) -> DataFrame:
    return corpus.record_payload(s.v("v_images").withColumn("filename", F.concat("image_id", F.lit(".png"))).withColumn("ocr_text", F.col("label_name")))


WORDS = {"en": ["the ", " and ", "tion"], "de": [" der ", " und ", "ung"], "fr": [" le ", " et ", "eux"], "es": [" el ", " los ", "ción"]}
COUNTS = "select doc_id, " + ", ".join(" + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in ws) + f" as n_{k}" for k, ws in WORDS.items()) + " from documents"


@query("q_J08_doc_class_keywords", f"select doc_id, case when greatest(n_en, n_de, n_fr, n_es) = 0 then 'none' when n_en >= n_de and n_en >= n_fr and n_en >= n_es then 'en' when n_de >= n_fr and n_de >= n_es then 'de' when n_fr >= n_es then 'fr' else 'es' end as kind from ({COUNTS})")
def doc_class_keywords(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", classify.classify(F.col("text"), WORDS, "none").alias("kind"))


@query("q_W12_doc_class_unknown", """with c as (select doc_id, [cast(contains(t, 'the ') as int) + cast(contains(t, ' and ') as int), cast(contains(t, 'der ') as int) + cast(contains(t, ' und ') as int), cast(contains(t, ' les ') as int) + cast(contains(t, ' des ') as int)] as n from (select doc_id, lower(text) as t from documents))
    select doc_id, case when list_max(n) = 0 then 'Unbekannt' when n[1] = list_max(n) then 'first' when n[2] = list_max(n) then 'second' else 'third' end as document_type from c""")
def doc_class_unknown(s: Source) -> DataFrame:
    """The type with most words, ties to the first, and the unknown type without any."""
    words = {"first": ["the ", " and "], "second": ["der ", " und "], "third": [" les ", " des "]}
    return classify.classify_documents(s.t("documents"), words).select("doc_id", "document_type")


@query("q_J09_preview_class", "select doc_id, line_no, case when contains(lower(text), 'brutto') then 'Gehaltsausweis' else 'Unbekannt' end as kind from ({v_form_lines}) v")
def preview_class(s: Source) -> DataFrame:
    from ..catalog import PREVIEW_KEYWORDS

    return s.v("v_form_lines").select("doc_id", "line_no", classify.classify(F.col("text"), PREVIEW_KEYWORDS).alias("kind"))


@query("q_P28_label_from_filename", "select page_id, case when url like '%/en/%' then 'english' when url like '%/de/%' then 'german' when url like '%/fr/%' then 'french' else 'other' end as label from pages")
def label_from_filename(s: Source) -> DataFrame:
    return s.t("pages").select("page_id", classify.label_from_filename(F.col("url"), [("/en/", "english"), ("/de/", "german"), ("/fr/", "french")], "other").alias("label"))


@query("q_S02_content_type", "select page_id, case when url like '%.html' then 'text/html' end as kind, url like '%.html' as allowed from pages")
def content_type(s: Source) -> DataFrame:
    kind = files.content_type(F.lit(None).cast("string"), F.col("url"))
    return s.t("pages").select("page_id", kind.alias("kind"), files.type_allowed(kind).alias("allowed"))


@query("q_S03_magic_bytes", "select o_orderkey, o_orderkey % 4 = 3 or o_orderkey % 4 = o_orderkey // 4 % 5 as fits from orders")
def magic_bytes(s: Source) -> DataFrame:
    """Five kinds of first bytes under four declared types, the last of which is a text type."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("image/png", "image/jpeg", "application/pdf", "text/plain")]), (k % 4 + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(x) for x in ("89504E470D0A1A0A00", "FFD8FFE000104A46", "255044462D312E37", "474946383961", "")]), (F.expr("o_orderkey div 4") % 5 + 1).cast("int"))
    return s.t("orders").select("o_orderkey", files.magic_matches(kind, F.unhex(head)).alias("fits"))


@query("q_S04_size_cap", "select doc_id, n_chars <= 2000 as small from documents")
def size_cap(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", files.size_allowed(F.col("n_chars"), 2000).alias("small"))


@query("q_S05_image_suffix", "select l_orderkey, l_linenumber, l_linenumber % 3 = 1 as image from lineitem")
def image_suffix(s: Source) -> DataFrame:
    name = F.concat(F.col("l_orderkey").cast("string"), F.element_at(F.array(F.lit(".TXT"), F.lit(".Jpeg"), F.lit("")), F.col("l_linenumber") % 3 + 1))
    return s.t("lineitem").select("l_orderkey", "l_linenumber", files.is_image(name).alias("image"))


@query("q_S09_table_text", "select c_custkey, c_name || ' | ' || c_mktsegment || ' | a,b' || chr(10) || '1 | ' || cast(c_nationkey as varchar) || ' | x' as shown from customer")
def table_text(s: Source) -> DataFrame:
    csv = F.concat(F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit(',"a,b"\r\n1,'), F.col("c_nationkey").cast("string"), F.lit(" ,x\n"))
    return s.t("customer").select("c_custkey", files.table_text(csv, ",").alias("shown"))


@query("q_S10_json_text")
def json_text(s: Source) -> DataFrame:
    return s.t("events").select("event_id", files.json_text(F.col("props")).alias("shown"))


@query("q_S11_decoded_text", "select doc_id, substr(text, 1, 200000) as shown from documents")
def decoded_text(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", files.decoded(F.col("text").cast("binary")).alias("shown"))


TERM = "select distinct doc_id from (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'))) as token from documents) where token in ('thereon', 'that', 'from')"


@query("q_J01_fts_or_match", f"select d.doc_id, d.n_chars from documents d join ({TERM}) using (doc_id) order by n_chars desc, doc_id limit 50")
def fts_or_match(s: Source) -> DataFrame:
    d = s.t("documents")
    return retrieval.search(d, ["text"], "thereon that from to", 50, "doc_id", "n_chars").select("doc_id", "n_chars")


@query("q_O04_text_fallback_order", "select doc_id, n_chars from documents where lang = 'de' order by n_chars desc, doc_id limit 20")
def text_fallback_order(s: Source) -> DataFrame:
    d = s.t("documents")
    return retrieval.search(d, ["text"], "to be or", 20, "doc_id", "n_chars", "de", "lang").select("doc_id", "n_chars")


@query("q_A23_field_vocabulary", "select distinct 'f_' || event_type as field_name from events union select 'k'")
def field_vocabulary(s: Source) -> DataFrame:
    m = F.create_map(F.concat(F.lit("f_"), F.col("event_type")), F.lit(1), F.lit("k"), F.lit(2))
    return corpus.field_vocabulary(s.t("events").select(m.alias("fields")))
