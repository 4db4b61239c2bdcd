"""Queries over sources, sinks, streams and plug-ins, and the rest of the inventory. What is written goes to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import catalog
from ..functions import amounts, dates, geometry, identifiers, udfs
from ..functions import text as T
from ..operators import corpus, layout, mapper, plugins, quality, retrieval, stats, synth, validate
from ..sources import files, tables
from ..sources.workspace import shared_folder
from .queries import Source, query


def _folder(s: Source, name: str) -> str:
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


# --- files -------------------------------------------------------------------------------------------------------------


@query("q_S01_uploads", "select n_nationkey, 1700000000000000 + n_nationkey || '_' || case when n_nationkey % 5 = 0 then 'upload' when n_nationkey % 5 = 1 then '' else n_name || '.txt' end as stored, cast(length(n_name) as bigint) as length from nation")
def uploads(s: Source) -> DataFrame:
    """Names as clients send them, with folders and without; what is stored is read again by its own name."""
    k = F.col("n_nationkey") % 5
    sent = F.when(k == 0, None).when(k == 1, "a/b/").when(k == 2, F.concat(F.lit("../../etc/"), "n_name", F.lit(".txt"))).otherwise(F.concat("n_name", F.lit(".txt")))
    rows = s.t("nation").select("n_nationkey", files.stored_name(sent, F.lit(1_700_000_000_000_000) + F.col("n_nationkey")).alias("stored"), F.col("n_name").cast("binary").alias("content"))
    path = _folder(s, "uploads")
    rows.write.parquet(path)
    return s.spark.read.parquet(path).where(files.size_allowed(F.octet_length("content"))).select("n_nationkey", "stored", F.octet_length("content").cast("bigint").alias("length"))


@query("q_S06_parser_dispatch", "select c_custkey, case c_custkey % 4 when 0 then 'csv' when 1 then 'text' when 2 then 'json' else 'fallback' end as parser, case c_custkey % 4 when 0 then c_name || ' | x' when 1 then c_name when 2 then 'json' else c_name end as shown from customer")
def parser_dispatch(s: Source) -> DataFrame:
    k = F.col("c_custkey") % 4
    name = F.concat(F.col("c_custkey").cast("string"), F.element_at(F.array(F.lit(".csv"), F.lit(".TXT"), F.lit(".json"), F.lit(".dat")), (k + 1).cast("int")))
    body = F.when(k == 0, F.concat("c_name", F.lit(", x"))).when(k == 2, F.lit('{"a": 1}')).otherwise(F.col("c_name"))
    rows = files.file_text(s.t("customer").select(name.alias("path"), body.cast("binary").alias("content")))
    return rows.select(F.substring_index("path", ".", 1).cast("bigint").alias("c_custkey"), "parser", F.when(F.col("parser") == "json", "json").otherwise(F.col("text")).alias("shown"))


@query("q_S07_pdf_boundary", "select n_nationkey, case when n_nationkey % 2 = 0 then 'pdf' else 'text' end as parser, case when n_nationkey % 2 = 1 then n_name when n_nationkey % 4 = 0 then n_name || chr(10) || 'page 2' end as shown from nation")
def pdf_boundary(s: Source) -> DataFrame:
    """No reader of PDF belongs to the library: such files get a null text, which an engine's pages may fill; blank pages go."""
    k = F.col("n_nationkey")
    rows = s.t("nation").select(F.concat(k.cast("string"), F.when(k % 2 == 0, ".pdf").otherwise(".txt")).alias("path"), F.col("n_name").cast("binary").alias("content"))
    pages = s.t("nation").where("n_nationkey % 4 = 0").select(F.concat(k.cast("string"), F.lit(".pdf")).alias("path"), F.explode(F.array(F.struct(F.lit(1).alias("page"), F.col("n_name").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("  ").alias("text")), F.struct(F.lit(3).alias("page"), F.lit("page 2").alias("text")))).alias("p")).select("path", "p.*")
    return files.with_pages(files.file_text(rows), pages).select(F.substring_index("path", ".", 1).cast("int").alias("n_nationkey"), "parser", F.col("text").alias("shown"))


@query("q_S08_docx_text", "select n_nationkey, case n_nationkey % 3 when 0 then 'Name: ' || n_name || ' end' end as shown from nation")
def docx_text(s: Source) -> DataFrame:
    """Archives with a document, archives without one, and what is no archive."""
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for rows in batches:
            out = []
            for k, name in zip(rows["n_nationkey"], rows["n_name"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml" if k % 3 == 0 else "other.xml", f"<w:document><w:p><w:r><w:t>Name: {name}</w:t></w:r></w:p><w:p><w:t>end</w:t></w:p></w:document>")
                out.append(held.getvalue() if k % 3 < 2 else name.encode())
            yield pd.DataFrame({"n_nationkey": rows["n_nationkey"], "content": out})

    rows = s.t("nation").select("n_nationkey", "n_name").mapInPandas(pack, "n_nationkey int, content binary")
    return rows.select("n_nationkey", udfs.docx_text("content").alias("shown"))


@query("q_S12_grey_image")
def grey_image(s: Source) -> DataFrame:
    grey = F.transform(F.concat("embedding", "embedding"), lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x * 200 + 128).cast("int"))).cast("bigint")), 2, "0"))
    p = s.t("embeddings").select("vec_id", udfs.pixel_stats(F.unhex(F.array_join(grey, "")), F.lit(16), F.lit(8)).alias("p"))
    sharp, contrast, size = quality.sharpness_score(F.col("p.variance"), F.col("p.noise")), quality.contrast_score(F.col("p.p2"), F.col("p.p98")), quality.size_score(F.lit(16), F.lit(8))
    return p.select("vec_id", F.round(quality.legibility(sharp, contrast, size), 6).alias("legibility"))


@query("q_S15_plain_lines", "select doc_id, line_no, text, cast(0.55 as double) as confidence from (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as text from documents) where text <> ''")
def plain_lines(s: Source) -> DataFrame:
    from ..operators.lines import text_lines

    rows = text_lines(s.t("documents"), most=1 << 30).withColumn("confidence", F.lit(None).cast("double"))
    return layout.normalise_lines(rows, default=0.55).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text", "confidence")


@query("q_S16_vision_lines", "select doc_id, line_no, round(greatest(0.0, least(1.0, 1 - (y1 + 0.02::double))), 6) as top, row_number() over (partition by doc_id order by round(greatest(0.0, least(1.0, 1 - (y1 + 0.02::double))), 2), x1, line_no, text) as position from ({v_fragments}) v where confidence >= 0.3")
def vision_lines(s: Source) -> DataFrame:
    rows = layout.normalise_lines(s.v("v_fragments"), floor=0.30)
    b = geometry.from_bottom_left(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.lit(0.02))
    rows = rows.withColumn("b", b)
    order = Window.partitionBy("doc_id").orderBy(F.round("b.y1", 2), "x1", "line_no", "text")
    return rows.select("doc_id", "line_no", F.round("b.y1", 6).alias("top"), F.row_number().over(order).cast("bigint").alias("position"))


# --- tables that are written and read again ----------------------------------------------------------------------------


@query("q_K01_audit_append", "select document_type, count(*) as n, round(avg(overall_confidence), 6) as mean from ({v_audit}) v group by document_type")
def audit_append(s: Source) -> DataFrame:
    path = _folder(s, "audit")
    a = s.v("v_audit").select("timestamp", "extraction_id", "document_type", "overall_confidence")
    for k in range(2):  # two appends, partitioned by day and compressed
        tables.append_audit(a.where(F.pmod(F.hash("extraction_id"), F.lit(2)) == k), path)
    return tables.read_audit(s.spark, path).groupBy("document_type").agg(F.count("*").alias("n"), F.round(F.avg("overall_confidence"), 6).alias("mean"))


@query("q_S20_audit_reader", "select extraction_id, overall_confidence from ({v_audit}) v where user_id % 5 <> 0")
def audit_reader(s: Source) -> DataFrame:
    """Blank and broken lines of the log are skipped."""
    path = _folder(s, "log")
    good = F.to_json(F.struct("extraction_id", "overall_confidence"))
    s.v("v_audit").select(F.when(F.col("user_id") % 10 == 0, "").when(F.col("user_id") % 5 == 0, "{broken").otherwise(good)).write.text(path)
    return tables.read_audit(s.spark, path).select("extraction_id", "overall_confidence")


@query("q_K02_rotation", "select day, row_number() over (order by day desc) > 10 as remove from (select distinct substr(timestamp, 1, 10) as day from ({v_audit}) v)")
def rotation(s: Source) -> DataFrame:
    days = s.v("v_audit").select(F.substring("timestamp", 1, 10).alias("day")).distinct().withColumn("kind", F.lit("audit"))
    return corpus.keep_newest(days, ["kind"], F.col("day"), 10).select("day", "remove")


@query("q_K03_extraction_store", "select extraction_id, document_type, overall_confidence from ({v_audit}) v")
def extraction_store(s: Source) -> DataFrame:
    path = _folder(s, "extractions")
    tables.write_extractions(s.v("v_audit").select("extraction_id", "document_type", "overall_confidence"), path)
    return s.spark.read.parquet(path)


@query("q_S26_extraction_lookup", "select extraction_id, document_type from ({v_audit}) v where extraction_id = 'x000000007'")
def extraction_lookup(s: Source) -> DataFrame:
    path = _folder(s, "extractions")
    tables.write_extractions(s.v("v_audit").select("extraction_id", "document_type"), path)
    return tables.find_extraction(s.spark, path, "x000000007").select("extraction_id", "document_type")


@query("q_S19_manifest", "select 'f' || cast(doc_id as varchar) as filename, lang as label_name, n_chars as file_size from documents")
def manifest(s: Source) -> DataFrame:
    path = _folder(s, "manifest")
    rows = s.t("documents").select(F.concat(F.lit("f"), "doc_id").alias("filename"), F.col("lang").alias("label_name"), F.col("n_chars").alias("file_size"))
    tables.write_json_lines(rows, path)
    return tables.read_json_lines(s.spark, path, catalog.SCHEMAS["manifest"]).select("filename", "label_name", "file_size")


@query("q_S24_gold_records", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 100")
def gold_records(s: Source) -> DataFrame:
    """The first records of a file of gold records, in their order."""
    path = _folder(s, "gold")
    tables.write_json_lines(s.t("orders").select("o_orderkey", "o_totalprice"), path)
    return tables.read_json_lines(s.spark, path, "o_orderkey bigint, o_totalprice double", 100, "o_orderkey")


@query("q_S25_first_existing", "select doc_id from labels where doc_id in (select doc_id from documents) order by doc_id limit 25")
def first_existing(s: Source) -> DataFrame:
    return corpus.manifest_of_existing(s.t("labels").select("doc_id"), s.t("documents"), "doc_id", 25)


@query("q_K08_train_val_files", "with r as (select doc_id, row_number() over (order by md5('0:' || cast(doc_id as varchar)), doc_id) as r, count(*) over () as n from documents) select case when r <= cast(floor(n * 0.2) as bigint) then 'val' else 'train' end as part, count(*) as n from r group by 1")
def train_val_files(s: Source) -> DataFrame:
    path = _folder(s, "sets")
    corpus.split_exactly(s.t("documents").select("doc_id"), "doc_id", 0.2).write.partitionBy("part").json(path)
    return s.spark.read.schema("doc_id bigint, part string").json(path).groupBy("part").agg(F.count("*").alias("n"))


@query("q_K04_store_and_index", "select token, count(*) as n from (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(source || ' ' || lang), '[^\\p{L}\\p{N}_]+'))) as token from documents) where token <> '' group by token")
def store_and_index(s: Source) -> DataFrame:
    """Insert or ignore twice into a stored table; its index is made from what is stored."""
    path = _folder(s, "images")
    d = s.t("documents").select(F.col("doc_id").alias("image_id"), "source", "lang")
    d.where("image_id % 2 = 0").write.parquet(path)
    for _ in range(2):
        corpus.new_records(s.spark.read.parquet(path), d, "image_id").write.mode("append").parquet(path)
    return retrieval.inverted_index(s.spark.read.parquet(path), ["source", "lang"], "image_id").groupBy("token").agg(F.count("*").alias("n"))


@query("q_S21_schema_evolution", "select c_custkey, c_name, case when c_custkey % 2 = 1 then 'h' end as visual_hash from customer")
def schema_evolution(s: Source) -> DataFrame:
    """A column that older files lack reads as null."""
    path = _folder(s, "images")
    c = s.t("customer").select("c_custkey", "c_name")
    c.where("c_custkey % 2 = 0").write.parquet(path)
    c.where("c_custkey % 2 = 1").withColumn("visual_hash", F.lit("h")).write.mode("append").parquet(path)
    return s.spark.read.option("mergeSchema", "true").parquet(path)


@query("q_S22_correction_by_id", "select id, original from ({v_corr}) v where id = 'c17'")
def correction_by_id(s: Source) -> DataFrame:
    return s.v("v_corr").where("id = 'c17'").select("id", "original")


@query("q_S23_split_download", "select doc_id, split from (select doc_id, split, row_number() over (order by case split when 'train' then 0 when 'val' then 1 else 2 end, doc_id) as n from (select doc_id, case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'val' else 'train' end as split from documents)) where n <= 185")
def split_download(s: Source) -> DataFrame:
    """Three splits, read one after another until there are enough records."""
    k, root = F.col("doc_id") % 10, _folder(s, "splits")
    s.t("documents").select("doc_id", F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split")).write.partitionBy("split").parquet(root)
    parts = {name: s.spark.read.schema("doc_id bigint").parquet(f"{root}/split={name}") for name in ("train", "val", "test")}
    return corpus.first_of_splits(parts, 185, "doc_id")


@query("q_S27_log_tail", "select cast(event_id as varchar) as value from events order by event_id desc limit 60")
def log_tail(s: Source) -> DataFrame:
    path = _folder(s, "log")
    tables.write_log(s.t("events"), path, "event_id", "event_id")
    return tables.ordered_log_tail(s.spark, path, 60).select("value")


@query("q_K07_atomic_replace", "select r_regionkey, lower(r_name) as r_name from region")
def atomic_replace(s: Source) -> DataFrame:
    """A committed overwrite: readers see the old files or the new ones."""
    path = _folder(s, "state")
    s.t("region").write.parquet(path)
    s.t("region").withColumn("r_name", F.lower("r_name")).write.mode("overwrite").parquet(path)
    return s.spark.read.parquet(path)


@query("q_S18_memo", "select event_id, event_type as text from events")
def memo(s: Source) -> DataFrame:
    """Many requests for few paths: each path is extracted once."""
    rows = s.t("events").select("event_id", F.col("event_type").alias("path"))
    pages = rows.select("path").distinct().select("path", F.xxhash64("path").alias("doc_id"), F.col("path").alias("text"))
    found = plugins.run_engine(pages, "lines").select("doc_id", "text").join(pages.select("doc_id", "path"), "doc_id")
    return rows.join(F.broadcast(found), "path").select("event_id", "text")


@query("q_S28_generated_types", "select t as document_type, cast(25 as bigint) as n from (values ('Meldebescheinigung'), ('Steuerbescheid'), ('Gehaltsausweis'), ('Personalausweis')) v(t)")
def generated_types(s: Source) -> DataFrame:
    return synth.records(s.spark, 100).groupBy("document_type").agg(F.count("*").alias("n"))


@query("q_S29_settings", "select k as key, v as value from (values ('ENABLE_LLM_STRUCTURING', 'true'), ('LLM_N_CTX', '2048'), ('OCR_ENGINE', 'tiered'), ('RENDER_DPI', '200')) t(k, v)")
def settings(s: Source) -> DataFrame:
    """Settings of a file over the defaults; comments, unknown keys and values of the wrong type do nothing, the last line of a key counts."""
    lines = ["# engines", "OCR_ENGINE=surya", 'export OCR_ENGINE = "tiered"', "ENABLE_LLM_STRUCTURING=1", "LLM_N_CTX=many", "UNKNOWN=1", ""]
    defaults = {"OCR_ENGINE": "surya", "ENABLE_LLM_STRUCTURING": False, "LLM_N_CTX": 2048, "RENDER_DPI": 200}
    return files.settings(s.spark.createDataFrame(list(enumerate(lines)), "at int, line string"), defaults)


# --- streams -----------------------------------------------------------------------------------------------------------


FILES_PER_ROUND = 8  # else there are as many batches as tasks that read the documents, and each has its fixed cost


def _ingest(s: Source, rounds: int, per_batch: int) -> tuple[str, DataFrame]:
    from ..streaming.ingest import start_ingest

    root = _folder(s, "ingest")
    d = s.t("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("image_id"), F.col("doc_id"))
    for k in range(rounds):  # each round brings new files; the checkpoint says which are read already
        d.where(F.col("doc_id") % rounds <= k).repartition(FILES_PER_ROUND).write.mode("append").parquet(f"{root}/in")
        start_ingest(s.spark, f"{root}/in", "image_id string, doc_id bigint", f"{root}/out", f"{root}/checkpoint", files_per_batch=per_batch)
    return root, s.spark.read.parquet(f"{root}/out")


@query("q_ST01_resume", "select sha256(text) as image_id from documents group by 1")
def resume(s: Source) -> DataFrame:
    return _ingest(s, 2, 8)[1].select("image_id")


@query("q_ST02_idempotent", "select cast(count(distinct sha256(text)) as bigint) as n, cast(count(distinct sha256(text)) as bigint) as ids from documents")
def idempotent(s: Source) -> DataFrame:
    return _ingest(s, 2, 1)[1].agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("ids"))


@query("q_ST04_micro_batches", "select sha256(text) as image_id from documents group by 1")
def micro_batches(s: Source) -> DataFrame:
    return _ingest(s, 1, 1)[1].select("image_id")


@query("q_ST07_run_states", """select user_id, case when user_id % 7 = 0 then 'error' when user_id % 7 = 1 then 'idle' when user_id % 5 = 0 then 'running' when max(value) % 20 < 10 then 'external' else 'stopped' end as state from events group by user_id""")
def run_states(s: Source) -> DataFrame:
    from ..streaming.ingest import state_of_run

    k, said = F.col("user_id"), F.when(F.col("user_id") % 7 == 0, "error").when(F.col("user_id") % 7 == 1, "idle").otherwise("running")
    return s.t("events").groupBy("user_id").agg((F.max("value") % 20).alias("age")).select("user_id", state_of_run(said, F.col("age"), (k % 5 == 0) & (k % 7 > 1)).alias("state"))


@query("q_ST05_stops", """with i as (select user_id as run, event_id, row_number() over (partition by user_id order by event_id) as n, event_type = 'purchase' as is_new, value from events),
    g as (select *, sum(cast(is_new as int)) over (partition by run order by n rows unbounded preceding) as island, sum(value) over (partition by run order by n rows unbounded preceding) as elapsed from i),
    k as (select *, sum(1 - cast(is_new as int)) over (partition by run, island order by n rows unbounded preceding) as streak from g),
    r as (select run, event_id, n, case when elapsed >= 3000 then 'seconds' when n > 40 then 'limit' when streak >= 12 then 'plateau' end as reason from k)
    select run, min(event_id) as stop_at, arg_min(reason, n) as reason from r where reason is not null group by run""")
def stops(s: Source) -> DataFrame:
    """Where each run ends: after so many seconds, so many items, or so many without anything new, whichever comes first."""
    rows = s.t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), (F.col("event_type") == "purchase").alias("is_new"), F.col("value").alias("seconds"))
    return stats.stops(rows, max_seconds=3000, limit=40, window=12)


@query("q_ST06_heartbeats", "select user_id as run, event_id // 500 as beat, max(event_id) as at, count(*) as items from events group by all")
def heartbeats(s: Source) -> DataFrame:
    """One row for each run and interval in which it did something: its last item there."""
    return stats.heartbeats(s.t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at")), 500)


@query("q_ST12_resume_set", "select run, event_id from (select user_id as run, event_id, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as c from events) where n <= c // 50 * 50")
def resume_set(s: Source) -> DataFrame:
    """The files that count as done after a break: those up to the last time the set was stored, every 50 files."""
    return stats.resume_set(s.t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at")), 50).select("run", F.col("at").alias("event_id"))


@query("q_X02_engine_choice", """select o_orderkey, case when o_orderkey % 6 in (0, 1, 2) and o_orderkey % 2 = 0 then 'apple-vision' else 'surya' end as engine from orders""")
def engine_choice(s: Source) -> DataFrame:
    """The engine that a setting names; without its library, and for any other setting, the default one."""
    k = F.col("o_orderkey")
    setting = F.element_at(F.array(*[F.lit(x) for x in ("apple-vision", " Apple ", "VISION", "surya", "", "other")]), (k % 6 + 1).cast("int"))
    return s.t("orders").select("o_orderkey", plugins.engine_of_setting(setting, k % 2 == 0).alias("engine"))


@query("q_S13_tiered_lines", """with l as (select conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as n, text from conversations)
    select conv_id, turn, case when n < 3 then 'lines' else 'sure' end as engine, cast(n as bigint) as n from l where n > 0""")
def tiered_lines(s: Source) -> DataFrame:
    """A fast engine first; pages with less than three lines or little confidence go to the full one, whose lines count if they are not fewer."""
    rows = s.t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    out = plugins.run_tiered(rows, "sure", "lines").groupBy("doc_id", "engine").agg(F.count("*").alias("n"))
    return out.select(F.expr("doc_id div 1000").alias("conv_id"), (F.col("doc_id") % 1000).alias("turn"), "engine", "n")


@query("q_X08_canned_fields", """select doc_id, f as field_name, v as raw_value, cast(c as double) as confidence from documents cross join (values ('familienname', 'Müller', 0.95), ('vorname', 'Hans', 0.93), ('geburtsdatum', '15.03.1985', 0.91), ('geburtsort', 'Berlin', 0.88),
    ('staatsangehoerigkeit', 'Deutsch', 0.92), ('strasse', 'Hauptstraße', 0.85), ('hausnummer', '42', 0.97), ('postleitzahl', '10115', 0.96), ('wohnort', 'Berlin', 0.94)) t(f, v, c)""")
def canned_fields(s: Source) -> DataFrame:
    return plugins.run_engine(s.t("documents").select("doc_id"), "canned", plugins.CANNED).select("doc_id", "field_name", "raw_value", F.round("confidence", 2).alias("confidence"))


@query("q_ST_hourly_events", "select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n from events group by all")
def hourly_events(s: Source) -> DataFrame:
    """Engine addition: tumbling windows of the events, as a batch; the same code runs on a stream with a watermark."""
    e = s.t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_timestamp_ntz(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss")).alias("hour"), "event_type", "n")


# --- plug-ins ----------------------------------------------------------------------------------------------------------

LINES = "select doc_id, line_no, text, round(least(1.0, cast(length(text) as double) / 100), 6) as confidence from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents) where trim(text) <> ''"


def _engine(s: Source, name: str) -> DataFrame:
    rows = plugins.run_engine(s.t("documents").select("doc_id", "text"), name)
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text", F.round("confidence", 6).alias("confidence"))


@query("q_X01_engine_lines", LINES)
def engine_lines(s: Source) -> DataFrame:
    return _engine(s, "lines")


@query("q_ST09_retry_singly", LINES)
def retry_singly(s: Source) -> DataFrame:
    return _engine(s, "brittle")


@query("q_X04_embedded_texts", "select conv_id, turn, cast(384 as bigint) as dims, cast(case when trim(text) = '' then 0 else 1 end as double) as norm, cast(case when trim(text) = '' then 0 else 1 end as double) as twice, trim(text) <> '' and lower(text) <> text as folds from conversations")
def embedded_texts(s: Source) -> DataFrame:
    """Size and length of the vectors; a text and the same twice point the same way; case does not count."""
    from ..functions.vectors import dot

    text = F.col("text")
    e = s.t("conversations").select("conv_id", "turn", "text", udfs.hashed_embedding(text).alias("e"), udfs.hashed_embedding(F.concat(text, F.lit(" "), text)).alias("d"), udfs.hashed_embedding(F.lower(text)).alias("l"))
    return e.select("conv_id", "turn", F.size("e").cast("bigint").alias("dims"), F.round(F.sqrt(dot(F.col("e"), F.col("e"))), 6).alias("norm"), F.round(dot(F.col("e"), F.col("d")), 6).alias("twice"), ((F.round(dot(F.col("e"), F.col("l")), 6) == 1) & (F.lower(text) != text)).alias("folds"))


@query("q_X06_structured_extraction", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def structured_extraction(s: Source) -> DataFrame:
    from ..functions.jsons import read_strict

    return s.t("events").select("event_id", read_strict(F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```")), "k bigint").alias("p")).select("event_id", "p.k")


@query("q_X07_schema_registry", "select t as doc_type, cast(n as bigint) as n, cast(r as bigint) as required from (values ('Meldebescheinigung', 11, 9), ('Steuerbescheid', 8, 4), ('Gehaltsausweis', 11, 4), ('Personalausweis', 9, 7)) v(t, n, r)")
def schema_registry(s: Source) -> DataFrame:
    return catalog.field_catalog(s.spark).groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if("required").alias("required"))


@query("q_X09_line_table", "select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as line from documents")
def line_table(s: Source) -> DataFrame:
    rows = s.t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return rows.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


# --- the rest of the inventory -----------------------------------------------------------------------------------------


@query("q_P07_resolved", "select doc_id, field_name from ({v_status}) v where status in ('EXTRACTED', 'CORRECTED')")
def resolved(s: Source) -> DataFrame:
    return s.v("v_status").where(F.col("status").isin(*catalog.RESOLVED_STATUSES)).select("doc_id", "field_name")


@query("q_P24_image_examples", "select image_id, label_name, form_type, quality_score, substr(ocr_text, 1, 2000) as ocr_text from ({v_images}) v")
def image_examples(s: Source) -> DataFrame:
    return s.v("v_images").select("image_id", "label_name", "form_type", "quality_score", F.substring("ocr_text", 1, 2000).alias("ocr_text"))


@query("q_J10_truth_and_prediction", "select t.doc_id, t.field_name, t.value as truth, p.value as pred from ({v_truth}) t left join ({v_pred}) p on p.doc_id = t.doc_id and p.field_name = t.field_name where trim(t.value) <> ''")
def truth_and_prediction(s: Source) -> DataFrame:
    return s.v("v_truth").where(~T.blank(F.col("value"))).withColumnRenamed("value", "truth").join(s.v("v_pred").withColumnRenamed("value", "pred"), ["doc_id", "field_name"], "left")


@query("q_J22_field_patterns", "select doc_id, field_name, field_name in ('familienname', 'hausnummer', 'postleitzahl', 'steueridentifikationsnummer', 'strasse') as has_pattern from ({v_fields}) v")
def field_patterns(s: Source) -> DataFrame:
    known = s.spark.createDataFrame([(k,) for k in catalog.PATTERNS], "field_name string").withColumn("known", F.lit(True))
    return s.v("v_fields").join(F.broadcast(known), "field_name", "left").select("doc_id", "field_name", F.coalesce("known", F.lit(False)).alias("has_pattern"))  # 17 rows


@query("q_A10_mean", "select user_id, round(avg(value), 4) as mean from events group by user_id")
def mean(s: Source) -> DataFrame:
    return s.t("events").groupBy("user_id").agg(stats.mean4(F.col("value")).alias("mean"))


@query("q_A14_polygon_extent", "select doc_id, line_no, q - 3 as lo, q + 3 as hi from ({v_boxes}) v")
def polygon_extent(s: Source) -> DataFrame:
    xs = F.transform(F.array(F.array(F.col("q") + 3), F.array(F.col("q") - 3), F.array(F.col("q"))), lambda p: p[0])
    return s.v("v_boxes").select("doc_id", "line_no", F.array_min(xs).alias("lo"), F.array_max(xs).alias("hi"))


@query("q_A19_training_status", "select round(cast(count(*) filter (where ocr_text <> '') as double) / count(*), 3) as ocr, round(least(cast(count(*) as double) / 50000 * 100, 100), 3) as pct, cast(count(*) as bigint) as stored from ({v_images}) v")
def training_status(s: Source) -> DataFrame:
    c = stats.corpus_stats(s.v("v_images"))
    return c.select(F.round("ocr_coverage", 3).alias("ocr"), F.round(F.least(F.col("total") / 50_000 * 100, F.lit(100.0)), 3).alias("pct"), F.col("total").alias("stored"))


@query("q_W02_first_key_wins", "select doc_id, field_name, arg_min(value, line_no) as value from (select doc_id, line_no, lower(split_part(text, ' ', 1)) as field_name, text as value from ({v_form_lines}) v) group by all")
def first_key_wins(s: Source) -> DataFrame:
    rows = s.v("v_form_lines").select("doc_id", "line_no", F.lower(F.substring_index("text", " ", 1)).alias("field_name"), F.col("text").alias("value"))
    return rows.groupBy("doc_id", "field_name").agg(F.min_by("value", "line_no").alias("value"))


@query("q_W06_gaps", "select doc_id, line_no, coalesce(x1 - lag(x2) over (partition by doc_id order by x1, line_no, text, q, price) > 0.004, false) as spaced from ({v_boxes}) v")
def gaps(s: Source) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("x1", "line_no", "text", "q", "price")
    return s.v("v_boxes").select("doc_id", "line_no", F.coalesce(F.col("x1") - F.lag("x2").over(w) > catalog.SPACE_GAP, F.lit(False)).alias("spaced"))


@query("q_O06_first_lines", "select doc_id, list_slice(string_split(text, chr(10)), 1, 3) as head from documents")
def first_lines(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id", F.slice(F.split("text", "\n"), 1, 3).alias("head"))


@query("q_O12_top_sources", "select source as label, count(*) as n from documents group by source order by n desc, source limit 20")
def top_sources(s: Source) -> DataFrame:
    return stats.top_labels(s.t("documents"), 20, "source")


@query("q_U04_valid_and_existing", "select doc_id from documents intersect select doc_id from labels")
def valid_and_existing(s: Source) -> DataFrame:
    return s.t("documents").select("doc_id").intersect(s.t("labels").select("doc_id"))


@query("q_FS13_document_number", "select c_custkey, substr(upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')), 1, 9) as number from customer")
def document_number(s: Source) -> DataFrame:
    return s.t("customer").select("c_custkey", identifiers.document_number(F.col("c_name")).alias("number"))


@query("q_FS15_assessment_year", "select o_orderkey, cast(year(o_orderdate) as varchar) as y from orders")
def assessment_year(s: Source) -> DataFrame:
    return s.t("orders").select("o_orderkey", identifiers.assessment_year(F.concat(F.lit("Jahr "), F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("y"))


@query("q_FS16_postal_code", "select c_custkey, lpad(cast(c_custkey as varchar), 5, '0') as plz from customer")
def postal_code(s: Source) -> DataFrame:
    return s.t("customer").select("c_custkey", identifiers.postal_code(F.concat(F.lit("D-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit(" Ort 123456"))).alias("plz"))


@query("q_FS18_surnames", "select c_custkey, 'familienname' as field_name, c_mktsegment as value from customer")
def surnames(s: Source) -> DataFrame:
    rows = s.dealt("customer").select(F.col("c_custkey").alias("doc_id"), F.lit(catalog.ID_CARD).alias("doc_type"), F.lit(1).alias("line_no"), F.col("c_mktsegment").alias("text"), F.lit(0.9).alias("confidence"), F.lit(0.4).alias("x1"), F.lit(0.2).alias("y1"), F.lit(0.6).alias("x2"), F.lit(0.24).alias("y2"))
    return mapper.map_fields(rows).where("source = 'card-surname'").select(F.col("doc_id").alias("c_custkey"), "field_name", "value")


@query("q_FD04_age_bound", "select o_orderkey, date '2026-01-01' - cast(o_orderdate as date) > 11000 as old from orders")
def age_bound(s: Source) -> DataFrame:
    message = dates.birthdate_message(F.date_format("o_orderdate", "dd.MM.yyyy"), F.to_date(F.lit("2026-01-01")), 11_000)
    return s.t("orders").select("o_orderkey", message.isNotNull().alias("old"))


@query("q_FD06_heartbeat_age", "select event_id, cast(greatest(epoch(timestamp '2024-02-01 00:00:00') - epoch(date_trunc('second', ts)), 0) as bigint) as age from events")
def heartbeat_age(s: Source) -> DataFrame:
    now = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return s.t("events").select("event_id", F.greatest(now - F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(0)).cast("bigint").alias("age"))


@query("q_FD07_generated_dates", "select i as id, true as ok from range(0, 500) t(i)")
def generated_dates(s: Source) -> DataFrame:
    return s.spark.range(500).select("id", dates.parse_date(synth.date_text(F.col("id"), "d", 1950, 2004), F.to_date(F.lit("2026-01-01"))).isNotNull().alias("ok"))


@query("q_FM05_size_score", "select l_orderkey, l_linenumber, round(least(1.0, least(l_quantity * 20, l_extendedprice / 10) / 600), 6) as score from lineitem")
def size_score(s: Source) -> DataFrame:
    return s.t("lineitem").select("l_orderkey", "l_linenumber", F.round(quality.size_score(F.col("l_quantity") * 20, F.col("l_extendedprice") / 10), 6).alias("score"))


@query("q_FM07_sharpness", "select l_orderkey, l_linenumber, round(least(l_extendedprice / 800, 1.0) * case when l_quantity > 18 then greatest(0.4::double, 1 - (l_quantity - 18) / 60) else 1 end, 6) as score from lineitem")
def sharpness(s: Source) -> DataFrame:
    return s.t("lineitem").select("l_orderkey", "l_linenumber", F.round(quality.sharpness_score(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("score"))


@query("q_FM12_half_even", "select l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) as r from lineitem")
def half_even(s: Source) -> DataFrame:
    return s.t("lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).alias("r"))


@query("q_FA03_chunks", "select source, doc_id, cast((row_number() over (partition by source order by doc_id) - 1) // 64 as bigint) as chunk from documents")
def chunks(s: Source) -> DataFrame:
    return corpus.number_in_order(s.t("documents").select("source", "doc_id"), ["doc_id"], "n", "source").select("source", "doc_id", F.expr("(n - 1) div 64").alias("chunk"))


@query("q_FA04_sorted_sets", "select lang, list_sort(list(distinct source)) as sources from documents group by lang")
def sorted_sets(s: Source) -> DataFrame:
    return s.t("documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("q_FJ06_default_get", "select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), 0) as k, 'none' as missing from events")
def default_get(s: Source) -> DataFrame:
    m = F.from_json("props", "map<string, bigint>")
    return s.t("events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")), F.lit(0)).cast("bigint").alias("k"), F.coalesce(F.try_element_at(m, F.lit("zz")).cast("string"), F.lit("none")).alias("missing"))


@query("q_G06_overlap_with_page_half", "select doc_id, line_no, round(greatest(0.0, least(x2, 0.5::double) - greatest(x1, 0.0)) * greatest(0.0, least(y2, 1.0) - greatest(y1, 0.0)), 9) as overlap from ({v_boxes}) v")
def overlap_with_page_half(s: Source) -> DataFrame:
    half = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(1.0))
    b = geometry.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return s.v("v_boxes").select("doc_id", "line_no", F.round(geometry.intersection(b, half), 9).alias("overlap"))


@query("q_G09_right_candidates", "select a.doc_id, a.line_no as a_line, b.line_no as b_line from ({v_boxes}) a join ({v_boxes}) b on a.doc_id = b.doc_id where a.is_label and not b.is_label and abs((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2) <= 0.02 and b.x1 >= a.x1 and b.x1 - a.x2 >= -0.02")
def right_candidates(s: Source) -> DataFrame:
    v = s.v("v_boxes")
    box = lambda: geometry.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    a, b = v.where("is_label").select("doc_id", F.col("line_no").alias("a_line"), box().alias("a")), v.where("not is_label").select("doc_id", F.col("line_no").alias("b_line"), box().alias("b"))
    near = F.abs(geometry.centre_y(F.col("b")) - geometry.centre_y(F.col("a"))) <= catalog.SAME_ROW
    return a.join(b, "doc_id").where(near & (F.col("b.x1") >= F.col("a.x1")) & (F.col("b.x1") - F.col("a.x2") >= catalog.RIGHT_SLACK)).select("doc_id", "a_line", "b_line")


AMOUNT_RULES = "select doc_id, case when doc_id % 3 = 0 then 'zu_versteuerndes_einkommen' else 'brutto_lohn' end as field_name, cast(doc_id * 20000 - 1000000 as double) as amount from ({v_person}) p"


@query("q_V07_amount_rules", f"with a as ({AMOUNT_RULES}) select doc_id, field_name, case when field_name = 'brutto_lohn' then case when amount <= 0 then 'brutto_lohn muss groesser als 0 sein.' when amount > 10000000 then 'brutto_lohn unplausibel hoch.' end when amount < 0 then field_name || ' darf nicht negativ sein.' end as message from a")
def amount_rules(s: Source) -> DataFrame:
    amount = (F.col("doc_id") * 20_000 - 1_000_000).cast("double")
    field = F.when(F.col("doc_id") % 3 == 0, "zu_versteuerndes_einkommen").otherwise("brutto_lohn")
    return s.v("v_person").select("doc_id", field.alias("field_name"), validate.rule_message(field, amount.cast("string"), amount, F.to_date(F.lit("2026-01-01"))).alias("message"))


@query("q_D03_generated_identifiers", "select i as id, true as plz, true as number, true as amount from range(0, 500) t(i)")
def generated_identifiers(s: Source) -> DataFrame:
    i = F.col("id")
    plz = synth.postal_code(i)
    return s.spark.range(500).select("id", (identifiers.postal_code_valid(plz) & ~plz.startswith("00")).alias("plz"), synth.document_number(i).rlike("^[A-Z0-9]{9}$").alias("number"), amounts.parse_amount(synth.amount_text(i, "a", 100, 900)).between(100, 900).alias("amount"))


@query("q_D08_hash_distance", "select vec_id, cast(0 as int) as distance from embeddings")
def hash_distance(s: Source) -> DataFrame:
    grey = F.transform(F.concat("embedding", "embedding"), lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x * 200 + 128).cast("int"))).cast("bigint")), 2, "0"))
    raw = F.unhex(F.array_join(grey, ""))
    return s.t("embeddings").select("vec_id", udfs.difference_hash(raw, F.lit(16), F.lit(8)).alias("h")).select("vec_id", udfs.hamming(F.col("h"), F.col("h")).cast("int").alias("distance"))


@query("q_D09_valid_files", "select doc_id, sha256(text) as image_id from documents where n_chars > 0")
def valid_files(s: Source) -> DataFrame:
    return s.t("documents").where(F.length("text") > 0).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("image_id"))
