"""Form-shaped views over the star schema.

Each view is one SQL text that Spark and the oracle engine both read: ``{table}`` stands for a table there. Only casts, ``||``,
``lpad``, ``%`` and ``case`` occur, so that both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_K = "c_custkey"

VIEWS: dict[str, str] = {
    # One row a customer: the values that forms are filled with; every rule has rows that pass and rows that fail.
    "v_person": f"""
        select {_K} as doc_id,
            case when {_K} % 4 = 0 then c_name else c_mktsegment end as familienname,
            lpad(cast({_K} * 37 % 100000 as string), case when {_K} % 7 = 0 then 4 else 5 end, '0') as postleitzahl,
            lpad(cast({_K} % 33 as string), 2, '0') || '.' || lpad(cast({_K} % 14 as string), 2, '0') || '.' || cast(1860 + {_K} * 7 % 200 as string) as geburtsdatum,
            case when {_K} % 5 = 0 then '86095742719' when {_K} % 5 = 1 then '86 095 742 719' when {_K} % 5 = 2 then '06095742719' else lpad(cast({_K} * 7919 + 10000000000 as string), 11, '0') end as steuer_id,
            case when {_K} % 4 = 0 then 'DE89370400440532013000' when {_K} % 4 = 1 then 'DE89 3704 0044 0532 0130 00' when {_K} % 4 = 2 then 'AT611904300234573201' else 'DE' || lpad(cast({_K} as string), 20, '3') end as iban,
            case when {_K} % 6 = 0 then 'Hauptstr...' when {_K} % 6 = 1 then cast({_K} as string) when {_K} % 6 = 2 then 'Weg ' || cast({_K} as string) when {_K} % 6 = 3 then 'x' when {_K} % 6 = 4 then 'Strasse des 17. Juni' else 'Platz #' || cast({_K} as string) end as strasse,
            case when {_K} % 3 = 0 then cast({_K} % 9000 as string) || '.' || lpad(cast({_K} % 1000 as string), 3, '0') || ',' || lpad(cast({_K} % 100 as string), 2, '0') || ' EUR'
                when {_K} % 3 = 1 then cast({_K} % 9000 + 1 as string) || ',50' else cast({_K} % 900 + 1 as string) || '.' || lpad(cast({_K} % 1000 as string), 3, '0') end as brutto,
            cast({_K} * 11 % 9000 + 1 as string) || ',25' as netto,
            cast({_K} % 100 as double) / 100 as confidence
        from {{customer}}""",
    "v_form_lines": """
        select p.doc_id, l.line_no, case l.line_no
                when 1 then 'Familienname: ' || familienname when 2 then case when p.doc_id % 2 = 0 then 'PLZ = ' else 'Postleitzahl: ' end || postleitzahl
                when 3 then 'geboren am: ' || geburtsdatum when 4 then 'Steuer-ID: ' || steuer_id when 5 then 'Strasse | ' || strasse
                when 6 then 'Brutto: ' || brutto when 7 then 'Netto: ' || netto when 8 then 'Hausnr: ' || cast(p.doc_id % 200 as string) || 'a'
                when 9 then 'Seite 1 von 2' else 'Wohnort:' end as text,
            cast((p.doc_id + l.line_no * 7) % 100 as double) / 100 as confidence
        from ({v_person}) p cross join (select 1 as line_no union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9 union all select 10) l""",
    # Field rows as they come from a mapper: (doc_id, field_name, value, confidence).
    "v_fields": """
        select p.doc_id, f.field_name, case f.field_name when 'familienname' then familienname when 'postleitzahl' then postleitzahl when 'geburtsdatum' then geburtsdatum
                when 'steueridentifikationsnummer' then steuer_id when 'strasse' then strasse when 'brutto_lohn' then cast(p.doc_id * 13 % 9000 as string) when 'netto_lohn' then cast(p.doc_id * 11 % 9000 as string)
                when 'hausnummer' then case when p.doc_id % 9 = 0 then null else cast(p.doc_id % 300 as string) || case when p.doc_id % 2 = 0 then 'b' else '-2' end end end as value,
            cast((p.doc_id * 3) % 101 as double) / 100 as confidence
        from ({v_person}) p cross join (select 'familienname' as field_name union all select 'postleitzahl' union all select 'geburtsdatum' union all select 'steueridentifikationsnummer' union all select 'strasse' union all select 'brutto_lohn' union all select 'netto_lohn' union all select 'hausnummer') f""",
    "v_status": """
        select doc_id, field_name, value, confidence, case (doc_id * 7 + length(field_name)) % 5 when 0 then 'EXTRACTED' when 1 then 'UNRESOLVED' when 2 then 'VALIDATION_FAILURE' when 3 then 'CORRECTED' else 'EXTRACTED' end as status
        from ({v_fields}) f""",
    "v_boxes": """
        select l_orderkey as doc_id, l_linenumber as line_no, cast(l_partkey % 20 as double) / 25 as x1, cast(l_linenumber * 4 + l_suppkey % 3 as double) / 100 as y1,
            cast(l_partkey % 20 as double) / 25 + cast(l_suppkey % 9 + 1 as double) / 50 as x2, cast(l_linenumber * 4 + l_suppkey % 3 + 2 + l_partkey % 2 as double) / 100 as y2,
            l_linenumber % 2 = 1 as is_label, l_returnflag || l_linestatus || cast(l_linenumber as string) as text, cast(l_partkey % 100 as double) / 100 as confidence, l_quantity as q, l_extendedprice as price
        from {lineitem}""",
    # Widely spaced rows, in which fragments can be merged by islands and greedily alike.
    "v_fragments": """
        select l_orderkey as doc_id, l_linenumber as line_no, cast(l_linenumber % 4 * 20 + case when l_suppkey % 3 = 0 then 1 else 0 end as double) / 100 as x1, cast(l_linenumber - l_linenumber % 4 as double) / 40 as y1,
            cast(l_linenumber % 4 * 20 + 20 as double) / 100 as x2, cast(l_linenumber - l_linenumber % 4 as double) / 40 + cast(0.02 as double) as y2, l_returnflag || cast(l_linenumber as string) as text, cast(l_partkey % 100 as double) / 100 as confidence
        from {lineitem}""",
    "v_map_a": """
        select c_custkey as doc_id, 'f' || cast(f.i as string) as field_name from {customer} cross join (select 1 as i union all select 2 union all select 3 union all select 4) f where (c_custkey + f.i) % 3 <> 0""",
    "v_map_b": """
        select c_custkey as doc_id, 'f' || cast(f.i as string) as field_name, cast((c_custkey * f.i) % 10 as double) / 10 as confidence, case when c_custkey % 4 = 0 then 'null' when c_custkey % 4 = 1 then '' else c_mktsegment end as raw_value
        from {customer} cross join (select 1 as i union all select 2 union all select 3 union all select 4 union all select 5) f where (c_custkey + f.i) % 4 <> 0""",
    "v_truth": """
        select o_orderkey as doc_id, f.field_name, case f.field_name when 'brutto_lohn' then cast(o_custkey as string) || ',50' when 'ort' then o_orderpriority else case when o_orderkey % 10 = 0 then ' ' else 'Status ' || o_orderstatus || ' ' || o_orderpriority end end as value
        from {orders} cross join (select 'brutto_lohn' as field_name union all select 'ort' union all select 'status' union all select '_note') f""",
    "v_pred": """
        select o_orderkey as doc_id, f.field_name, case f.field_name when 'brutto_lohn' then case when o_orderkey % 3 = 0 then cast(o_custkey as string) || '.50' else cast(o_custkey as string) || ',50 EUR' end
                when 'ort' then case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then lower(o_orderpriority) else replace(o_orderpriority, 'E', 'F') end when 'extra' then o_orderstatus
                else replace('Status ' || o_orderstatus || ' ' || o_orderpriority, '-', case when o_orderkey % 2 = 0 then '- ' else '-' end) end as value
        from {orders} cross join (select 'brutto_lohn' as field_name union all select 'ort' union all select 'status' union all select 'extra' union all select '_line_0001') f where o_orderkey % 7 <> 0 or f.field_name <> 'status'""",
    "v_audit": """
        select 'x' || lpad(cast(event_id as string), 9, '0') as extraction_id, cast(ts as string) as timestamp, event_type as document_type, case when event_id % 3 = 0 then 'engine-a' else 'engine-b' end as vlm_model, case when event_id % 4 = 0 then '' else 'rules' end as llm_model,
            cast(event_id % 100 as double) / 100 as overall_confidence, event_id % 5 as unresolved_count, event_id % 3 as corrected_count, event_id % 2 as failed_count,
            case when event_id % 10 = 0 then null else value end as processing_time_ms, user_id
        from {events}""",
    "v_corr": """
        select 'c' || cast(c_custkey as string) as id, case when c_custkey % 3 = 0 then 'postleitzahl' when c_custkey % 3 = 1 then 'familienname' else '' end as field, case when c_custkey % 2 = 0 then 'Meldebescheinigung' else 'Personalausweis' end as doc_type,
            c_mktsegment as original, lower(c_mktsegment) as corrected, case when c_custkey % 5 = 0 then '' else 'segment ' || cast(c_nationkey as string) end as reason, c_custkey as k, c_nationkey as nation
        from {customer}""",
    "v_images": """
        select 'i' || cast(d.doc_id as string) as image_id, d.source as label_name, d.lang as form_type, cast(d.doc_id % 100 as double) / 100 as quality_score, case when d.doc_id % 11 = 0 then '' else d.text end as ocr_text, case when d.doc_id % 3 = 0 then '' else 'h' end as visual_hash
        from {documents} d""",
}


def expand(sql: str, table) -> str:
    """The text with views put in and ``{table}`` replaced by ``table(name)``."""
    out = sql
    while any("{" + v + "}" in out for v in VIEWS):
        for v, q in VIEWS.items():
            out = out.replace("{" + v + "}", q)
    for t in TABLES:
        out = out.replace("{" + t + "}", table(t))
    return out


SPREAD = {"customer": "c_custkey", "orders": "o_orderkey"}  # small files whose rows become many: dealt to tasks before that
ROWS_PER_TASK = 65_536  # about as many rows of such a table go to one task, so that what a task sorts doesn't grow with the table


def tasks(spark: SparkSession, rows: int = 0) -> int:
    """How many tasks a table of so many rows in few files is dealt to: a task may take longer than others without holding up a core."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def tasks_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """:func:`tasks` for a table of a folder; its rows are counted from the files' footers."""
    return tasks(spark, table(spark, sf_dir, name).count())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a folder. A row group is read by one task, however many rows the view makes of it: see SPREAD."""

    def source(t: str) -> str:
        file = f"parquet.`{sf_dir}/{t}.parquet`"
        return f"(select /*+ REPARTITION({tasks_of(spark, sf_dir, t)}, {SPREAD[t]}) */ * from {file})" if t in SPREAD and "{" + t + "}" in opened else file

    opened = expand("{" + name + "}", lambda t: "{" + t + "}")  # the tables that the view reads
    return spark.sql(expand("select * from ({" + name + "}) v", source))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """Oracle SQL with the views that it names put in."""
    return expand(sql, lambda t: t)
