"""Queries over values: identifiers, dates, amounts, rules, boxes, page quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, dates, geometry, identifiers, udfs
from ..operators import mapper, quality, validate
from ..operators.lines import downgrade
from .queries import Source, query

AS_OF = "2026-01-01"

# Oracle pieces over a column.
TAX_OK = """(regexp_matches(regexp_replace({0}, '[ /-]', '', 'g'), '^[1-9][0-9]{{10}}$') and
    len(list_filter(list_transform(range(0, 10), lambda k: length(substr(regexp_replace({0}, '[ /-]', '', 'g'), 1, 10)) - length(replace(substr(regexp_replace({0}, '[ /-]', '', 'g'), 1, 10), cast(k as varchar), ''))), lambda c: c > 1)) = 1 and
    list_max(list_transform(range(0, 10), lambda k: length(substr(regexp_replace({0}, '[ /-]', '', 'g'), 1, 10)) - length(replace(substr(regexp_replace({0}, '[ /-]', '', 'g'), 1, 10), cast(k as varchar), '')))) in (2, 3) and
    (11 - list_reduce(list_concat([10], list_transform(range(1, 11), lambda i: try_cast(substr(regexp_replace({0}, '[ /-]', '', 'g'), i, 1) as int))), lambda p, d: (case when (p + d) % 10 = 0 then 10 else (p + d) % 10 end) * 2 % 11)) % 10 = try_cast(substr(regexp_replace({0}, '[ /-]', '', 'g'), 11, 1) as int))"""
DATE = "regexp_matches(trim({0}), '^(0[1-9]|[12][0-9]|3[01])\\.(0[1-9]|1[0-2])\\.(19|20)[0-9]{{2}}$')"
PARSED = "case when " + DATE + " then try_cast(substr(trim({0}), 7, 4) || '-' || substr(trim({0}), 4, 2) || '-' || substr(trim({0}), 1, 2) as date) end"
AMOUNT = "nullif(regexp_extract({0}, '([0-9]{{1,3}}(?:\\.[0-9]{{3}})+(?:,[0-9]{{2}})?|[0-9]+(?:,[0-9]{{2}})?)', 1), '')"
PARSE = "try_cast(case when contains(" + AMOUNT + ", ',') then replace(replace(" + AMOUNT + ", '.', ''), ',', '.') when regexp_matches(" + AMOUNT + ", '\\.[0-9]{{3}}$') then replace(" + AMOUNT + ", '.', '') else " + AMOUNT + " end as double)"
STREET = "(length(trim({0})) between 2 and 100 and not (trim({0}) like '%…' or trim({0}) like '%..') and regexp_matches(trim({0}), '^[A-Za-zÄÖÜäöüß0-9\\s./-]+$') and regexp_matches(trim({0}), '[A-Za-zÄÖÜäöüß]'))"


@query("q_V02_tax_id_valid", f"select doc_id, steuer_id, coalesce({TAX_OK.format('steuer_id')}, false) as ok from " + "({v_person}) v")
def tax_id_valid(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", "steuer_id", identifiers.tax_id_valid(F.col("steuer_id")).alias("ok"))


@query("q_A15_digit_counts", "select doc_id, len(list_distinct(string_split(regexp_replace(steuer_id, '[^0-9]', '', 'g'), ''))) as distinct_digits from ({v_person}) v")
def digit_counts(s: Source) -> DataFrame:
    digits = F.array_distinct(F.filter(F.split(F.regexp_replace("steuer_id", "[^0-9]", ""), ""), lambda d: d != ""))
    return s.v("v_person").select("doc_id", F.size(digits).cast("bigint").alias("distinct_digits"))


@query("q_V03_iban_valid", """with t as (select doc_id, upper(regexp_replace(iban, '[ -]', '', 'g')) as t from ({v_person}) v),
    m as (select doc_id, t, list_reduce(list_concat([cast(0 as bigint)], list_transform(range(1, length(t) + 1), lambda i: cast(ascii(substr(substr(t, 5) || substr(t, 1, 4), i, 1)) as bigint))), lambda r, c: case when c >= 65 then (r * 100 + c - 55) % 97 else (r * 10 + c - 48) % 97 end) as rem from t)
    select doc_id, regexp_matches(t, '^[A-Z]{2}[0-9]{2}[A-Z0-9]+$') and length(t) = case substr(t, 1, 2) when 'DE' then 22 when 'AT' then 20 else length(t) end and rem = 1 as ok from m""")
def iban_valid(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", identifiers.iban_valid(F.col("iban")).alias("ok"))


@query("q_V04_plz_valid", "select doc_id, regexp_matches(regexp_replace(postleitzahl, '[ -]', '', 'g'), '^[0-9]{5}$') as ok from ({v_person}) v")
def plz_valid(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", identifiers.postal_code_valid(F.col("postleitzahl")).alias("ok"))


@query("q_V05_street_valid", f"select doc_id, {STREET.format('strasse')} as ok from " + "({v_person}) v")
def street_valid(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", identifiers.street_valid(F.col("strasse")).alias("ok"))


FIELDS = """with f as (select doc_id, field_name, value, confidence, case field_name when 'familienname' then regexp_matches(value, '^[A-Za-zÄÖÜäöüß\\s''-]{2,100}$') when 'postleitzahl' then regexp_matches(value, '^[0-9]{5}$')
        when 'steueridentifikationsnummer' then regexp_matches(value, '^[0-9]{11}$') when 'strasse' then regexp_matches(value, '^[A-Za-zÄÖÜäöüß0-9\\s./-]{2,100}$') when 'hausnummer' then regexp_matches(value, '^[0-9]{1,4}[a-zA-Z]?$') else true end as shape,
        """ + PARSED.format("value") + " as d, coalesce(" + TAX_OK.format("value") + ", false) as tax, coalesce(" + STREET.format("value") + """, false) as street from ({v_fields}) v),
    m as (select *, case when value is null then 'Feld konnte nicht extrahiert werden.' when not shape then 'Wert ''' || value || ''' entspricht nicht dem erwarteten Format fuer ''' || field_name || '''.'
        when field_name = 'geburtsdatum' and (d is null or d > date '2026-01-01') then 'Ungueltiges Geburtsdatum (nicht parsierbar).' when field_name = 'geburtsdatum' and date '2026-01-01' - d > 54750 then 'Geburtsdatum unplausibel (aelter als 150 Jahre).'
        when field_name = 'steueridentifikationsnummer' and not tax then 'Steuer-ID hat ungueltige Pruefsumme.' when field_name = 'strasse' and not street then 'Strassenname ist ungueltig oder unvollstaendig.'
        when field_name in ('brutto_lohn', 'netto_lohn') and cast(value as double) <= 0 then field_name || ' muss groesser als 0 sein.' end as message from f)"""


@query("q_V01_regex_valid", FIELDS + " select doc_id, field_name, shape as ok from f where value is not null")
def regex_valid(s: Source) -> DataFrame:
    return s.v("v_fields").where("value is not null").select("doc_id", "field_name", validate.matches_pattern(F.col("field_name"), F.col("value")).alias("ok"))


@query("q_V10_validated_fields", FIELDS + " select doc_id, field_name, value, message as validation_message, case when value is null then 'UNRESOLVED' when message is not null then 'VALIDATION_FAILURE' else 'EXTRACTED' end as status from m")
def validated_fields(s: Source) -> DataFrame:
    return validate.validate_fields(s.v("v_fields"), AS_OF).select("doc_id", "field_name", "value", "validation_message", "status")


def _rules(s: Source, *names: str) -> DataFrame:
    return validate.validate_fields(s.v("v_fields").where(F.col("field_name").isin(*names)), AS_OF)


@query("q_V06_birth_dates", FIELDS + " select doc_id, value, message as validation_message from m where field_name = 'geburtsdatum'")
def birth_dates(s: Source) -> DataFrame:
    return _rules(s, "geburtsdatum").select("doc_id", "value", "validation_message")


@query("q_V08_salary_bounds", "select doc_id, name as field_name, case when v <= 0 then name || ' muss groesser als 0 sein.' when v > 10000000 then name || ' unplausibel hoch.' end as validation_message from (select o_orderkey as doc_id, case when o_orderkey % 2 = 0 then 'brutto_lohn' else 'netto_lohn' end as name, (o_custkey - 100) * 20000 as v from orders)")
def salary_bounds(s: Source) -> DataFrame:
    rows = s.t("orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "brutto_lohn").otherwise("netto_lohn").alias("field_name"), ((F.col("o_custkey") - 100) * 20_000).cast("string").alias("value"))
    return validate.validate_fields(rows, AS_OF).select("doc_id", "field_name", "validation_message")


@query("q_V09_net_against_gross", "select doc_id, case when net > gross then 'VALIDATION_FAILURE' else 'EXTRACTED' end as status from (select doc_id, cast(doc_id * 13 % 9000 as double) as gross, cast(doc_id * 11 % 9000 as double) as net from ({v_person}) v) where gross > 0 and net > 0")
def net_against_gross(s: Source) -> DataFrame:
    rows = validate.check_net_against_gross(_rules(s, "brutto_lohn", "netto_lohn").where("validation_message is null"))
    both = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("field_name") == "netto_lohn", F.col("status"))).alias("status"))
    return both.where("n = 2").select("doc_id", "status")


@query("q_X05_guarded_structuring", """select f.doc_id, f.field_name, case when taken then m else f.value end as value, case when taken then cast(0.6 as double) else f.confidence end as confidence, coalesce(taken, false) as from_model from (
    select v.*, 'Weg 1' as m, field_name = 'strasse' and doc_id % 3 <> 0 and (value is null or confidence < 0.7) and 0.6 > confidence as taken from ({v_fields}) v) f""")
def guarded_structuring(s: Source) -> DataFrame:
    """A model is asked for the fields that are missing or unsure, and only if it is enabled; else the fields stay as they are."""
    m = s.v("v_person").select("doc_id", F.lit("strasse").alias("field_name"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("Weg 1").alias("value"), F.lit(0.6).alias("confidence"))
    off = validate.structure_missing(s.v("v_fields"), m, enabled=False)
    return validate.structure_missing(off.drop("from_model"), m, enabled=True).select("doc_id", "field_name", "value", "confidence", "from_model")


@query("q_J16_salary_cross_field", FIELDS + """, g as (select *, max(case when field_name = 'brutto_lohn' then cast(value as double) end) over (partition by doc_id) as gross from m where field_name in ('brutto_lohn', 'netto_lohn'))
    select doc_id, field_name, value, case when message is not null or (field_name = 'netto_lohn' and cast(value as double) > gross) then 'VALIDATION_FAILURE' else 'EXTRACTED' end as status from g""")
def salary_cross_field(s: Source) -> DataFrame:
    rows = validate.validate_fields(s.v("v_fields").where("field_name in ('brutto_lohn', 'netto_lohn')"), AS_OF)
    return validate.check_net_against_gross(rows).select("doc_id", "field_name", "value", "status")


@query("q_J17_city_of_postal_code", "select doc_id, field_name, value from ({v_fields}) v")
def city_of_postal_code(s: Source) -> DataFrame:
    return validate.check_city_of_postal_code(s.v("v_fields")).select("doc_id", "field_name", "value")


@query("q_V11_missing_fields", """select doc_id, n.f as field_name from (select distinct doc_id from ({v_fields}) v) cross join (select unnest(['familienname', 'vorname', 'geburtsdatum', 'geburtsort', 'staatsangehoerigkeit', 'strasse', 'hausnummer', 'postleitzahl', 'wohnort']) as f) n
    where not exists (select 1 from ({v_fields}) w where w.doc_id = v.doc_id and w.field_name = n.f and w.value is not null)""".replace("from ({v_fields}) v)", "from ({v_fields}) x) v"))
def missing_fields(s: Source) -> DataFrame:
    return validate.missing_fields(s.v("v_fields").withColumn("doc_type", F.lit("Meldebescheinigung"))).select("doc_id", "field_name")


@query("q_FD01_date_shape", f"select doc_id, {DATE.format('geburtsdatum')} as ok from " + "({v_person}) v")
def date_shape(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", dates.has_date_shape(F.col("geburtsdatum")).alias("ok"))


@query("q_FD02_date_parse", f"select doc_id, case when {PARSED.format('geburtsdatum')} <= date '2026-01-01' then {PARSED.format('geburtsdatum')} end as past, {PARSED.format('geburtsdatum')} as any_date from " + "({v_person}) v")
def date_parse(s: Source) -> DataFrame:
    day = F.to_date(F.lit(AS_OF))
    return s.v("v_person").select("doc_id", dates.parse_date(F.col("geburtsdatum"), day).alias("past"), dates.parse_date(F.col("geburtsdatum"), day, True).alias("any_date"))


@query("q_FD02_order_dates", "select o_orderkey, cast(o_orderdate as date) as parsed from orders")
def order_dates(s: Source) -> DataFrame:
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    return s.t("orders").select("o_orderkey", dates.parse_date(text, F.to_date(F.lit(AS_OF))).alias("parsed"))


@query("q_FD03_find_date", "select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') as found from orders")
def find_date(s: Source) -> DataFrame:
    noisy = F.concat(F.lit("am "), F.date_format("o_orderdate", "dd.MM"), F.lit(". ."), F.date_format("o_orderdate", "yyyy"), F.lit(" !"))
    noisy = F.regexp_replace(noisy, "^am", "-")
    return s.t("orders").select("o_orderkey", dates.find_date(noisy).alias("found"))


@query("q_FD05_date_rules", f"""with p as (select doc_id, {PARSED.format('geburtsdatum')} as d from """ + """({v_person}) v)
    select doc_id, case when d is null or d > date '2026-01-01' then 'Ungueltiges Geburtsdatum (nicht parsierbar).' when date '2026-01-01' - d > 54750 then 'Geburtsdatum unplausibel (aelter als 150 Jahre).' end as birth,
        case when d is null then 'Ungueltiges Ablaufdatum (nicht parsierbar).' when d < date '2026-01-01' then 'Dokument ist abgelaufen.' end as expiry, case when d is null or d > date '2026-01-01' then 'Ungueltiges Einzugsdatum.' end as move_in from p""")
def date_rules(s: Source) -> DataFrame:
    day, v = F.to_date(F.lit(AS_OF)), F.col("geburtsdatum")
    return s.v("v_person").select("doc_id", dates.birthdate_message(v, day).alias("birth"), dates.expiry_message(v, day).alias("expiry"), dates.move_in_message(v, day).alias("move_in"))


@query("q_FM01_amount_parse", f"select doc_id, {PARSE.format('brutto')} as gross, {PARSE.format('netto')} as net from " + "({v_person}) v")
def amount_parse(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", amounts.parse_amount(F.col("brutto")).alias("gross"), amounts.parse_amount(F.col("netto")).alias("net"))


@query("q_FM01_amount_roundtrip", "select o_orderkey, round(o_totalprice, 2) as amount from orders")
def amount_roundtrip(s: Source) -> DataFrame:
    return s.t("orders").select("o_orderkey", amounts.parse_amount(amounts.german_amount(F.round("o_totalprice", 2))).alias("amount"))


@query("q_FM02_whole_amount", """with t as (select doc_id, field_name, trim(regexp_replace(value, '€|EUR', '', 'g')) as t from ({v_pred}) v)
    select doc_id, field_name, case when regexp_matches(t, '^[0-9.,]+$') then try_cast(case when contains(t, ',') then replace(replace(t, '.', ''), ',', '.') when regexp_matches(t, '\\.[0-9]{3}$') then replace(t, '.', '') else t end as double) end as amount from t""")
def whole_amount(s: Source) -> DataFrame:
    return s.v("v_pred").select("doc_id", "field_name", amounts.parse_whole(F.col("value")).alias("amount"))


@query("q_FM03_close", "select o_orderkey, abs(o_totalprice - round(o_totalprice, 1)) < 0.005 as same from orders")
def close(s: Source) -> DataFrame:
    return s.t("orders").select("o_orderkey", amounts.close(F.col("o_totalprice"), F.round("o_totalprice", 1)).alias("same"))


@query("q_FS12_identifier_texts", """select doc_id, case when length(regexp_replace(steuer_id, '[^0-9]', '', 'g')) = 11 then regexp_replace(steuer_id, '[^0-9]', '', 'g') else steuer_id end as tax_id, substr(upper(regexp_replace(iban, '[^A-Za-z0-9]', '', 'g')), 1, 9) as doc_number,
    coalesce(nullif(regexp_extract(geburtsdatum, '((19|20)[0-9]{2})', 1), ''), geburtsdatum) as year, nullif(regexp_extract(postleitzahl, '\\b([0-9]{5})\\b', 1), '') as plz from ({v_person}) v""")
def identifier_texts(s: Source) -> DataFrame:
    return s.v("v_person").select("doc_id", identifiers.tax_id_text(F.col("steuer_id")).alias("tax_id"), identifiers.document_number(F.col("iban")).alias("doc_number"), identifiers.assessment_year(F.col("geburtsdatum")).alias("year"), identifiers.postal_code(F.col("postleitzahl")).alias("plz"))


@query("q_FS14_tax_class", "select l_orderkey, l_linenumber, case l_linenumber when 1 then 'I' when 2 then 'II' when 3 then 'III' when 4 then 'IV' when 5 then 'V' when 6 then 'VI' end as tax_class from lineitem")
def tax_class(s: Source) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in ("Klasse i", "StKl II ", "iii/1", "Klasse: IV.", "v", "(VI)", "XIV")])
    return s.t("lineitem").select("l_orderkey", "l_linenumber", identifiers.tax_class(F.element_at(texts, F.col("l_linenumber"))).alias("tax_class"))


@query("q_P15_nullish", "select doc_id, field_name, case when raw_value not in ('', 'null', 'None') then raw_value end as value from ({v_map_b}) v")
def nullish(s: Source) -> DataFrame:
    return s.v("v_map_b").select("doc_id", "field_name", validate.null_if_nullish(F.col("raw_value")).alias("value"))


@query("q_P14_model_overlay", """select f.doc_id, f.field_name, case when f.confidence < 0.55 and m.value is not null then m.value else f.value end as value, case when f.confidence < 0.55 and m.value is not null then cast(0.55 as double) else f.confidence end as confidence
    from ({v_fields}) f left join (select doc_id, 'strasse' as field_name, case when doc_id % 3 = 0 then null else 'Weg 1' end as value from ({v_person}) p) m on m.doc_id = f.doc_id and m.field_name = f.field_name""")
def model_overlay(s: Source) -> DataFrame:
    m = s.v("v_person").select("doc_id", F.lit("strasse").alias("field_name"), F.when(F.col("doc_id") % 3 == 0, "null").otherwise("Weg 1").alias("value"))
    return validate.overlay_model_values(s.v("v_fields"), m)


@query("q_P13_model_gaps", "select doc_id, field_name from ({v_fields}) v where value is null or confidence < 0.7")
def model_gaps(s: Source) -> DataFrame:
    return s.v("v_fields").where("value is null or confidence < 0.7").select("doc_id", "field_name")


@query("q_P08_status_downgrade", "select doc_id, field_name, case when doc_id % 11 = 0 then 'CORRECTED' when status = 'EXTRACTED' and confidence < 0.7 then 'LOW_CONFIDENCE' else status end as status from ({v_status}) v")
def status_downgrade(s: Source) -> DataFrame:
    return s.v("v_status").select("doc_id", "field_name", downgrade(F.col("status"), F.col("confidence"), F.col("doc_id") % 11 == 0).alias("status"))


@query("q_P05_canonical_only", "select doc_id, field_name from ({v_pred}) v where not starts_with(field_name, '_line_')")
def canonical_only(s: Source) -> DataFrame:
    return s.v("v_pred").where(~F.startswith("field_name", F.lit("_line_"))).select("doc_id", "field_name")


@query("q_P06_needs_review", "select doc_id, field_name, status, status in ('EXTRACTED', 'CORRECTED') as resolved from ({v_status}) v where status in ('UNRESOLVED', 'VALIDATION_FAILURE', 'LOW_CONFIDENCE', 'CORRECTED')")
def needs_review(s: Source) -> DataFrame:
    from ..catalog import RESOLVED_STATUSES, REVIEW_STATUSES

    return s.v("v_status").where(F.col("status").isin(*REVIEW_STATUSES, "CORRECTED")).select("doc_id", "field_name", "status", F.col("status").isin(*RESOLVED_STATUSES).alias("resolved"))


@query("q_P20_status_badges", """select status, case status when 'EXTRACTED' then 'Extracted' when 'UNRESOLVED' then 'Unresolved' when 'VALIDATION_FAILURE' then 'Validation Fail' else 'Corrected' end as label, case status when 'EXTRACTED' then 'green' when 'CORRECTED' then 'blue' else 'red' end as tone, count(*) as n from ({v_status}) v group by status""")
def status_badges(s: Source) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in (("EXTRACTED", "Extracted"), ("LOW_CONFIDENCE", "Low Confidence"), ("UNRESOLVED", "Unresolved"), ("VALIDATION_FAILURE", "Validation Fail"), ("CORRECTED", "Corrected")) for x in kv])
    tone = F.when(F.col("status") == "EXTRACTED", "green").when(F.col("status") == "CORRECTED", "blue").when(F.col("status").isin("UNRESOLVED", "VALIDATION_FAILURE"), "red").otherwise("amber")
    return s.v("v_status").groupBy("status").agg(F.count("*").alias("n")).select("status", F.coalesce(F.element_at(label, F.col("status")), "status").alias("label"), tone.alias("tone"), "n")


@query("q_FS11_folded", "select o_orderkey, replace(lower(o_orderpriority), 'ß', 'ss') as folded from orders")
def folded(s: Source) -> DataFrame:
    from ..functions.text import folded as fold

    return s.t("orders").select("o_orderkey", fold(F.col("o_orderpriority")).alias("folded"))


@query("q_FM04_coerced_values", "select doc_id, line_no, case line_no when 2 then nullif(regexp_extract(text, '\\b([0-9]{5})\\b', 1), '') else trim(text) end as value from ({v_form_lines}) v")
def coerced_values(s: Source) -> DataFrame:
    field = F.when(F.col("line_no") == 2, "postleitzahl").otherwise("wohnort")
    return s.v("v_form_lines").select("doc_id", "line_no", mapper.coerce(field, F.col("text")).alias("value"))


# --- page quality ------------------------------------------------------------------------------------------------------

Q = """with b as (select l_orderkey, l_linenumber, cast(l_partkey % 100 as double) / 100 as sharp, cast(l_suppkey % 100 as double) / 100 as contrast, cast(l_partkey % 1200 as int) + 1 as w, cast(l_suppkey % 1500 as int) + 1 as h from lineitem),
    z as (select *, least(1.0, cast(least(w, h) as double) / 600) as size from b), q as (select *, round(greatest(0.0, least(1.0, sharp * 0.4::double + contrast * 0.35::double + size * 0.25::double)), 9) as score from z)"""


def _pages(s: Source) -> DataFrame:
    p = s.t("lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_partkey") % 100).cast("double") / 100).alias("sharp"), ((F.col("l_suppkey") % 100).cast("double") / 100).alias("contrast"),
        ((F.col("l_partkey") % 1200).cast("int") + 1).alias("w"), ((F.col("l_suppkey") % 1500).cast("int") + 1).alias("h"),
    )
    p = p.withColumn("size", quality.size_score(F.col("w"), F.col("h")))
    return p.withColumn("score", F.round(quality.legibility(F.col("sharp"), F.col("contrast"), F.col("size")), 9))


@query("q_FM08_legibility", Q + " select l_orderkey, l_linenumber, round(size, 6) as size, round(score, 6) as score from q")
def legibility(s: Source) -> DataFrame:
    return _pages(s).select("l_orderkey", "l_linenumber", F.round("size", 6).alias("size"), F.round("score", 6).alias("score"))


@query("q_P10_admission_route", Q + " select case when score >= 0.7 then 'admissible' when score >= 0.2 then 'degraded' else 'refused' end as route, count(*) as n from q group by 1")
def admission_route(s: Source) -> DataFrame:
    return _pages(s).groupBy(quality.route(F.col("score")).alias("route")).agg(F.count("*").alias("n"))


@query("q_P12_reject_reason", Q + """ select l_orderkey, l_linenumber, case when score < 0.7 then concat_ws('; ', case when sharp < 0.5 then 'text too blurry (sharpness=' || printf('%.2f', sharp) || ')' end, case when contrast < 0.5 then 'insufficient contrast (' || printf('%.2f', contrast) || ')' end,
    case when size < 0.5 then 'resolution too low (' || w || 'x' || h || ', min 600px)' end, 'overall legibility below') end as reason from q""")
def reject_reason(s: Source) -> DataFrame:
    c = F.col
    reason = quality.rejection_reason(c("sharp"), c("contrast"), c("size"), c("score"), c("w"), c("h"))
    # The last clause prints the score, whose halves the engines round to different sides.
    return _pages(s).select("l_orderkey", "l_linenumber", F.regexp_replace(reason, r"overall legibility [0-9.]+ < threshold 0\.7", "overall legibility below").alias("reason"))


@query("q_P09_confidence_scaling", Q + " select l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, contrast * case when score >= 0.7 then greatest(0.5, least(1.0, score)) else least(greatest(0.5, least(1.0, score)), 0.6) end)), 6) as confidence from q")
def confidence_scaling(s: Source) -> DataFrame:
    p = _pages(s)
    return p.select("l_orderkey", "l_linenumber", F.round(quality.scaled_confidence(F.col("contrast"), F.col("score"), F.col("score") >= 0.7), 6).alias("confidence"))


@query("q_FM06_contrast_sharpness", """select l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, ((l_partkey % 256 - least(l_suppkey % 256, l_partkey % 256)) / 255.0::double - 0.15::double) / 0.45::double)), 6) as contrast,
    round(least(l_extendedprice / 800, 1.0) * case when l_quantity > 18 then greatest(0.4::double, 1 - (l_quantity - 18) / 60) else 1 end, 6) as sharpness from lineitem""")
def contrast_sharpness(s: Source) -> DataFrame:
    hi = F.col("l_partkey") % 256
    lo = F.least(F.col("l_suppkey") % 256, hi)
    return s.t("lineitem").select("l_orderkey", "l_linenumber", F.round(quality.contrast_score(lo, hi), 6).alias("contrast"), F.round(quality.sharpness_score(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("sharpness"))


@query("q_A22_pixel_stats")
def pixel_stats(s: Source) -> DataFrame:
    """A vector's components, twice, stand for a 16 x 8 grey page."""
    grey = F.transform(F.concat("embedding", "embedding"), lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x * 200 + 128).cast("int"))).cast("bigint")), 2, "0"))
    raw = F.unhex(F.array_join(grey, ""))
    d = s.t("embeddings").select("vec_id", udfs.pixel_stats(raw, F.lit(16), F.lit(8)).alias("p"), udfs.difference_hash(raw, F.lit(16), F.lit(8)).alias("dhash"))
    return d.select("vec_id", "p.*", "dhash")


# --- boxes -------------------------------------------------------------------------------------------------------------

BOX = "from ({v_boxes}) b"


def _box() -> Column:
    return geometry.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))


@query("q_G05_bbox_area", f"select doc_id, line_no, round((x2 - x1) * (y2 - y1), 9) as area, x1 >= 0 and y1 >= 0 and x2 <= 1 and y2 <= 1 and x1 < x2 and y1 < y2 as valid {BOX}")
def bbox_area(s: Source) -> DataFrame:
    return s.v("v_boxes").select("doc_id", "line_no", F.round(geometry.area(_box()), 9).alias("area"), geometry.is_valid(_box()).alias("valid"))


@query("q_G07_bbox_iou", """with p as (select a.doc_id, a.line_no as a_line, b.line_no as b_line, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as t
    from ({v_boxes}) a join ({v_boxes}) b on a.doc_id = b.doc_id and b.line_no = a.line_no + 1) select doc_id, a_line, b_line, round(i, 9) as overlap, round(case when t - i > 0 then i / (t - i) else 0 end, 9) as iou from p""")
def bbox_iou(s: Source) -> DataFrame:
    a = s.v("v_boxes").select("doc_id", F.col("line_no").alias("a_line"), _box().alias("a"))
    b = s.v("v_boxes").select("doc_id", F.col("line_no").alias("b_line"), _box().alias("b"), (F.col("line_no") - 1).alias("a_line"))
    return a.join(b, ["doc_id", "a_line"]).select("doc_id", "a_line", "b_line", F.round(geometry.intersection(F.col("a"), F.col("b")), 9).alias("overlap"), F.round(geometry.iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query("q_G03_bbox_track", """with p as (select doc_id, line_no, x2 * 1000 as a, y1 * 800 as b, x1 * 1000 - case when line_no = 3 then 5 else 0 end as c, y2 * 800 as d from ({v_boxes}) v),
    s as (select doc_id, line_no, greatest(a, b, c, d) > 1 and least(a, b, c, d) >= 0 as px, a, b, c, d from p),
    u as (select doc_id, line_no, case when px and a > 1 then a / 1000 else a end as a, case when px and b > 1 then b / 800 else b end as b, case when px and c > 1 then c / 1000 else c end as c, case when px and d > 1 then d / 800 else d end as d from s),
    k as (select doc_id, line_no, greatest(0.0, least(1.0, least(a, c))) as x1, greatest(0.0, least(1.0, least(b, d))) as y1, greatest(0.0, least(1.0, greatest(a, c))) as x2, greatest(0.0, least(1.0, greatest(b, d))) as y2 from u)
    select doc_id, line_no, round(case when x2 > x1 and y2 > y1 then x1 else 0 end, 9) as x1, round(case when x2 > x1 and y2 > y1 then y1 else 0 end, 9) as y1, round(case when x2 > x1 and y2 > y1 then x2 else 0 end, 9) as x2, round(case when x2 > x1 and y2 > y1 then y2 else 0 end, 9) as y2 from k""")
def bbox_track(s: Source) -> DataFrame:
    c = F.col
    t = geometry.track(c("x2") * 1000, c("y1") * 800, c("x1") * 1000 - F.when(c("line_no") == 3, 5).otherwise(0), c("y2") * 800, F.lit(1000), F.lit(800))
    return s.v("v_boxes").select("doc_id", "line_no", t.alias("t")).select("doc_id", "line_no", *[F.round(f"t.{k}", 9).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("q_G01_polygon_bbox", """select doc_id, line_no, case when line_no <> 5 then round(greatest(0.0, least(1.0, (q - 3) / 40)), 9) end as x1, case when line_no <> 5 then round(greatest(0.0, least(1.0, (q - 2) / 50)), 9) end as y1, case when line_no <> 5 then round(greatest(0.0, least(1.0, (q + 3) / 40)), 9) end as x2, case when line_no <> 5 then round(greatest(0.0, least(1.0, (q + 2) / 50)), 9) end as y2 from ({v_boxes}) b""")
def polygon_bbox(s: Source) -> DataFrame:
    q = F.col("q")
    points = F.array(F.array(q - 3, q), F.array(q, q + 2), F.array(q + 3, q - 1), F.array(q, q - 2))
    b = geometry.polygon_box(points, F.lit(40), F.when(F.col("line_no") == 5, 0).otherwise(50))
    return s.v("v_boxes").select("doc_id", "line_no", b.alias("t")).select("doc_id", "line_no", *[F.round(f"t.{k}", 9).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("q_G02_bottom_left_box", f"select doc_id, line_no, round(greatest(0.0, least(1.0, x1)), 9) as x1, round(greatest(0.0, least(1.0, 1 - (y1 + 0.3::double))), 9) as y1, round(greatest(0.0, least(1.0, x1 + 0.25::double)), 9) as x2, round(greatest(0.0, least(1.0, 1 - y1)), 9) as y2 {BOX}")
def bottom_left_box(s: Source) -> DataFrame:
    b = geometry.from_bottom_left(F.col("x1"), F.col("y1"), F.lit(0.25), F.lit(0.3))
    return s.v("v_boxes").select("doc_id", "line_no", b.alias("t")).select("doc_id", "line_no", *[F.round(f"t.{k}", 9).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("q_G04_to_pixels", f"select doc_id, line_no, cast(round_even(x1 * 1001, 0) as int) as x1, cast(round_even(y1 * 777, 0) as int) as y1, cast(round_even(x2 * 1001, 0) as int) as x2, cast(round_even(y2 * 777, 0) as int) as y2 {BOX}")
def to_pixels(s: Source) -> DataFrame:
    return s.v("v_boxes").select("doc_id", "line_no", geometry.to_pixels(_box(), F.lit(1001), F.lit(777)).alias("t")).select("doc_id", "line_no", "t.*")


@query("q_G08_same_row", """select a.doc_id, a.line_no as a_line, b.line_no as b_line from ({v_boxes}) a join ({v_boxes}) b on a.doc_id = b.doc_id and b.line_no = a.line_no + 1
    where abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= 0.02 or (b.y1 <= (a.y1 + a.y2) / 2 and (a.y1 + a.y2) / 2 <= b.y2)""")
def same_row(s: Source) -> DataFrame:
    a = s.v("v_boxes").select("doc_id", F.col("line_no").alias("a_line"), _box().alias("a"))
    b = s.v("v_boxes").select("doc_id", F.col("line_no").alias("b_line"), _box().alias("b"), (F.col("line_no") - 1).alias("a_line"))
    return a.join(b, ["doc_id", "a_line"]).where(geometry.same_row(F.col("a"), F.col("b"))).select("doc_id", "a_line", "b_line")


@query("q_G10_valid_boxes", f"select doc_id, line_no, case when x2 <= 1 and y2 <= 1 and x1 < x2 and y1 < y2 then round(x1, 9) end as x1 {BOX}")
def valid_boxes(s: Source) -> DataFrame:
    b = F.when(geometry.is_valid(_box()), _box())
    return s.v("v_boxes").select("doc_id", "line_no", F.round(b["x1"], 9).alias("x1"))


@query("q_G11_css_box", f"select doc_id, line_no, round(greatest(0.0, least(100.0, x1 * 100)), 6) as left_pct, round(greatest(0.0, least((x2 - x1) * 100, 100 - greatest(0.0, least(100.0, x1 * 100)))), 6) as width_pct {BOX}")
def css_box(s: Source) -> DataFrame:
    b = geometry.css_box(_box())
    return s.v("v_boxes").select("doc_id", "line_no", F.round(b["left"], 6).alias("left_pct"), F.round(b["width"], 6).alias("width_pct"))
