"""Sentinel rows, known context, two-pass answers; table functions in SQL."""

from pyspark.sql import functions as F

from docmill.functions import tables
from docmill.operators import lines, outcomes


def test_page_results(spark):
    pages = spark.createDataFrame(
        [(1, "A", 0.9, None, None), (2, "A", 0.9, "too dark", None), (3, None, 0.9, None, "no engine"), (4, None, 0.9, None, None), (5, "B", -1.0, None, None), (6, "B", 0.1, "blurred", "broken"), (7, "B", None, None, None)],
        "doc_id int, document_type string, legibility double, refusal string, error string",
    )
    fields = spark.createDataFrame([(i, "name", "x", "EXTRACTED", 0.8) for i in (1, 2, 3)], "doc_id int, field_name string, value string, status string, confidence double")
    got = sorted(tuple(r) for r in outcomes.page_results(pages, fields).collect())
    assert got == [
        (1, "A", "name", "x", "EXTRACTED", 0.8, None),
        (2, "Unbekannt", "_refusal", "too dark", "UNRESOLVED", 0.0, "too dark"),
        (3, "Unbekannt", "_error", None, "UNRESOLVED", 0.0, "Pipeline error: no engine"),
        (4, "Unbekannt", "_unresolved", None, "UNRESOLVED", 0.25, "No readable fields found"),
        (5, "B", "_unresolved", None, "UNRESOLVED", 0.0, "No readable fields found"),
        (6, "Unbekannt", "_refusal", "blurred", "UNRESOLVED", 0.0, "blurred"),
        (7, "B", "_unresolved", None, "UNRESOLVED", 0.0, "No readable fields found"),
    ]


def test_known_context(spark):
    f = spark.createDataFrame([(1, "a", "v", "raw"), (1, "b", "v", ""), (1, "c", "v", None), (1, "d", "", "raw"), (1, "e", None, "raw"), (2, "a", "w", "w")], "doc_id int, field_name string, value string, raw_text string")
    assert {r["doc_id"]: r["context"] for r in outcomes.context_maps(f).collect()} == {1: {"a": "raw", "b": "v", "c": "v"}, 2: {"a": "w"}}


def test_two_pass_answers(spark):
    value = '{"a": {"raw_value": "x", "confidence_0_to_1": 0.4}, "b": {"raw_value": "None", "confidence_0_to_1": "nan"}, "c": {"raw_value": null, "confidence_0_to_1": -3}, "d": "text", "e": null, "f": {"raw_value": "", "confidence_0_to_1": 9}, "g": {"raw_value": "y"}}'
    boxes = '{"a": {"estimated_bbox": {"x": 0.1}}, "b": {"estimated_bbox": [1]}, "c": 4, "f": {}}'
    rows = outcomes.mapped_answers(spark.createDataFrame([(1, value, boxes), (2, "{}", None), (3, None, None), (4, '{"a": {"raw_value": "z"}}', "broken")], "doc_id int, value_map string, structural_map string")).collect()
    got = {(r["doc_id"], r["field_name"]): (r["value"], r["confidence"], r["raw_text"], r["bbox"]) for r in rows}
    assert got == {(1, "a"): ("x", 0.4, "x", '{"x":0.1}'), (1, "b"): (None, 0.0, "None", None), (1, "c"): (None, 0.0, "", None), (1, "f"): (None, 1.0, "", None), (1, "g"): ("y", 0.0, "y", None), (4, "a"): ("z", 0.0, "z", None)}


def test_table_functions(spark):
    tables.register(spark)
    texts = ["Name: Ada\r\nname : Bo\n\nTotal | 12\na|b|c\n: x\ny:\nName: Cy", "", None, "no pair here", "k: v: w\tz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").createOrReplaceTempView("some_texts")
    rows = [tuple(r) for r in spark.sql("select d.doc_id, f.* from some_texts d, lateral text_key_values(d.text) f order by 1, 2").collect()]
    assert rows == [(0, 1, "Name", "Ada"), (0, 2, "name", "Bo"), (0, 4, "Total", "12"), (0, 8, "Name", "Cy"), (4, 1, "k", "v: w z")]
    first = spark.sql("select * from first_keys(table(select d.doc_id, f.* from some_texts d, lateral text_key_values(d.text) f))")
    assert sorted(tuple(r) for r in first.collect()) == [(0, 1, 1, "Name", "Ada"), (0, 2, 2, "name", "Bo"), (0, 3, 4, "Total", "12"), (4, 1, 1, "k", "v: w z")]


def test_table_function_equals_the_expression(spark):
    tables.register(spark)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat("text", F.lit("\nSource: "), "source", F.lit("\nLang | "), "lang", F.lit("\nsource: again")).alias("text"))
    d.createOrReplaceTempView("some_documents")
    want = lines.text_fields(d, most_lines=None, most_chars=None, most_fields=None, value_chars=None).select("doc_id", "value")
    named = spark.sql("select d.doc_id, f.line_no, f.key, f.value from some_documents d, lateral text_key_values(d.text) f")
    from docmill.functions import text as T

    named = named.select("doc_id", "line_no", T.field_name(F.col("key")).alias("key"), "value").where("key <> ''")
    named.createOrReplaceTempView("some_lines")
    got = spark.sql("select doc_id, value from first_keys(table(some_lines))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_decoding_keeps_what_was_written(spark):
    from docmill.sources import files

    texts = [b"a\xff\xfeb", "x�y".encode(), b"\x01\xef\xbf\xbd\xc3z\x010", b"a\x00b", b"", None, b"x" * 5000 + b"\x00y", "ü".encode() * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, b binary").select("i", files.decoded(F.col("b"), None).alias("t"), files.decoded(F.col("b"), 2).alias("two")).orderBy("i").collect()
    assert [r["t"] for r in rows] == ["ab", "x�y", "\x01�z\x010", "a b", "", None, "x" * 5000 + "\x00y", "üüü"] and rows[7]["two"] == "üü"


def test_codes_and_health(spark):
    d = spark.createDataFrame([(400, 14000.0), (404, 14000.5), (413, None), (422, 0.0), (429, 0.0), (500, 0.0), (None, 0.0)], "s int, m double")
    rows = d.select(outcomes.error_code(F.col("s")).alias("c"), outcomes.health(F.col("m")).alias("h")).collect()
    assert [r["c"] for r in rows] == ["BAD_REQUEST", "NOT_FOUND", "FILE_TOO_LARGE", "VALIDATION_ERROR", "RATE_LIMITED", "HTTP_ERROR", "HTTP_ERROR"]
    assert [r["h"] for r in rows] == ["ok", "degraded", "ok", "ok", "ok", "ok", "ok"]
