"""Literal rows for the functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from docmill.functions import amounts, dates, geometry, identifiers, jsons, udfs, vectors
from docmill.functions import text as T


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_amounts(spark):
    texts = ["5.200,00 €", "45.200,00 EUR", "3200,00", "1.234.567,89", "42", "5.200", "none", None, "-7,50", "1234.56"]
    assert column(spark, texts, "string", amounts.parse_amount) == [5200.0, 45200.0, 3200.0, 1234567.89, 42.0, 5200.0, None, None, 7.5, 1234.0]
    assert column(spark, ["3.000,50 EUR", "a 3", "12.5", "1.200", ""], "string", amounts.parse_whole) == [3000.5, None, 12.5, 1200.0, None]
    assert column(spark, [45236.0, 0.5], "double", amounts.german_amount) == ["45.236,00", "0,50"]


def test_tax_ids(spark):
    ids = ["86095742719", "86095742718", "06095742719", "91234567891", "86 095 742 719", "12345678901", "8609574271", "", None, "86095742719\n"]
    assert column(spark, ids, "string", identifiers.tax_id_valid) == [True, False, False, True, True, False, False, False, False, False]


def test_ibans(spark):
    ids = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "AT611904300234573201", "NL91ABNA0417164300", "DE8937040044053201300", "DE88370400440532013000", "", None, "12"]
    assert column(spark, ids, "string", identifiers.iban_valid) == [True, True, True, True, False, False, False, False, False]


def test_streets(spark):
    streets = ["Hauptstraße", "Am See", "Straße des 17. Juni", "von-Bülow-Straße", "12345", "....", "Hauptstra…", "x", None]
    assert column(spark, streets, "string", identifiers.street_valid) == [True] * 4 + [False] * 5


def test_postal_codes(spark):
    assert column(spark, ["10115", "01067", "1011", "101 15", "abc", None], "string", identifiers.postal_code_valid) == [True, True, False, True, False, False]


def test_dates(spark):
    day = F.to_date(F.lit("2024-06-01"))
    texts = ["29.02.2024", "29.02.2023", "31.04.2020", "00.01.2020", "32.01.2020", "01.13.2020", "1.2.2020", " 15.03.1985 ", "01.01.2030", "", None]
    d = datetime.date
    assert column(spark, texts, "string", lambda c: dates.parse_date(c, day)) == [d(2024, 2, 29), None, None, None, None, None, None, d(1985, 3, 15), None, None, None]
    assert column(spark, ["01.01.2030"], "string", lambda c: dates.parse_date(c, day, True)) == [d(2030, 1, 1)]
    assert column(spark, ["01.09. .2030", "am 3.4.1999", "geb. 01.02.1990"], "string", dates.find_date) == ["01.09.2030", None, "01.02.1990"]
    assert column(spark, ["01.01.1850", "01.01.1900", "x"], "string", lambda c: dates.birthdate_message(c, day).isNull()) == [False, True, False]


def test_text(spark):
    assert column(spark, ["Haus-Nr.", "STRASSE 1", None], "string", T.alnum_key) == ["hausnr", "strasse1", None]
    assert column(spark, ["Invoice Number", "  A -- b ", "1st", "", "Ü/ß"], "string", T.field_name) == ["invoice_number", "a_b", "field_1st", "", "ü_ß"]
    assert column(spark, ["a\nb\r\nc\rd", "", None, "x\n"], "string", T.lines) == [["a", "b", "c", "d"], [], [], ["x"]]
    assert column(spark, [" a \t b c "], "string", T.squeeze) == ["a b c"]
    assert column(spark, ["15.03.1985", "12a", "abc", "1a2b3"], "string", T.field_kind) == ["date", "number", "text", "number"]
    assert column(spark, ["", "one two three", None], "string", T.prompt_tokens) == [0.0, 4.0, 0.0]
    kv = column(spark, ["a = b: c", "x:", "none", ": v"], "string", lambda c: T.split_at(c, [":", "=", "\t"]))
    assert [tuple(k) if k else None for k in kv] == [("a = b", "c"), ("x", ""), None, ("", "v")]
    strict = column(spark, ["a = b:", "k | v"], "string", lambda c: T.split_at(c, [":", "=", "|"], both=True))
    assert [tuple(k) for k in strict] == [("a", "b:"), ("k", "v")]


def test_edit_distances(spark):
    pairs = spark.createDataFrame([("kitten", "sitting"), ("a x c", "a b c"), ("", ""), ("x", ""), ("größe", "grosse"), ("ab cd", "cd ab ef")], "p string, t string")
    rows = pairs.select(F.levenshtein("p", "t"), T.char_error_rate(F.col("p"), F.col("t")), T.word_error_rate(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in rows][:5] == [3, 1, 0, 1, 3]
    assert rows[0][1] == pytest.approx(3 / 7)
    assert [r[2] for r in rows] == pytest.approx([1.0, 1 / 3, 0.0, 1.0, 1.0, 2 / 3])


def test_vectors(spark):
    pairs = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in pairs.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1, 0, -1, 0, 0, 0])


def test_boxes(spark):
    one = spark.range(1)
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    get = lambda c: one.select(c.alias("c")).first()[0]
    assert tuple(get(geometry.track(*lit(100, 200, 500, 600), *lit(1000, 1000)))) == (0.1, 0.2, 0.5, 0.6)
    assert tuple(get(geometry.track(*lit(0.5, 0.6, 0.1, 0.2), *lit(1000, 1000)))) == (0.1, 0.2, 0.5, 0.6)
    assert tuple(get(geometry.track(*lit(0.5, 0.5, 0.5, 0.9), *lit(10, 10)))) == (0, 0, 0, 0)
    a, b = geometry.box(*lit(0, 0, 0.5, 0.5)), geometry.box(*lit(0.25, 0.25, 0.75, 0.75))
    assert get(geometry.iou(a, b)) == pytest.approx(1 / 7)
    assert get(geometry.polygon_box(F.array().cast("array<array<double>>"), F.lit(10), F.lit(10))) is None
    assert get(geometry.is_valid(geometry.box(*lit(0.5, 0, 0.2, 1)))) is False


def test_json(spark):
    texts = ['```json\n{"a": 1}\n```', 'so {"a": 1} done', "[1]", "none", None, '{"a": {"b": 2}} x {']
    assert column(spark, texts, "string", jsons.salvage)[:5] == ['{"a": 1}', '{"a": 1}', None, None, None]
    assert column(spark, texts, "string", udfs.json_block)[5] == '{"a": {"b": 2}}'


def test_udfs(spark):
    pairs = spark.createDataFrame([("Total 42", "total 42"), ("", ""), ("a", ""), ("abcd", "bcde")], "a string, b string")
    assert [r[0] for r in pairs.select(udfs.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, 0.75]
    v = column(spark, ["hello world", "hello world", "", None], "string", udfs.hashed_embedding)
    assert v[0] == v[1] and sum(x * x for x in v[0]) == pytest.approx(1) and not any(v[2]) and not any(v[3])
    grey = bytes(range(256)) * 4
    rows = spark.createDataFrame([(grey, 32, 32), (b"", 0, 0)], "p binary, w int, h int")
    stats = rows.select(udfs.pixel_stats("p", "w", "h").alias("s"), udfs.difference_hash("p", "w", "h").alias("d")).collect()
    assert stats[0]["s"]["p98"] > 200 and len(stats[0]["d"]) == 16 and stats[1]["d"] is None
    assert spark.range(1).select(udfs.hamming(F.lit("00000000000000ff"), F.lit("8000000000000000"))).first()[0] == 9
