"""Operators on small fixtures."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill import catalog
from docmill.functions import geometry
from docmill.functions import text as T
from docmill.operators import classify, compare, corpus, fewshot, layout, lines, mapper, retrieval, stats, synth, validate
from docmill.sources import files, tables

OCR = "doc_id string, doc_type string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def mapped(spark, doc_type, rows):
    data = [("d", doc_type, i + 1, *r) for i, r in enumerate(rows)]
    return {r["field_name"]: r for r in mapper.map_fields(spark.createDataFrame(data, OCR)).collect()}


def test_mapper_passes(spark):
    m = mapped(spark, catalog.RESIDENCE, [
        ("Familienname: Müller", 0.95, 0.1, 0.2, 0.5, 0.24),
        ("Vorname", 0.9, 0.10, 0.30, 0.28, 0.34), ("Hans", 0.9, 0.35, 0.30, 0.50, 0.34),
        ("Geburtsdatum", 0.9, 0.10, 0.40, 0.34, 0.44), ("15.03.1985", 0.9, 0.10, 0.46, 0.34, 0.50),
        ("10115 Berlin", 0.9, 0.1, 0.6, 0.3, 0.64), ("Footer text", 0.9, 0.1, 0.9, 0.3, 0.94),
    ])
    assert (m["familienname"]["value"], m["familienname"]["source"]) == ("Müller", "inline")
    assert (m["vorname"]["value"], m["vorname"]["source"]) == ("Hans", "spatial-right")
    assert (m["geburtsdatum"]["value"], m["geburtsdatum"]["source"]) == ("15.03.1985", "spatial-below")
    assert (m["postleitzahl"]["value"], m["postleitzahl"]["source"]) == ("10115", "pattern")
    assert m["_line_0007"]["confidence"] == pytest.approx(0.45) and m["_line_0002"]["source"] == "unmapped"


def test_mapper_rows_and_bounds(spark):
    # The value's centre lies within the tall label, but not the label's within the value: a value below, not beside.
    m = mapped(spark, catalog.RESIDENCE, [("Vorname", 0.9, 0.10, 0.30, 0.28, 0.50), ("Hans", 0.9, 0.12, 0.43, 0.30, 0.47)])
    assert (m["vorname"]["value"], m["vorname"]["source"]) == ("Hans", "spatial-below") and m["vorname"]["confidence"] == pytest.approx(0.9 * 0.82)
    # A confidence is cut to 0 .. 1 before its factor.
    m = mapped(spark, catalog.RESIDENCE, [("15.03.1985", 1.5, 0.1, 0.1, 0.3, 0.14), ("Familienname: Müller", -2.0, 0.1, 0.2, 0.5, 0.24)])
    assert m["geburtsdatum"]["confidence"] == pytest.approx(0.72) and m["familienname"]["confidence"] == 0.0


def test_same_row(spark):
    boxes = [((0.30, 0.50), (0.43, 0.47), False), ((0.43, 0.47), (0.30, 0.50), True), ((0.30, 0.34), (0.31, 0.35), True), ((0.30, 0.34), (0.35, 0.39), False), ((0.30, 0.34), (0.31, 0.60), True)]
    box = lambda y: F.struct(F.lit(0.1).alias("x1"), F.lit(y[0]).alias("y1"), F.lit(0.2).alias("x2"), F.lit(y[1]).alias("y2"))
    row = spark.range(1).select(*[geometry.same_row(box(a), box(b)) for a, b, _ in boxes]).first()
    assert list(row) == [want for _, _, want in boxes]


def test_fields_without_limits(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"Feld {i}: {'x' * 600}" for i in range(300))), (2, "a: 1\nA : 2\nb | c"), (3, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in lines.text_fields(docs).select("doc_id", "pos", "field_name", "value").collect()] == [(2, 1, "a", "1"), (2, 2, "b", "c")]
    out = lines.text_fields(docs.where("doc_id = 1"), most_lines=None, most_chars=None, most_fields=None, value_chars=None).collect()
    assert len(out) == 300 and all(len(r["value"]) == 600 for r in out)


def test_number_in_order(spark):
    rows = [(i % 3, f"k{i * 7 % 100:02}") for i in range(100)]
    df = spark.createDataFrame(rows, "g int, k string")
    assert sorted((r["k"], r["n"]) for r in corpus.number_in_order(df, ["k"]).collect()) == [(f"k{i:02}", i + 1) for i in range(100)]
    for g in range(3):
        mine = sorted((r["k"], r["n"]) for r in corpus.number_in_order(df, ["k"], "n", "g").collect() if r["g"] == g)
        assert mine == [(k, i + 1) for i, k in enumerate(sorted(k for h, k in rows if h == g))]
    assert corpus.number_in_order(df.limit(0), ["k"]).count() == 0


def test_words_beyond_one_plane(spark):
    many = " ".join(f"w{i}" for i in range(60_000, 60_040))
    df = spark.createDataFrame([(many, many.replace("w60003", "x").replace(" w60039", "")), ("a b c", "a x c d"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(T.word_levenshtein(F.col("a"), F.col("b"))).collect()] == [2, 2, 0]
    letters = spark.range(1, 80_000, 997).select(T._letter(F.col("id")).alias("c")).collect()
    assert all(len(r["c"]) == 1 and r["c"] != "\ufffd" for r in letters) and len({r["c"] for r in letters}) == len(letters)


def test_mapper_shapes(spark):
    m = mapped(spark, catalog.TAX, [("86 095 742 719", 0.9, 0.1, 0.1, 0.3, 0.14)])
    assert m["steueridentifikationsnummer"]["value"] == "86095742719"
    m = mapped(spark, catalog.ID_CARD, [("MUSTERMANN", 0.9, 0.4, 0.2, 0.6, 0.24), ("Dokumentnummer: L01X00T471", None, 0.1, 0.1, 0.3, 0.14)])
    assert m["familienname"]["source"] == "card-surname" and m["dokumentnummer"]["value"] == "L01X00T47"
    assert m["dokumentnummer"]["confidence"] == pytest.approx(0.85)
    m = mapped(spark, catalog.PAYSLIP, [("Brutto: 3.000,00 €", 0.8, None, None, None, None), ("Bruttolohn = 9,00", 0.9, None, None, None, None)])
    assert m["brutto_lohn"]["value"] == "3000.0"  # a field that a line has given is settled


def test_text_fields(spark):
    docs = spark.createDataFrame([(1, "Invoice Number: A-100\nTotal: 42.50\nTotal: 9\n: x\nNote:\na | b\nx | y | z\n9: 1"), (2, ""), (3, None), (4, "no fields"), (5, "k: " + "v" * 600)], "doc_id int, text string")
    rows = lines.with_text_fallback(lines.text_fields(docs), docs).collect()
    got = {(r["doc_id"], r["field_name"]): (r["value"], r["confidence"]) for r in rows}
    assert got[1, "invoice_number"] == ("A-100", 0.65) and got[1, "total"] == ("42.50", 0.65) and got[1, "a"] == ("b", 0.30) and got[1, "field_9"] == ("1", 0.30)
    assert len([k for k in got if k[0] == 1]) == 4
    assert got[2, "_text"] == (None, 0.0) and got[3, "_text"] == (None, 0.0) and got[4, "_text"] == ("no fields", 0.35) and (5, "_text") in got
    assert lines.text_fields(docs.limit(0)).count() == 0


def test_unique_names(spark):
    rows = [(1, i, t) for i, t in enumerate(["a: 1", "a: 2", "plain", "a 2: 3"], 1)]
    got = [r["field_name"] for r in lines.structural_map(spark.createDataFrame(rows, "doc_id int, line_no int, text string")).orderBy("line_no").collect()]
    assert got == ["a", "a_2", "line_0003", "a_2_2"]


def test_validation(spark):
    rows = [("a", "brutto_lohn", "3000"), ("a", "netto_lohn", "3500"), ("b", "brutto_lohn", "5000"), ("b", "netto_lohn", "3200"), ("c", "postleitzahl", "1011"), ("c", "vorname", None), ("c", "brutto_lohn", "-1"), ("c", "netto_lohn", "x"), ("c", "other", "anything")]
    v = validate.check_net_against_gross(validate.validate_fields(spark.createDataFrame(rows, "doc_id string, field_name string, value string"), "2024-01-01"))
    got = {(r["doc_id"], r["field_name"]): r["status"] for r in v.collect()}
    assert got["a", "netto_lohn"] == "VALIDATION_FAILURE" and got["b", "netto_lohn"] == "EXTRACTED" and got["c", "vorname"] == "UNRESOLVED"
    assert [got["c", f] for f in ("postleitzahl", "brutto_lohn", "netto_lohn", "other")] == ["VALIDATION_FAILURE"] * 3 + ["EXTRACTED"]


def test_status_counts(spark):
    rows = [("d", "EXTRACTED", 0.9), ("d", "VALIDATION_FAILURE", 0.5), ("d", "UNRESOLVED", 0.0)]
    r = lines.status_counts(spark.createDataFrame(rows, "doc_id string, status string, confidence double")).first()
    assert (r["unresolved_count"], r["validation_failure_count"], r["corrected_count"]) == (1, 1, 0) and r["overall_confidence"] == pytest.approx(0.4666, abs=1e-3)


def test_classify(spark):
    texts = ["Das Finanzamt: Steuerbescheid", "Personalausweis", "", None, "GÜLTIG BIS", "Meldeamt, Finanzamt"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert [r["document_type"] for r in classify.classify_documents(rows).orderBy("doc_id").collect()] == [catalog.TAX, catalog.ID_CARD, "Unbekannt", "Unbekannt", catalog.ID_CARD, catalog.RESIDENCE]


def test_consistency(spark):
    a = spark.createDataFrame([("d", "x"), ("d", "y"), ("d", "z")], "doc_id string, field_name string")
    b = spark.createDataFrame([("d", "x", 0.3, "v"), ("d", "y", 0.9, ""), ("d", "w", 0.9, "v")], "doc_id string, field_name string, confidence double, raw_value string")
    r = compare.consistency(compare.compare_maps(a, b)).first()
    assert (r["matched"], r["missing_in_b"], r["orphan_in_b"], r["low_confidence"], r["score"]) == (2, 1, 1, 1, 0.0)


def test_corrections(spark):
    c = spark.createDataFrame([(f"c{i}", "plz", "T", f"orig_{i}", f"corr_{i}") for i in range(8)], "id string, field string, doc_type string, original string, corrected string")
    f = spark.createDataFrame([("plz", "T", None, " ORIG_3 "), ("plz", "T", "orig_7", ""), ("plz", "U", "orig_1", None), ("plz", "T", "", "")], "field_name string, doc_type string, value string, raw_text string")
    got = {r["raw_text"] or r["value"] or "": r["recalled"] for r in retrieval.recall_corrections(f, c).collect()}
    assert got[" ORIG_3 "] == "corr_3" and got["orig_7"] is None and got["orig_1"] is None


def test_neighbours(spark):
    rows = spark.createDataFrame([(i, "A" if i % 2 else "B", [1.0, float(i)]) for i in range(10)], "id int, form_type string, embedding array<double>")
    assert [r["id"] for r in retrieval.nearest(rows, [1.0, 0.0], 3).collect()] == [0, 1, 2]
    assert retrieval.nearest(rows, [1.0, 0.0], 50).count() == rows.count() and retrieval.nearest(rows, [1.0, 0.0], 0).count() == 0
    assert sorted(r["id"] for r in retrieval.nearest_then_type(rows, [1.0, 0.0], 5, "A").collect()) == [1, 3]
    assert retrieval.nearest_then_type(rows, [1.0, 0.0], 5, "none").count() == 5


def test_merge(spark):
    rows = [("d", 1, "01.", 0.9, 0.1, 0.1, 0.14, 0.12), ("d", 2, "02.", 0.8, 0.145, 0.1, 0.18, 0.12), ("d", 3, "far", 0.7, 0.5, 0.1, 0.6, 0.12), ("d", 4, "title", 0.6, 0.185, 0.05, 0.3, 0.17), ("d", 5, "bare", 0.5, None, None, None, None)]
    got = {r["text"]: (r["n"], r["confidence"]) for r in layout.merge_fragments(spark.createDataFrame(rows, "doc_id string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert got == {"01. 02.": (2, 0.8), "far": (1, 0.7), "title": (1, 0.6), "bare": (1, 0.5)}


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([("g", 1, "x" * 350), ("g", 2, "x" * 700), ("g", 3, "x")], "g string, k int, text string")
    assert [r["k"] for r in fewshot.within_budget(rows, ["g"], [F.col("k")], "text").collect()] == [1]


def test_corpus(spark):
    stored = spark.createDataFrame([("a", 1)], "image_id string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 5)], "image_id string, v int")
    first = corpus.new_records(stored, new, "image_id", [F.col("v")])
    assert [tuple(r) for r in first.collect()] == [("b", 3)]
    assert corpus.new_records(stored.unionByName(first), new, "image_id").count() == 0
    for share in (0.0, 0.33, 1.0):
        s = corpus.split_exactly(spark.range(100).withColumnRenamed("id", "k"), "k", share)
        assert s.where("part = 'val'").count() == int(100 * share) and s.count() == 100


def test_stats_of_nothing(spark):
    r = stats.audit_stats(spark.createDataFrame([], catalog.SCHEMAS["audit_log"])).first()
    assert tuple(r) == (0, 0.0, 0.0, 0.0)


def test_synthetic(spark):
    r = synth.records(spark, 40, 5)
    assert r.collect() == synth.records(spark, 40, 5).collect() and r.groupBy("document_type").count().count() == 4


def test_files(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:p><w:t>Hallo</w:t> <w:t>Welt</w:t></w:p>")
    for name, data in {"a.docx": z.getvalue(), "b.csv": b'x, "y,1" \n"q""t",2\n', "c.json": b'{"k":1}', "d.txt": b"a\x00b\xff", "e.png": b"\x89PNG\r\n\x1a\n..", "f.png": b"nope", "g.gif": b"GIF89a", "h.tsv": b"1\t2"}.items():
        (tmp_path / name).write_bytes(data)
    good = files.admitted(files.read_uploads(spark, str(tmp_path)))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in good.collect()) == ["a.docx", "b.csv", "c.json", "d.txt", "e.png", "h.tsv"]
    text = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.file_text(good).collect()}
    assert text["a.docx"] == "Hallo Welt" and text["d.txt"] == "a b" and text["h.tsv"] == "1 | 2" and '"k"' in text["c.json"] and "e.png" not in text
    assert text["b.csv"].split("\n")[1] == 'q"t | 2'


def test_tables(spark, tmp_path):
    (tmp_path / "audit.json").write_text('{"extraction_id": "x", "overall_confidence": 0.5}\n\n{broken\n{"extraction_id": "y"}\n')
    assert sorted(r["extraction_id"] for r in tables.read_audit(spark, str(tmp_path / "audit.json")).collect()) == ["x", "y"]
    rows = spark.createDataFrame([("2024-01-01T00:00:00", "x")], "timestamp string, extraction_id string")
    for _ in range(2):
        tables.append_audit(rows, str(tmp_path / "log"))
    assert tables.read_audit(spark, str(tmp_path / "log")).count() == 2
    (tmp_path / "truth.json").write_text('{"_note": {"document_type": "T", "fields": {"a": "b"}}, "f.png": {"document_type": "T", "fields": {"a": "1", "b": ""}}}')
    assert sorted((r["doc_id"], r["field_name"]) for r in tables.read_ground_truth(spark, str(tmp_path / "truth.json")).collect()) == [("f.png", "a"), ("f.png", "b")]
    (tmp_path / "manifest.json").write_text('[{"filename": "a", "hash": "h"}, {"filename": "b"}]')
    assert tables.read_manifest(spark, str(tmp_path / "manifest.json")).count() == 2
    (tmp_path / "log.txt").write_text("\n".join(map(str, range(100))))
    assert [r[0] for r in tables.log_tail(spark, str(tmp_path / "log.txt"), 3).select("value").collect()] == ["97", "98", "99"]


def test_ingest_resumes(spark, tmp_path):
    from docmill.streaming.ingest import Progress, run_state, start_ingest

    listener = Progress()
    spark.streams.addListener(listener)
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "image_id string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), "image_id string, v int", str(tmp_path / "out"), str(tmp_path / "cp"))
    start_ingest(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([("b", 1), ("c", 1)], "image_id string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start_ingest(*args)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("image_id").collect()) == ["a", "b", "c"]
    spark.streams.removeListener(listener)
    assert run_state("running", 3, False) == "external" and run_state("running", 30, False) == "stopped" and run_state("idle", 3, False) == "idle"
