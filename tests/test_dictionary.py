"""The automaton and the dictionaries that use it, against plain containment."""

import random
import re

from pyspark.sql import functions as F

from docmill.functions.automaton import Automaton
from docmill.operators import classify, dictionary, mapper


def test_automaton_finds_all_patterns():
    for seed in range(40):
        r = random.Random(seed)
        patterns = sorted({"".join(r.choices("abc", k=r.randrange(1, 6))) for _ in range(r.randrange(1, 30))})
        texts = ["".join(r.choices("abcd", k=r.randrange(0, 25))) for _ in range(20)]
        a = Automaton(patterns)
        for t in texts:
            assert {patterns[i] for i in a.found(t)} == {p for p in patterns if p in t}
        assert a.first_texts(texts) == [next((k for k, t in enumerate(texts) if p in t), -1) for p in patterns]
    assert Automaton([]).found("abc") == set() and Automaton(["äö"]).found("xäöx") == {0}


def plain(s):
    return re.sub(r"[^\w]|_", "", s.lower())


def brute(rows, key, line, kind):
    k, x, best, looks = plain(key or ""), plain(line or ""), None, False
    for t, field, name, place in rows:
        n = plain(name or "")
        if t is None or t != kind or not n or field is None:
            continue
        fits = k != "" and (k == n if len(n) < 4 else n in k or (len(k) >= 4 and k in n))
        if fits:
            best = max(best or (0, 0, ""), (len(n), -place, field))
        looks = looks or (len(n) >= 3 and n in x and len(x) <= len(n) + 4)
    return best and best[2], looks


def test_many_synonyms_equal_plain_containment(spark):
    r = random.Random(2)
    syllables = ["ba", "ko", "Mi", "nu", "-", "te", "X", "ös", "1"]

    def word(least, most):
        return "".join(r.choices(syllables, k=r.randrange(least, most)))

    rows = [(r.choice(["a", "b"]), f"f{i % 400}", word(1, 8), i) for i in range(10_000)] + [("a", "none", "", 1), ("b", None, "baba", 2), (None, "x", "baba", 3)]
    lines = [(i, word(0, 9) if i % 9 else None, word(1, 5), r.choice(["a", "b", "c", None])) for i in range(300)]
    names = spark.createDataFrame(rows, "doc_type string, field string, name string, place bigint")
    d = spark.createDataFrame(lines, "id int, key string, text string, doc_type string")
    want = {i: brute(rows, k, x, t) for i, k, x, t in lines}
    for part in (100_000, 2_500):  # also part by part
        got = {x["id"]: (x["field"], x["labelish"]) for x in dictionary.match_labels(d, names, part=part).collect()}
        assert got == want, part


def test_built_in_dictionary_equals_the_projection(spark):
    keys = ["PLZ", "Familienname:", "geboren am", "Str", "Wohn", "Hausnr.", "", None, "Steuer-ID", "xyz", "Name des Arbeitgebers", "netto", "datum"]
    d = spark.createDataFrame([(i, k, t) for i, k in enumerate(keys) for t in mapper.LABELS], "i int, key string, doc_type string").withColumn("text", F.col("key")).repartition(3)
    d = d.withColumns({"f": mapper.match_label(F.col("key"), F.col("doc_type")), "l": mapper.looks_like_label(F.col("text"), F.col("doc_type"))})
    out = dictionary.match_labels(d, dictionary.label_rows(spark))
    assert out.where(~F.col("f").eqNullSafe(F.col("field")) | (F.col("l") != F.col("labelish"))).count() == 0 and out.where("field is not null").count() > 10


def test_keyword_types(spark):
    words = {"one": ["alpha", "beta b", "ALPHA"], "two": ["beta", "gamma"], "three": ["alp"]}
    table = spark.createDataFrame([(k, i, w) for i, (k, ws) in enumerate(words.items()) for w in ws] + [(None, 9, "x"), ("two", 1, "")], "kind string, place int, word string")
    texts = ["Alpha beta b", "beta gamma", "alp", "", None, "zzz", "ALPHA gamma"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lower = {k: sorted({w.lower() for w in ws}) for k, ws in words.items()}
    want = {x["doc_id"]: x["document_type"] for x in classify.classify_documents(d, lower).collect()}
    for part in (100_000, 2):
        assert {x["doc_id"]: x["document_type"] for x in dictionary.keyword_types(d, table, part=part).collect()} == want
    assert {x["document_type"] for x in dictionary.keyword_types(d, table.where("false")).collect()} == {classify.UNKNOWN}
