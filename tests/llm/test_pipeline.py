from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import mixing, neardup, packing, secrets, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 1").collect()}
    a = corpus_pipeline.drop_toxic(spark, docs, FOLDER).cache()
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    b = corpus_pipeline.drop_near_duplicates(spark, a, FOLDER).cache()
    assert b.columns == docs.columns and {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r in neardup.near_duplicates(a).where("kept").collect()} and b.count() < a.count()
    c = corpus_pipeline.redact_secrets(spark, b, FOLDER).cache()
    assert c.columns == docs.columns and c.count() == b.count() and c.where("n_chars <> length(text)").count() == 0
    found = secrets.find_secrets(b, secrets.train_forest(secrets.labelled_findings(spark)))
    assert c.where("text like '%[SECRET]%'").count() == found.where("exists(findings, x -> x.is_secret)").count()
    d = corpus_pipeline.mix_sources(spark, c, FOLDER)
    order = [r["doc_id"] for r in mixing.mix(c).orderBy("round", "slot", "place").collect()]
    assert d.columns == docs.columns and [r["doc_id"] for r in d.collect()] == order
    e = corpus_pipeline.pack_bins(spark, d, FOLDER)
    assert {r["doc_id"] for r in e.collect()} == set(order)
    got = sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect()))
    assert got == sorted(map(str, packing.pack_documents(c).collect()))


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    key = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa"
    rows = [(1, None), (2, ""), (3, "a b c d e f g h"), (4, "A b c d e f g h"), (None, "x y z"), (None, "x y z"), (5, f'set token = "{key}" now'), (6, "long " * 100_000), (6, "long " * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", None if i == 2 else "s", len(t or "")) for i, t in rows], kind)
    names = ["slot", "round", "block", "place", "release", "deadline", "findings", "size", "position", "rep", "w0", "__w", "words", "cluster", "start"]
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        out = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == names
        assert all(r[c] == c for r in out for c in names)
        ids = sorted(str(r["doc_id"]) for r in out)
        assert ids == (["1", "2", "3", "4", "5", "6", "6", "None", "None"] if name == "toxicity" else ["1", "2", "3", "5", "6", "None", "None"])
        if name in ("secret_scan", "source_mixing"):
            assert [(r["text"], r["n_chars"]) for r in out if r["doc_id"] == 5] == [('set token = "[SECRET]" now', 26)] and [r["text"] for r in out if r["doc_id"] == 1] == [None]
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(r["length"] for r in bins if r["doc_id"] == 6) == 100_000 and len([r for r in bins if r["doc_id"] is None]) == 2


def test_mixture_decides_the_packing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER).cache()
    order = {r["doc_id"]: k for k, r in enumerate(mixing.mix(docs).orderBy("round", "slot", "place").collect())}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(str, got)) != sorted(map(str, packing.pack_documents(docs, mixed=False).collect()))
    first = {}
    for r in got:
        b = r["bin_group"], r["bin"]
        first[b] = min(order[r["doc_id"]], first.get(b, len(order)))
    assert [first[b] for b in sorted(first)] == sorted(first.values())
