"""Stored indexes: vectors by cells, texts by postings; both against the plain scan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import retrieval, text_index, vector_index


def brute(rows, queries, k):
    def cos(a, b):
        if a is None or b is None or None in a or len(a) != len(b) or not a:
            return 0.0
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    out = set()
    for q, v in queries:
        best = sorted((-cos(e, v), i) for i, e in rows)[:k]
        out |= {(q, i, r + 1, round(-s, 9)) for r, (s, i) in enumerate(best)}
    return out


def clustered(n, seed, d=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, d))
    return [[float(x) for x in centres[r.integers(20)] + r.normal(size=d) * 0.35] for _ in range(n)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = list(enumerate(clustered(1500, 1))) + [(3000, None), (3001, [0.0] * 12), (3002, [1.0]), (3003, [])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    return rows, vector_index.build_index(df, f"{tmp_path_factory.mktemp('v')}/index")


def found(df):
    return {(r["query_id"], r["id"], r["rank"], round(r["similarity"], 9) + 0.0) for r in df.collect()}


def test_exact_search_equals_the_scan(spark, vectors):
    rows, index = vectors
    queries = [*enumerate(clustered(25, 2)), (100, [0.0] * 12)]
    df = spark.createDataFrame(queries, "query_id bigint, q array<double>")
    for k in (1, 5):
        assert found(index.search(df, k)) == brute(rows, queries, k)
    assert index.search(df, 0).count() == 0 and index.search(df.where("false"), 5).count() == 0


def test_recall_of_few_cells_and_the_cells_read(spark, vectors):
    rows, index = vectors
    both = [*enumerate(clustered(120, 1))]  # near what is indexed, as seeds are the same
    tune, queries = both[:60], both[60:]
    probe = index.probes_for(spark.createDataFrame(tune, "query_id bigint, q array<double>"), 5, 0.97)
    assert probe < len(index.numbers) / 2
    df = spark.createDataFrame(queries, "query_id bigint, q array<double>")
    got, true = found(index.search(df, 5, probe)), brute(rows, queries, 5)
    assert len({x[:2] for x in got} & {x[:2] for x in true}) >= 0.95 * len(true)
    plan = index.vectors([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r["cell"] for r in index.vectors([1, 2]).select("cell").distinct().collect()} <= {1, 2}


def test_more_vectors(spark, tmp_path):
    rows, more = list(enumerate(clustered(300, 5))), [(1000 + i, [x * 3 + 1 for x in v]) for i, v in enumerate(clustered(100, 6))]
    kind = "id bigint, embedding array<double>"
    index = vector_index.build_index(spark.createDataFrame(rows, kind), f"{tmp_path}/x", cells=9)
    index = index.add(spark.createDataFrame(more + rows[:20], kind))  # what is stored already is left out
    queries = [*enumerate(clustered(10, 7)), *((50 + i, v) for i, (_, v) in enumerate(more[:5]))]
    assert found(index.search(spark.createDataFrame(queries, "query_id bigint, q array<double>"), 4)) == brute(rows + more, queries, 4)
    assert index.version == 2 and sum(index.sizes.values()) == 400


def test_index_of_nothing(spark, tmp_path):
    index = vector_index.build_index(spark.createDataFrame([(1, None)], "id bigint, embedding array<double>"), f"{tmp_path}/x")
    out = index.search(spark.createDataFrame([(1, [1.0])], "query_id bigint, q array<double>"), 3).collect()
    assert [(r["id"], r["similarity"]) for r in out] == [(1, 0.0)]


def texts(n, seed):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma-x", "delta", "über", "omega", "thing", "rare1"]
    return [(i, " ".join(r.choices(words[:7], k=r.randrange(6))) + (" rare1" if i % 97 == 0 else ""), r.randrange(50)) for i in range(n)]


def test_text_index_equals_the_scan(spark, tmp_path, monkeypatch):
    rows = texts(900, 1)
    kind = "id bigint, text string, score bigint"
    d = spark.createDataFrame(rows, kind)
    index = text_index.TextIndex(spark, f"{tmp_path}/t", buckets=8, block=16)
    assert index.search("Alpha", 5).count() == 0
    index.insert(d.where("id < 500"), ["text"], "id", "score").insert(d, ["text"], "id", "score").insert(d, ["text"], "id", "score")
    questions = ["Alpha beta", "gamma-x", "RARE1 thing", "nowhere", "one two", "über delta"]

    def check():
        for q in questions:
            for k in (3, 50):
                want = [tuple(r) for r in retrieval.search(d, ["text"], q, k, "id", "score").select("id", "score").collect()]
                if not retrieval.query_parts(q):
                    continue
                assert [tuple(r) for r in index.search(q, k).collect()] == want, (q, k)

    check()
    assert len(index._generations()) == 2
    index.compact()
    assert len(index._generations()) == 1
    check()
    plan = index.search("Alpha beta", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "IN(token" in plan.replace("In(token", "IN(token")


def test_blocks_hold_the_best_first(spark, tmp_path):
    d = spark.range(1000).select("id", F.lit("same word").alias("text"), (F.col("id") % 300).alias("score"))
    index = text_index.TextIndex(spark, f"{tmp_path}/t", buckets=4, block=64).insert(d, ["text"], "id", "score")
    blocks = index.blocks().where("token = 'same'").orderBy("block").collect()
    assert len(blocks) == 16 and [b["most"] for b in blocks] == sorted((b["most"] for b in blocks), reverse=True)
    assert all(len(b["postings"]) <= 64 for b in blocks) and [p["score"] for b in blocks for p in b["postings"]] == sorted((i % 300 for i in range(1000)), reverse=True)


def test_postings_are_shuffled_once_and_blocks_go_on_from_task_to_task(spark, tmp_path, monkeypatch):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    made = []
    original = text_index.written
    monkeypatch.setattr(text_index, "written", lambda df, name: made.append((name, df)) or original(df, name))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # four tasks share a token
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        d = spark.range(1000).select("id", F.lit("same word").alias("text"), F.when(F.col("id") % 10 > 0, F.col("id") % 300).alias("score"))
        index = text_index.TextIndex(spark, f"{tmp_path}/t", buckets=4, block=64).insert(d, ["text"], "id", "score")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(range(1000), key=lambda i: (i % 10 == 0, -(i % 300) if i % 10 else 0, i))
    rows = index.blocks().where("token = 'same'").collect()
    assert len(rows) > 16 and all(0 < len(r["postings"]) <= 64 for r in rows)
    place = {i: n for n, i in enumerate(want)}
    for r in rows:
        first = place[r["postings"][0]["id"]]
        assert r["block"] == first // 64 and r["most"] == r["postings"][0]["score"]
        assert [p["id"] for p in r["postings"]] == want[first : first + len(r["postings"])]
    assert sorted(p["id"] for r in rows for p in r["postings"]) == list(range(1000))
    pieces = next(df for name, df in made if name == "postings")
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1 and "Join" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in index.search("same", 70).collect()] == want[:70]
