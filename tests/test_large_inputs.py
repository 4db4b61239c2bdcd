"""What makes queries hold on large tables: rows dealt to many tasks, and steps that are worked out once a row."""

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.plans import views
from docmill.plans.queries import QUERIES, Source

FOLDER = "/root/testdata/sf0.001"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["v_form_lines", "v_fields", "v_truth", "v_pred"])
def test_views_of_small_files_are_dealt_to_many_tasks(spark, name):
    assert Source(spark, FOLDER).v(name).rdd.getNumPartitions() == views.tasks(spark) > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["q_J06_dictionary_match", "q_J07_dictionary_labelish", "q_J07_looks_like_label", "q_FS18_surnames"])
def test_queries_over_customers_are_dealt_to_many_tasks(spark, name):
    assert QUERIES[name](spark, FOLDER).rdd.getNumPartitions() == views.tasks(spark)


def test_inline_fields_work_out_labels_and_values_once(spark):
    shown = plan(QUERIES["q_W03_inline_fields"](spark, FOLDER))
    assert shown.count("geborenam") == 2  # once as what a label holds and once as what holds it: filters do not search again


def test_whole_lines_have_values_only_where_a_label_asks(spark):
    from docmill.operators import mapper

    lines = [(1, 1, "Wohnort:"), (1, 2, "Bonn"), (2, 1, "12.03.1980")]
    df = spark.createDataFrame(lines, "doc_id int, line_no int, text string").withColumns({"doc_type": F.lit("Meldebescheinigung"), "confidence": F.lit(0.9), "x1": F.lit(0.1), "y1": F.col("line_no") * 0.05, "x2": F.lit(0.4), "y2": F.col("line_no") * 0.05 + 0.02})
    read = {(r["doc_id"], r["line_no"]): r for r in mapper.read_lines(df).collect()}
    assert read[1, 2]["whole_text"] == "Bonn" and read[1, 2]["whole_date"] is None and read[2, 1]["whole_date"] is None
    assert ("wohnort", "Bonn", "spatial-below") in {(r["field_name"], r["value"], r["source"]) for r in mapper.map_fields(df).collect()}


def test_word_errors_of_short_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(120))
    pairs = [("", "", 0), ("", "a b", 2), ("a", "b a c", 2), ("x", "b a c", 3), ("a a", "a", 1), ("a b c", "a x c", 1), (long, long + " z", 1), ("z " + long, long, 1), ("b a", "a b", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    assert [r[0] for r in df.select(T.word_levenshtein(F.col("a"), F.col("b"))).collect()] == [n for *_, n in pairs]
    assert plan(df.select(T.word_error_rate(F.col("a"), F.col("b")))).count("split(") == 2  # each text is split once


def test_nearest_in_scope_equals_the_cosines_of_all_pairs(spark):
    from docmill.functions.vectors import cosine
    from docmill.operators.retrieval import nearest_in_scope

    odd = [None, [], [0.0, 0.0], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1e-200, 1e-200], [1e200, 1e200], [None, 1.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [-1.0, 0.5], [1.0, 2.0, 3.0]]
    rows = [(i, i % 2 if i < 40 else None, v) for i, v in enumerate(odd * 3)]
    r = spark.createDataFrame(rows, "id bigint, s int, embedding array<double>")
    q = r.select(F.col("id").alias("query_id"), "s", F.col("embedding").alias("q"))
    got = nearest_in_scope(r, q, ["s"], 3, parts=2)
    plain = q.join(r, "s").select("query_id", "id", cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    best = plain.selectExpr("*", "row_number() over (partition by query_id order by similarity desc, id) as rank").where("rank <= 3")
    shown = lambda df: sorted(str(tuple(x)) for x in df.select("query_id", "id", "similarity", "rank").collect())
    assert shown(got) == shown(best)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # queries and their cells may be many


@pytest.mark.parametrize("name", ["q_O01_knn_in_scope", "q_O01_knn_cosine_top5", "q_O03_knn_postfilter_type", "q_O02_k_values"])
def test_similarities_that_round_alike_are_ranked_by_id(spark, tmp_path, name):
    import duckdb

    from docmill.plans.queries import ORACLE
    from oracle import compare

    near = [(i, [1.0, (60 - i) * 1e-5], 3) for i in range(1, 60)]  # a greater id is nearer to 0, by less than the sixth digit
    spark.createDataFrame([(0, [1.0, 0.0], 3), *near], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    compare(QUERIES[name](spark, str(tmp_path)), connection, ORACLE[name])


def test_rounded_similarities_lose_no_tie_within_a_group(spark):
    from docmill.functions.vectors import cosine
    from docmill.operators.retrieval import nearest_in_scope

    r = spark.range(400).select("id", F.lit(1).alias("s"), F.array(F.lit(1.0), (F.col("id") * 7919 % 400) * 0.005 - 1, F.lit(0.5)).alias("embedding"))
    q = r.where("id % 50 = 0").select(F.col("id").alias("query_id"), "s", F.col("embedding").alias("q"))
    for digits in (1, 3, 6):
        got = nearest_in_scope(r, q, ["s"], 4, parts=3, digits=digits)
        plain = q.join(r, "s").select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), digits).alias("similarity"))
        best = plain.selectExpr("*", "row_number() over (partition by query_id order by similarity desc, id) as rank").where("rank <= 4")
        shown = lambda df: sorted(str(tuple(x)) for x in df.select("query_id", "id", "similarity", "rank").collect())
        assert shown(got) == shown(best)


def test_cells_are_fitted_on_a_bounded_sample(spark, tmp_path):
    from docmill.operators.vector_index import build_index

    v = spark.range(300).select("id", F.array(F.sin(F.col("id")), F.cos(F.col("id") * 3)).alias("embedding"))
    index = build_index(v, f"{tmp_path}/x")
    seen = []
    search = index.search
    index.search = lambda queries, *a: seen.append(queries.count()) or search(queries, *a)
    assert 1 <= index.probes_for(v.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 3, 0.9, sample=20) <= len(index.numbers)
    assert seen == [20]


@pytest.mark.parametrize("name", ["q_S15_plain_lines", "q_FS17_inferred_types"])
def test_lines_are_split_and_squeezed_once(spark, name):
    shown = plan(QUERIES[name](spark, FOLDER))
    assert shown.count("split(") == 1 and shown.count("x{3000}") == (2 if name == "q_S15_plain_lines" else 1)


def test_embeddings_are_held_as_numbers_of_eight_bytes(spark):
    import numpy as np
    import pandas as pd

    from docmill.functions import udfs

    made = []
    original = udfs.pandas_udf
    udfs.pandas_udf = lambda kind: lambda f: made.append(f) or original(kind)(f)
    try:
        udfs.hashed_embedding(F.lit(""))
    finally:
        udfs.pandas_udf = original
    out = made[0](pd.Series(["a b", "", None]))
    assert all(isinstance(v, np.ndarray) and v.nbytes == 384 * 8 for v in out) and [round(float((v * v).sum()), 9) for v in out] == [1.0, 0.0, 0.0]


def test_a_dictionary_goes_to_the_tasks_once_or_not_at_all(spark):
    from docmill.operators import dictionary

    names = spark.range(900).select(F.lit("a").alias("doc_type"), F.col("id").cast("string").alias("field"), F.concat(F.lit("name "), F.col("id") % 90).alias("name"), F.col("id").alias("place"))
    rows = spark.createDataFrame([("my name 17", "a"), ("na", "a"), ("name", "a"), ("me 8", "a"), (None, "a"), ("name 5", "b")], "key string, doc_type string")
    want = {"my name 17": "17", "na": None, "name": "10", "me 8": None, None: None, "name 5": None}
    for part, passes in ((100, 1), (20, 0)):  # 90 distinct names; of 900 rows in parts there were nine passes
        out = dictionary.match_labels(rows, names, line=None, part=part)
        assert {r["key"]: r["field"] for r in out.collect()} == want, part
        assert plan(out).count("MapInArrow") == passes


def test_a_task_sorts_no_more_of_a_larger_table(spark, monkeypatch):
    lines, customers = Source(spark, FOLDER).v("v_form_lines"), Source(spark, FOLDER).t("customer").count()
    before = {tuple(r) for r in lines.collect()}
    monkeypatch.setattr(views, "ROWS_PER_TASK", 4)
    lines = Source(spark, FOLDER).v("v_form_lines")
    assert lines.rdd.getNumPartitions() == -(-customers // 4) > 4 * spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in lines.collect()} == before
    assert QUERIES["q_W02_first_key_wins"](spark, FOLDER).rdd.getNumPartitions() == -(-customers // 4)
