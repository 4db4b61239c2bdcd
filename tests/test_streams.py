"""Streams: keyed state over restarts, rules that stop a run, control of runs, and one upload in flight."""

import os
import time

import pytest
from pyspark.sql import functions as F

from docmill.sources.landing import start_uploads
from docmill.streaming import ingest
from docmill.streaming.control import RunControl

KIND = "image_id string, doc_id bigint"


def arrive(spark, folder, ids):
    rows = spark.createDataFrame([(None if i is None else f"k{i}", i) for i in ids], KIND)
    rows.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


def stored(spark, target):
    return sorted(r["image_id"] for r in spark.read.parquet(target).select("image_id").collect())


def test_keys_are_stored_once_over_restarts(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    arrive(spark, src, [1, 2, 2, None])
    arrive(spark, src, [2, 3])
    ingest.start_ingest(spark, src, KIND, out, cp, files_per_batch=1)
    assert stored(spark, out) == ["k1", "k2", "k3"]
    arrive(spark, src, [1, 3, 4, 4])
    second = ingest.start_ingest(spark, src, KIND, out, cp, files_per_batch=1)
    assert stored(spark, out) == ["k1", "k2", "k3", "k4"]
    state = second.recentProgress[0]["stateOperators"][0]
    assert state["operatorName"] == "dedupe" and "rocksdb" in " ".join(state["customMetrics"]) and state["numRowsTotal"] == 4
    assert spark.conf.get(ingest.PROVIDER, None) != ingest.ROCKS  # the session is as before


def test_a_batch_that_failed_is_stored_once(spark, tmp_path, monkeypatch):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    arrive(spark, src, [1, 2])
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def breaks(self, path, *a, **k):
        write(self, path, *a, **k)
        raise OSError("after the rows were written, before the commit")

    monkeypatch.setattr(DataFrameWriter, "parquet", breaks)
    with pytest.raises(Exception):
        ingest.start_ingest(spark, src, KIND, out, cp)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert stored(spark, out) == ["k1", "k2"]
    ingest.start_ingest(spark, src, KIND, out, cp)
    assert stored(spark, out) == ["k1", "k2"]


def test_a_batch_reads_no_stored_key(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    arrive(spark, src, range(50))
    ingest.start_ingest(spark, src, KIND, out, cp)
    arrive(spark, src, range(40, 60))
    query = ingest.start_ingest(spark, src, KIND, out, cp)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 20 and len(stored(spark, out)) == 60
    assert "Join" not in query._jsq.explainInternal(False)


def items(spark, folder):
    return spark.readStream.schema("run string, at bigint, is_new boolean").option("maxFilesPerTrigger", 1).parquet(folder)


def test_plateau_stops_a_running_query_and_a_later_start_goes_on(spark, tmp_path):
    src, cp = f"{tmp_path}/in", f"{tmp_path}/cp"
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).select(F.lit("a").alias("run"), F.col("id").alias("at"), (F.col("id") < 23).alias("is_new")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    first = ingest.UntilStop(items(spark, src), cp, window=12, partitions=1)
    assert first.wait(120) == [{"run": "a", "stop_at": 34, "reason": "plateau", "items": 35}]
    second = ingest.UntilStop(items(spark, src), cp, window=12, partitions=1)  # counts anew from the first item that was not read
    assert second.wait(120) == [{"run": "a", "stop_at": 51, "reason": "plateau", "items": 12}]
    assert ingest.UntilStop(items(spark, src), cp, window=12, partitions=1).wait(120) == []


def test_limit_and_time_stop_a_query(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(10).select((F.col("id") % 2).cast("string").alias("run"), F.col("id").alias("at"), F.lit(True).alias("is_new")).coalesce(1).write.parquet(src)
    found = ingest.UntilStop(items(spark, src), f"{tmp_path}/a", limit=3, partitions=1).wait(120)
    assert sorted((x["run"], x["stop_at"], x["reason"], x["items"]) for x in found) == [("0", 6, "limit", 3), ("1", 7, "limit", 3)]
    live = ingest.UntilStop(items(spark, src), f"{tmp_path}/b", drain=False, max_seconds=2, partitions=1)
    found = live.wait(120)
    assert found and {x["reason"] for x in found} == {"seconds"} and not live.query.isActive


def rate(spark, cp):
    return lambda: spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.format("noop").option("checkpointLocation", cp).trigger(processingTime="200 milliseconds").start()


def until(condition, seconds=60):
    end = time.monotonic() + seconds
    while not condition():
        assert time.monotonic() < end
        time.sleep(0.1)


def test_run_control(spark, tmp_path):
    here, there = (RunControl(spark, str(tmp_path), interval=0.1, keep=3) for _ in range(2))
    assert here.interval == 0.25 and here.status()["state"] == "idle" and here.stop()["state"] == "idle"
    assert here.start(rate(spark, f"{tmp_path}/cp"))["started"]
    until(lambda: here.batch >= 5 and here.status()["rows"] > 0)
    assert here.status()["state"] == "running" and len(here.progress()) == 3 and here.progress()[-1]["batch"] == here.batch
    until(lambda: there.status()["rows"] > 0)
    assert there.status()["state"] == "external" and not there.start(rate(spark, f"{tmp_path}/cp"))["started"]
    assert there.stop()["state"] == "external" and here.query.isActive  # another's run is left alone
    assert here.stop()["state"] == "stopped" and not here.query.isActive and there.status()["state"] == "stopped"
    assert there.start(rate(spark, f"{tmp_path}/cp"))["started"] and here.status()["state"] == "external"
    there.stop()
    stale = RunControl(spark, str(tmp_path), fresh_s=0.0)
    there._beat("running")
    assert stale.status()["state"] == "stopped"  # a process that died no longer beats


def test_run_control_of_a_failing_query(spark, tmp_path):
    def fail(batch, number):
        raise ValueError("broken")

    c = RunControl(spark, str(tmp_path), interval=0.25)
    c.start(lambda: spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/cp").start())
    c.wait(60)
    assert c.status()["state"] == "error" and c.status()["error"]


def test_one_upload_in_flight(spark, tmp_path):
    folder, cp, got = tmp_path / "landing", f"{tmp_path}/cp", []
    folder.mkdir()
    for i in (2, 1, 3):
        (folder / f"170000000000000{i}_a.txt").write_text(f"text {i}")
    (folder / "_hidden.txt").write_text("x")

    def handle(file, number):
        path = file.first()["path"]
        content = spark.read.format("binaryFile").load(path).first()["content"]
        if number == 1 and not any(n == "failed" for n, _ in got):
            got.append(("failed", bytes(content).decode()))
            raise ValueError("broken")
        got.append((number, bytes(content).decode()))

    first = start_uploads(spark, str(folder), cp, handle)
    with pytest.raises(Exception):
        first.awaitTermination(60)
    assert got == [(0, "text 1"), ("failed", "text 2")]
    second = start_uploads(spark, str(folder), cp, handle)
    until(lambda: len(got) >= 4)
    (folder / "1700000000000004_b.txt").write_text("text 4")
    until(lambda: len(got) >= 5)
    second.stop()
    assert got == [(0, "text 1"), ("failed", "text 2"), (1, "text 2"), (2, "text 3"), (3, "text 4")]


def test_batches_and_state_do_not_grow_with_the_files_of_the_documents(spark, tmp_path):
    from docmill.plans import queries_sources
    from docmill.plans.queries import Source

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        root, out = queries_sources._ingest(Source(spark, str(tmp_path)), 1, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out.count() == out.select("image_id").distinct().count() == d.select("text").distinct().count()
    root = root.removeprefix("file:")
    assert len([f for f in os.listdir(f"{root}/in") if f.endswith(".parquet")]) <= queries_sources.FILES_PER_ROUND
    assert len([f for f in os.listdir(f"{root}/checkpoint/state/0") if f.isdigit()]) == spark.sparkContext.defaultParallelism
