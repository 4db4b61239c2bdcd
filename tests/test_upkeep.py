"""Percentiles by selection, copy-on-write tables, rotation by size."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators.selection import exact_percentiles
from docmill.sources import keyed, rotation, workspace


def test_percentiles_equal_the_built_in(spark):
    r = random.Random(1)
    rows = [("a", r.gauss(0, 1)) for _ in range(3000)] + [("b", float(r.randrange(4))) for _ in range(3000)] + [("c", r.choice([1e-300, 1e300, -1e308, 1e308]) * r.random()) for _ in range(900)]
    rows += [("d", 5.0), ("e", None), (None, 1.0), (None, 2.0), (None, 4.0)] + [("f", 2.0 ** r.randrange(-900, 900)) for _ in range(500)] + [("g", -0.0), ("g", 7.25)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p333": 1 / 3, "p100": 1.0}
    want = {x["g"]: tuple(x[n] for n in shares) for x in d.where("v is not null").groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()}
    for cells, small in ((32, 20), (1024, 64)):
        got = {x["g"]: tuple(x[n] for n in shares) for x in exact_percentiles(d, ["g"], "v", shares, cells=cells, small=small).collect()}
        assert got == want, (cells, small)
    whole = exact_percentiles(d.where("g = 'a'"), [], F.col("v") * 2, {"m": 0.5}, cells=64, small=10).collect()
    assert [x["m"] for x in whole] == [d.where("g = 'a'").agg(F.percentile(F.col("v") * 2, 0.5)).first()[0]]
    assert exact_percentiles(d.where("false"), ["g"], "v", shares).count() == 0


def files(table):
    return {f: {p for p, _, _ in workspace.children(table.spark, f"{table.path}/{f}")} for f in table.manifest()["folders"].values()}


def content(df):
    return {(r["id"], r["v"]) for r in df.collect()}


def test_keyed_table_rewrites_what_it_touches(spark, tmp_path):
    rows = spark.range(200).select("id", F.lit("old").alias("v"))
    t = keyed.KeyedTable.create(rows, f"{tmp_path}/t", "id", buckets=16)
    first, before = content(t.read()), files(t)
    assert len(first) == 200 and t.version() == 1
    assert t.upsert(spark.createDataFrame([(3, "new"), (500, "new")], "id bigint, v string")) == 2
    after = files(t)
    touched = {f for f in before if f not in after}
    assert 1 <= len(touched) <= 2 and all(after[f] == before[f] for f in before if f in after) and len(before) - len(touched) == sum(f in before for f in after)
    assert content(t.read()) == (first - {(3, "old")}) | {(3, "new"), (500, "new")}
    assert content(t.read(1)) == first  # a reader of version 1 still sees it
    assert t.delete(spark.createDataFrame([(500,), (7,), (9999,)], "id bigint")) == 2 and t.delete(spark.createDataFrame([(9999,)], "id bigint")) == 0
    assert t.version() == 3 and content(t.find([3, 7, 8])) == {(3, "new"), (8, "old")}
    assert t.vacuum(keep=1) > 0 and len(content(t.read())) == 199
    with pytest.raises(FileNotFoundError):
        t.read(1)


def test_keyed_table_of_two_changes_at_once(spark, tmp_path, monkeypatch):
    t = keyed.KeyedTable.create(spark.range(20).select("id", F.lit("a").alias("v")), f"{tmp_path}/t", "id", buckets=4)
    late = keyed.KeyedTable(spark, f"{tmp_path}/t")
    monkeypatch.setattr(late, "version", lambda: 1)
    t.upsert(spark.createDataFrame([(1, "b")], "id bigint, v string"))
    with pytest.raises(keyed.ConflictError):
        late.upsert(spark.createDataFrame([(1, "c")], "id bigint, v string"))
    assert (1, "b") in content(t.read()) and len(content(t.read())) == 20
    with pytest.raises(keyed.ConflictError):
        keyed.KeyedTable.create(spark.range(1), f"{tmp_path}/t", "id")
    empty = keyed.KeyedTable.create(spark.createDataFrame([(None, "x")], "id bigint, v string"), f"{tmp_path}/e", "id")
    assert content(empty.read()) == set() and empty.upsert(spark.createDataFrame([(1, "y")], "id bigint, v string")) == 2 and content(empty.read()) == {(1, "y")}


def test_rotation_by_size(spark, tmp_path, monkeypatch):
    log, archive = tmp_path / "log", tmp_path / "archive"
    log.mkdir()

    def put(name, lines):
        (log / name).write_text("".join(x + "\n" for x in lines))

    def held():
        return sorted((r["archive"], r["value"]) for r in rotation.read_archives(spark, str(archive)).collect())

    put("a.jsonl", ["1", "2"])
    put("b.jsonl", ["3"])
    assert rotation.rotate(spark, str(log), str(archive), "s1", most=7, keep=2) == {"archived": None, "files": 0, "bytes": 0, "removed": []} and held() == []
    assert rotation.rotate(spark, str(log), str(archive), "s1", most=6, keep=2) == {"archived": "s1", "files": 2, "bytes": 6, "removed": []}
    assert held() == [("s1", "1"), ("s1", "2"), ("s1", "3")] and not list(log.glob("*.jsonl")) and list((archive / "s1").glob("*.gz"))
    put("c.jsonl", ["4444444"])
    monkeypatch.setattr(rotation, "remove", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # archived, but not yet deleted
        rotation.rotate(spark, str(log), str(archive), "s2", most=6, keep=2)
    monkeypatch.undo()
    assert (log / "c.jsonl").exists()
    (archive / "s2x").mkdir()
    (archive / "s2x" / "part-0.gz").write_bytes(b"half")  # broke off while it was written
    put("d.jsonl", ["5555555"])
    assert rotation.rotate(spark, str(log), str(archive), "s3", most=6, keep=2) == {"archived": "s3", "files": 1, "bytes": 8, "removed": ["s1"]}
    assert held() == [("s2", "4444444"), ("s3", "5555555")] and not (archive / "s2x").exists() and not list(log.glob("*.jsonl"))


def test_runs_by_brute_force(spark):
    from docmill.operators import stats

    r = random.Random(9)
    rows = [("hot" if r.random() < 0.7 else r.choice("abcd"), i, r.random() < 0.15, float(r.randrange(5)), float(r.randrange(3))) for i in range(900)] + [("idle", 5000 + i, False, 1.0, 1.0) for i in range(7)]
    d = spark.createDataFrame(rows, "run string, at bigint, is_new boolean, seconds double, score double").repartition(6)
    window, limit, most = 9, 500, 400.0
    stops, plateaus, series = {}, {}, []
    for run in {x[0] for x in rows}:
        n = streak = longest = 0
        elapsed, seen, last, kept = 0.0, None, None, []
        for _, at, is_new, seconds, score in sorted((x for x in rows if x[0] == run), key=lambda x: x[1]):
            n, streak, elapsed = n + 1, 0 if is_new else streak + 1, elapsed + seconds
            longest = max(longest, streak)
            if streak >= window and seen is None:
                seen = at
            reason = "seconds" if elapsed >= most else "limit" if n > limit else "plateau" if streak >= window else None
            if reason and run not in stops:
                stops[run] = (at, reason)
            if score != last:
                kept.append((at, score, score - last if last is not None else 0.0))
            last = score
        plateaus[run] = (seen, longest)
        series += [(run, *x) for x in kept[-48:]]
    assert {x["run"]: (x["stop_at"], x["reason"]) for x in stats.stops(d, most, limit, window).collect()} == stops
    assert {x["run"]: (x["stop_at"], x["longest"]) for x in stats.plateau(d, window).collect()} == plateaus
    assert sorted(tuple(x) for x in stats.score_series(d.select("run", "at", "score")).collect()) == sorted(series)
    assert stats.stops(d).count() == 0 and stats.plateau(d.where("false"), 3).count() == 0
