"""Repeated ids, groups of one source, texts of very many findings, long lists: results stay right and the work in proportion."""

import random
import time

from pyspark.sql import functions as F

from docmill.llm import neardup, packing, secrets, toxicity, urlfilter


def sets_of(text, words):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_components(rows, words=4, percent=80):
    """Component of each doc_id: ids are linked if any of their sets are equal or near; one id's sets belong together."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(sets_of(t or "", words))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_every_text_of_a_repeated_id_is_linked(spark):
    for seed in range(4):
        r = random.Random(seed)
        word = [f"w{i}" for i in range(4000)]
        a, b, c = (r.sample(word, 120) for _ in range(3))

        def near(t, at):
            return " ".join([*t[:at], "other", *t[at + 1 :]])

        rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a, 60)), (8, near(b, 40)), (9, near(a, 20)), (3, " ".join(c)), (12, near(c, 9)), (12, near(b, 90)), (None, " ".join(a)), (20, None), (20, "")]
        rows += [(100 + i, " ".join(r.sample(word, 50))) for i in range(40)] + [(100, " ".join(r.sample(word, 50)))] * 3
        r.shuffle(rows)
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), words=4).collect()
        assert len(out) == len(rows)
        assert {x["doc_id"]: x["component_id"] for x in out if x["doc_id"] is not None} == brute_components(rows)
        assert all(x["kept"] == (x["doc_id"] is None or x["doc_id"] == x["component_id"]) for x in out)


def brute_pack(items, capacity, per_source):
    bins, out = [], []
    for length, source, cluster in items:
        fits = [b for b in range(len(bins)) if bins[b][0] >= length and bins[b][1].count(source) < per_source and (cluster is None or cluster not in bins[b][2])]
        b = min(fits, key=lambda b: (bins[b][0], b), default=len(bins))
        if b == len(bins):
            bins.append([capacity, [], set()])
        out.append((b, capacity - bins[b][0]))
        bins[b][0] -= length
        bins[b][1].append(source)
        if cluster is not None:
            bins[b][2].add(cluster)
    return out


def test_packing_with_frequent_sources_equals_brute_force():
    for seed in range(12):
        r = random.Random(seed)
        sources = r.choice([1, 2, 3, 9, 40])
        items = [(r.randrange(0, 60), min(r.randrange(sources), r.randrange(sources)), r.choice([None, None, None, 0, 1, 2])) for _ in range(400)]
        assert list(packing.pack(items, 100, 2)) == brute_pack(items, 100, 2)


def test_packing_of_one_source_is_fast():
    r = random.Random(1)
    items = sorted(((r.randrange(1, 40), i % 50 == 0, None) for i in range(65_536)), reverse=True, key=lambda x: x[0])
    began = time.perf_counter()
    assert len({b for b, _ in packing.pack([(n, int(s), c) for n, s, c in items], 2048)}) > 30_000
    assert time.perf_counter() - began < 30


def test_many_findings_in_a_text(spark):
    forest = "if(x.f[0] > 0D, 0.9D, 0.1D)"
    n = 100_000
    keys = [f"{i:020x}" for i in range(n)]
    text = " ".join(f"é k{k}" for k in keys)
    began = time.perf_counter()
    found = secrets.find_secrets(spark.createDataFrame([(1, text, "s"), (2, "", "s"), (3, "a " * 10 + "key=" + keys[7] * 2, "s")], "doc_id bigint, text string, source string"), forest)
    rows = {r["doc_id"]: r["findings"] for r in found.select("doc_id", F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["candidate"].alias("candidate"))).alias("findings")).collect()}
    assert time.perf_counter() - began < 120
    assert len(rows[1]) == n and rows[2] == [] and len(rows[3]) == 1
    assert all(text[f["start"] : f["start"] + len(f["candidate"])] == f["candidate"] for f in rows[1])


def test_a_repeated_labelled_id_is_one_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"nasty words {i % 2}") for i in range(500)] + [(i, "kind words here") for i in range(2, 30)] + [(i, "nasty stuff") for i in range(30, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 30)] + [(i, 1) for i in range(30, 60)], "doc_id bigint, toxic int")
    stored = []
    keep = toxicity.store
    monkeypatch.setattr(toxicity, "store", lambda df, name, **k: stored.append((name, df.count())) or keep(df, name, **k))
    toxicity.train(docs, labels)
    assert dict(stored)["toxicity-sample"] == 59


def test_urls_beside_odd_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 1, "b", 2, True), (2, None, 1, "b", 2, True)], "page_id bigint, url string, __listed int, host string, __key int, __here boolean")
    out = urlfilter.judge(pages, pages.where("page_id = 1"))
    assert out.columns == ["page_id", "url", "__listed", "__key", "__here", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in out.orderBy("page_id").collect()] == [(1, "http://a.net/x", 1, 2, True, "a.net", "/x", None, "block"), (2, None, 1, 2, True, "", "", None, "allow")]


def test_a_filter_of_many_parts_is_not_broadcast(spark):
    listed = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = urlfilter.build_filter(listed, "key")
    rows = spark.range(0, 12_000).select(F.concat(F.lit("k"), "id").alias("key"))
    few, many = (urlfilter.mark(rows, "key", bloom, blocks, max_blocks=m) for m in (1 << 16, 8))
    assert blocks > 8 * urlfilter.MAX_PARTS and "Broadcast" not in many._jdf.queryExecution().logical().toString() and "hint" not in many._jdf.queryExecution().logical().toString().lower()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.where("__maybe").count() >= 4000
