import math
import random
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from docmill.llm import mixing, packing, sharding
from docmill.llm.common import number_rows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


# --- packing -----------------------------------------------------------------------------------------------------------


def brute(items, capacity, per_source):
    """Best fit by looking at every bin: the fullest that takes the item, the oldest of equal ones."""
    bins = []
    for length, source, cluster in items:
        best = None
        for k, b in enumerate(bins):
            ok = b["free"] >= length and b["sources"][source] < per_source and (cluster is None or cluster not in b["clusters"])
            if ok and (best is None or b["free"] < bins[best]["free"]):
                best = k
        if best is None:
            bins.append({"free": capacity, "sources": Counter(), "clusters": set()})
            best = len(bins) - 1
        b = bins[best]
        yield best, capacity - b["free"]
        b["free"] -= length
        b["sources"][source] += 1
        if cluster is not None:
            b["clusters"].add(cluster)


@pytest.mark.parametrize("seed", range(20))
def test_pack_is_best_fit(seed):
    r = random.Random(seed)
    items = [(r.choice([0, 1, r.randint(0, 50), 50]), r.randint(0, 3), r.choice([None, None, r.randint(0, 4)])) for _ in range(200)]
    per = r.randint(1, 3)
    assert list(packing.pack(items, 50, per)) == list(brute(items, 50, per))


def test_pack_documents(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 30, 95]))), "src0" if i % 3 else f"s{i % 5}") for i in range(300)]
    rows += [(1000, None, None), (1001, "", "x"), (1002, "a " * 10_000, "x"), (1003, "same words", "a"), (1004, "Same  WORDS", "b"), (1003, "same words", "a")]
    out = packing.pack_documents(docs(spark, rows), capacity=40, per_source=2, group_rows=64).collect()
    clash = packing.pack_documents(docs(spark, rows).withColumn("bin", F.lit("clash")).withColumn("words", F.lit(9)), capacity=40, per_source=2, group_rows=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, clash))
    source, bins, words = {}, defaultdict(list), Counter()
    for i, t, s in rows:
        source[i] = s
    for p in out:
        bins[p["bin_group"], p["bin"]].append(p)
        words[p["doc_id"]] += p["length"]
    for i, t, _ in rows:
        assert words[i] == len((t or "").split()) * sum(1 for x in rows if x[0] == i)
    for ps in bins.values():
        spans = sorted((p["offset"], p["offset"] + p["length"]) for p in ps)
        assert spans[0][0] >= 0 and spans[-1][1] <= 40 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert max(Counter(source[p["doc_id"]] for p in ps).values()) <= 2
        assert len({p["doc_id"] for p in ps} & {1003, 1004}) < 2


def test_pack_nothing(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_packing_follows_the_mixture(spark):
    rows = [(i, "w " * 20, "abc"[min(i % 10 // 4, 2)]) for i in range(6_000)]  # 4 : 4 : 2, all of one length
    rows += [(6_000 + i, "w " * 20, "c") for i in range(600)]
    table, block = docs(spark, rows), 41 * 4
    of = {i: s for i, _, s in rows}
    mixture = {r["doc_id"]: (r["round"], r["slot"], r["place"]) for r in mixing.mix(table, block=block).collect()}
    groups = defaultdict(list)
    for p in packing.pack_documents(table, capacity=100, group_rows=500, block=block).collect():
        groups[p["bin_group"]].append(p)
    assert len(groups) > 10 and sum(map(len, groups.values())) == len(rows)
    sizes = {s: 41.0 * n + 1 for s, n in Counter(of.values()).items()}
    total = sum(v**0.7 for v in sizes.values())
    end = min(max(mixture[i][1] for i in of if of[i] == s) for s in "abc")  # where the first source ends
    last, met = (-1, -1, -1), 0
    for g in sorted(groups):
        places = sorted(mixture[p["doc_id"]] for p in groups[g])
        assert places[0] > last  # runs of slots, one after another
        last = places[-1]
        firsts = defaultdict(list)
        for p in groups[g]:
            firsts[p["bin"]].append(mixture[p["doc_id"]])
        assert [min(firsts[b]) for b in sorted(firsts)] == sorted(min(x) for x in firsts.values())
        if last[1] < end:
            met += 1
            n, have = last[1] - places[0][1] + 1, Counter(of[p["doc_id"]] for p in groups[g])
            assert all(abs(have[s] / 4 - v**0.7 / total * n) < 2 for s, v in sizes.items())  # a block at either end
    assert met >= 8


# --- mixing ------------------------------------------------------------------------------------------------------------


def expected(rows, weights, block, size):
    """Slots by simulation with fractions, block by block."""
    total = sum(Fraction(w) for w in weights.values())
    done, slots, t = Counter(), {}, 0
    need = {k: sum(size(x) for x in rows if x[2] == k) // block + 1 for k in weights}
    while sum(done.values()) < sum(need.values()):
        open_ = []
        for k in sorted(weights):
            w = Fraction(weights[k]) / total
            if done[k] < need[k] and done[k] / w // 1 <= t:
                open_.append((-(-(done[k] + 1) / w // 1), k))
        if open_:
            _, k = min(open_)
            slots[k, done[k]] = t
            done[k] += 1
        t += 1
    return slots


def test_mix(spark):
    rows = [(i, "x" * (i % 7 * 10), "src0" if i % 3 else ("b" if i % 2 else "a")) for i in range(400)]
    weights = {"src0": 0.5, "a": 0.3, "b": 0.2}
    out = mixing.mix(docs(spark, rows).withColumn("slot", F.lit("clash")), weights, block=100).collect()
    assert sorted(r["doc_id"] for r in out) == [x[0] for x in sorted(rows)]
    slots = expected(rows, weights, 100, lambda x: len(x[1]) + 1)
    assert all(r["slot"] == slots[r["source"], r["block"]] and r["release"] <= r["slot"] < r["deadline"] for r in out)
    for s in weights:
        mine = sorted((r for r in out if r["source"] == s), key=lambda r: (r["block"], r["place"]))
        at = 0
        for r in mine:
            assert r["block"] * 100 + r["place"] == at
            at += len(r["text"]) + 1


def test_tiny_weight_meets_its_share():
    """10 000 slots with a weight of 1e-6: less than one block from the weights given, the tiny one included."""
    weights = [1.0, 1e-6, 0.3337]
    total, done = sum(weights), [0, 0, 0]
    for t, (i, *_) in enumerate(mixing.schedule(weights, [20_000] * 3)):
        if t == 10_000:
            break
        done[i] += 1
        assert all(abs(d - w / total * (t + 1)) < 1 for d, w in zip(done, weights))
    assert done[1] <= 1


def test_large_corpus_has_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 16)
    out = mixing.mix(docs(spark, [(i, "x" * 9, "ab"[i % 4 == 0]) for i in range(800)]), block=10).collect()
    blocks = {(r["source"], r["block"]): r["slot"] for r in out}
    assert len(out) == 800 and len(blocks) <= 18 and len(set(blocks.values())) == len(blocks)


def test_mix_keeps_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "x", "a"), (3, "x", "unlisted"), (3, "x", "unlisted")]
    out = mixing.mix(docs(spark, rows), {"a": 1.0, "absent": 2.0}).collect()
    assert len(out) == 5 and all(r["slot"] is not None for r in out)
    assert {r["round"] for r in out if r["source"] == "a"} == {0} and {r["round"] for r in out if r["source"] != "a"} == {1}
    assert mixing.mix(docs(spark, [])).count() == 0


def test_schedule_meets_unrounded_weights():
    weights = [51.0, 3.0, *[1.0] * 20, 1e-4]  # none a whole number of a 1024th
    total, n = sum(weights), 20_000
    done = [0] * len(weights)
    for t, (i, k, slot, release, deadline) in enumerate(mixing.schedule(weights, [n] * len(weights))):
        if t == n:
            break
        assert slot == t and k == done[i] and release <= slot < deadline
        done[i] += 1
        assert all(abs(d - w / total * (t + 1)) < 1 + 1e-9 for d, w in zip(done, weights))


def test_mix_meets_unrounded_weights(spark):
    rows = [(i, "x" * 9, f"s{i % 20:02}") for i in range(20_000)]
    out = mixing.mix(docs(spark, rows), {f"s{i:02}": 1.0 for i in range(20)}, block=10).select("source", "slot").collect()
    assert sorted(r["slot"] for r in out) == list(range(20_000))
    for s in {r["source"] for r in out}:
        assert all(abs(k - slot / 20) < 1 for k, slot in enumerate(sorted(r["slot"] for r in out if r["source"] == s)))


def test_mix_takes_any_number_of_sources(spark):
    rows = [(i, "x" * (i % 13), f"site{i % 3_000}.org") for i in range(7_000)]
    out = mixing.mix(docs(spark, rows), block=8).select("doc_id", "source", "block", "slot", "release", "deadline").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(7_000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    blocks = {(r["source"], r["block"]): r["slot"] for r in out}
    assert len(set(blocks.values())) == len(blocks)


# --- sharding and numbering --------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, "text %d" % (i % 5), "s") for i in range(2000)] + [(None, None, None), (7, "é", None), (7, "é", None)]
    out = sharding.shard_documents(docs(spark, rows)).collect()
    assert len(out) == 2003 and all(r["grown_shard"] in (r["shard"], 16) for r in out)
    for k in range(16):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(1 for r in out if r["shard"] == k)))
    assert len({r["shard"] for r in out if r["doc_id"] == 7}) == 1
    assert [(r["size"], r["text_crc32"]) for r in out if r["doc_id"] is None] == [(1, 0)]
    import zlib

    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 7} == {(7, zlib.crc32(b"text 2")), (3, zlib.crc32("é".encode()))}
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def rendezvous(key, weights):
    """The shard of least cost, worked out apart from the module."""
    best = []
    for i, w in enumerate(weights):
        h = xxhash.xxh64(struct.pack("<i", i), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
        best.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / w, i))
    return min(best)[1]


def test_shards_by_brute_force(spark):
    weights = [1.0, 2.5, 0.5, 1.0]
    rows = sharding.assign_shards(spark.range(-500, 1_500).withColumnRenamed("id", "doc_id"), weights=weights, grown=[*weights, 1.0]).collect()
    assert all(r["shard"] == rendezvous(r["doc_id"], weights) and r["grown_shard"] == rendezvous(r["doc_id"], [*weights, 1.0]) for r in rows)
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {4} and 0.12 < len(moved) / len(rows) < 0.21  # a sixth of the weight


def test_repeated_keys_and_clashing_columns_of_shards(spark):
    d = docs(spark, [(i % 3, f"t{i}", "s") for i in range(60)])
    for c in ("size", "slot", "shard", "law", "text_crc32", "__h_slot"):
        d = d.withColumn(c, F.lit("clash"))
    out = sharding.shard_documents(d).collect()
    again = sharding.shard_documents(d.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))  # equal keys are ordered by their texts, however they lie
    for k in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))


def test_weighted_shards(spark):
    n = Counter(r["shard"] for r in sharding.assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), weights=[1.0, 3.0, 0.0]).collect())
    assert n[2] == 0 and 0.72 < n[1] / 20_000 < 0.78


def test_number_rows_in_many_cells(spark):
    df = spark.range(5_000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    out = number_rows(df, ["g"], [F.col("id")], "n", per_task=100).collect()
    for g in {r["g"] for r in out}:
        assert sorted(r["n"] for r in out if r["g"] == g) == list(range(sum(1 for r in out if r["g"] == g)))
