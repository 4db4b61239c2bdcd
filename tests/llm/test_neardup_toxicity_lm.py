import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.llm import lmscore, neardup, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def brute(rows, words, percent):
    """Sizes and smallest reachable ids by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups=12, copies=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    rows, shared = [], [word() for _ in range(40)]
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 30, 120]))]
        for _ in range(r.randint(1, copies)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = word()
            if g % 3 == 0:
                t += shared
            text = " ".join(t)
            rows.append(r.choice([text, text.upper() if text.isascii() else text, text.replace(" ", "\n")]))
    rows += ["", None, " \t\n", "one", "ONE", "one two", "x " * 500, "x " * 501]
    ids = list(range(0, 3 * len(rows), 3))
    r.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    rows = corpus(words)
    out = neardup.near_duplicates(docs(spark, rows).withColumn("rep", F.lit("clash")), words=words).collect()
    want = brute(rows, words, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_large_group_is_split(spark, monkeypatch):
    """Nodes over the leaf size at the last level: blocks, hubs, and the comparison of what is left."""
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "HUBS", 2)
    r = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):  # copies at different distances from the base, some linked only by way of others
        t = list(base)
        for k in range(r.choice([0, 1, 1, 2, 3])):
            t[r.randrange(100)] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    far = list(base)
    far[::25] = ["f0", "f1", "f2", "f3"]
    rows.append((60, " ".join(far)))
    out = neardup.near_duplicates(docs(spark, rows), words=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, 4, 80)


def exact_join(texts, words, percent):
    """All links between different sets, by an index of each set's rarest shingles: a pair at the similarity shares one of them."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        s = frozenset(hash(tuple(w[k : k + words])) for k in range(len(w) - words + 1)) or (frozenset([hash(tuple(w))]) if w else frozenset())
        sets.setdefault(s, i)
    sets.pop(frozenset(), None)
    often = Counter(x for s in sets for x in s)
    index, links = {}, set()
    for s, i in sets.items():
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]
        for other in {o for x in rare for o in index.get(x, ())}:
            if 100 * len(s & other) >= percent * len(s | other):
                links.add((i, sets[other]))
        for x in rare:
            index.setdefault(x, []).append(s)
    return sets, links


@pytest.mark.parametrize("words", [4, 5])
def test_all_links_of_a_table_are_found(spark, words):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    _, links = exact_join([tuple(r) for r in table.collect()], words, 80)
    of = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table, words=words).collect()}
    found = sum(of[a] == of[b] for a, b in links)
    assert len(links) > {4: 100, 5: 40}[words] and found == len(links)


def test_texts_that_share_a_passage_come_apart(spark, monkeypatch):
    """Many different texts with one long passage in common make large nodes, but no crowd, and little work."""
    monkeypatch.setattr(neardup, "WIDE", 64)
    r = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(60)])) for i in range(3_000)]  # similarity about 1 / 3
    signed = docs(spark, rows).select("doc_id", "text").mapInArrow(neardup._signatures(4), "doc_id bigint, n_shingles bigint, rep bigint, tokens binary")
    found, crowds = neardup.branch(signed.select("rep", "n_shingles", "tokens"))
    n = found.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("rows"))
    assert n.where("n <> rows or n > 64").count() == 0
    assert n.agg(F.sum("n")).first()[0] < 40 * len(rows) and n.agg(F.sum(F.col("n") * F.col("n"))).first()[0] < 0.1 * len(rows) ** 2 * neardup.TREES
    copies = [(10_000 + i, rows[0][1]) for i in range(3)] + [(20_000 + i, rows[1][1] + f" end{i}") for i in range(200)]
    out = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs(spark, rows + copies), words=4).collect()}
    assert {out[i] for i in range(10_000, 10_003)} == {0} and {out[i] for i in range(20_000, 20_200)} == {1} and out[2] == 2


def test_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, " ".join(f"v{i}" for i in range(60_000))), (4, long[: len(long) // 2])]
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs(spark, rows), words=4).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_of_odd_rows(spark):
    out = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(docs(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (2, None)]), words=4).collect()}
    assert out[None, 3]["component_id"] is None and out[None, 3]["kept"] and out[5, 3]["component_id"] == 5 and out[2, 0]["kept"]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_drop_copies(spark):
    rows = corpus(9) + [(901, "seven words that stand alone right here"), (901, "seven words that stand alone right here"), (None, "z")]
    d = docs(spark, rows)
    kept = sorted(r["doc_id"] for r in neardup.drop_copies(d, neardup.near_duplicates(d)).where("doc_id is not null").collect())
    assert kept == sorted({c for _, c in brute([x for x in rows if x[0] is not None], 5, 80).values()})


@pytest.mark.parametrize("local", [0, 1 << 16])
def test_components_of_a_chain(spark, local):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 100), (300, 100), (100, 100)], "a bigint, b bigint")
    assert {r["id"]: r["label"] for r in neardup.components(links, local).collect()} == {i: 0 for i in range(1, n + 1)} | {200: 100, 300: 100}


# --- toxicity ----------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    b = "/root/testdata/sf0.1/"
    d, labels = spark.read.parquet(b + "documents.parquet"), spark.read.parquet(b + "labels.parquet")
    out = toxicity.score_documents(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = (out.predicted == 1) & (out.toxic == 1)
    assert hit.sum() / (out.toxic == 1).sum() > 0.8 and hit.sum() / (out.predicted == 1).sum() > 0.9  # one label in 15 here is noise
    assert ((out.score >= 0) & (out.score <= 1)).all()


def test_toxicity_of_odd_rows(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "x" * 200_000), (4, "nice day"), (4, "nice day"), (None, "hm")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_documents(d.withColumn("score", F.lit(9)), labels).collect()
    assert len(out) == 6 and len({r["score"] for r in out}) == 1  # one label only: no features
    assert toxicity.score_documents(docs(spark, []), labels.limit(0)).count() == 0
    m = toxicity.Model(np.full(1 << toxicity.BITS, -1, np.int16), np.zeros(0, np.float32), 0.0)
    assert m.scores(["", None, "\ud800"]).tolist() == [0.5] * 3


def grams(text):
    """The hashed n-grams of a text, letter by letter."""
    m64 = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 31
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 32

    plain = [32 if (c < 48 or 57 < c < 97 or 122 < c < 170) else c for c in map(ord, f" {(text or '').lower()} ")]
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(plain) - n + 1):
            h = sum(mixed(c + 1) * pow(toxicity.BASE, j, 1 << 64) for j, c in enumerate(plain[i : i + n])) + n
            out.add(mixed(h & m64) >> 64 - toxicity.BITS)
    return out


def test_scores_by_brute_force():
    r = np.random.default_rng(2)
    texts = [None, "", "a", "You ARE vile!! vile, vile", "Straße: ärger über 3 Äpfel", "x" * 50, "日本語のテキスト です 日本語", "tab\tnew\nline"]
    known = sorted(set().union(*map(grams, texts)))[::2]
    index = np.full(1 << toxicity.BITS, -1, np.int16)
    index[known] = np.arange(len(known))
    weights = r.normal(0, 0.1, len(known)).astype(np.float32)
    got = toxicity.Model(index, weights, -0.3).scores(texts)
    for t, p in zip(texts, got, strict=True):
        z = -0.3 + sum(float(weights[index[g]]) for g in grams(t) if index[g] >= 0)
        assert p == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_logistic_is_at_its_optimum():
    r = np.random.default_rng(3)
    rows = [np.flatnonzero(r.random(30) < 0.3).astype(np.int16) for _ in range(200)]
    scale = r.normal(0, 1, 30)
    y = (np.array([scale[x].sum() for x in rows]) + r.normal(0, 1, 200) > 0).astype(float)
    w, b = toxicity._logistic(rows, scale, y)
    x = np.zeros((200, 30))
    for i, f in enumerate(rows):
        x[i, f] = scale[f]
    e = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ e / 200 + 0.3 / 200 * w).max() < 1e-4 and abs(e.mean()) < 1e-4


# --- language model ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("min_count", [1, 2])
def test_scores(spark, monkeypatch, order, min_count):
    monkeypatch.setattr(lmscore, "BUCKET_WORDS", 500)
    monkeypatch.setattr(lmscore, "BLOCK_WORDS", 700)
    r = random.Random(order)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=r.choice([0, 1, 2, 30]))) for _ in range(150)] + [None, "", " \n", "W1 w1\tw1", "é É", "w0 " * 3000]
    r.shuffle(texts)
    want = lmscore.brute_force(texts, order, min_count=min_count)
    for parts in (1, 3):  # no row depends on how the documents lie
        out = {x["doc_id"]: x for x in lmscore.score_documents(docs(spark, list(enumerate(texts))).repartition(parts), order=order, min_count=min_count).collect()}
        assert len(out) == len(texts)
        for i, (n, s) in enumerate(want):
            assert (out[i]["n_words"], out[i]["log_score"], out[i]["score"]) == (n, s, s / n if n else None)


def test_count_tables(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BUCKET_WORDS", 100)
    texts = ["a b a b a", "a b", None, "c", " ".join(f"w{i % 300}" for i in range(900)), "b " * 4000]
    out = lmscore.count_ngrams(docs(spark, list(enumerate(texts))).repartition(3), order=3).collect()
    split = [tuple((t or "").split()) for t in texts]
    for k in (1, 2, 3):
        n = Counter(t[i : i + k] for t in split for i in range(len(t) - k + 1))
        followed = Counter(t[i : i + k] for t in split for i in range(len(t) - k))
        want = sorted((c, followed[g]) for g, c in n.items() if k == 1 or c >= 2)
        mine = [x for x in out if x["order"] == k]
        assert len({x["gram"] for x in mine}) == len(mine)
        assert sorted((x["n"], x["followed"]) for x in mine) == want if k < 3 else sorted(x["n"] for x in mine) == [c for c, _ in want]


def test_scores_of_odd_rows(spark):
    out = lmscore.score_documents(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b")]).withColumn("block", F.lit(1)).withColumn("words", F.lit(1))).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "None"] and len({r["log_score"] for r in out}) == 1
    assert lmscore.score_documents(docs(spark, [])).count() == 0
    assert [r["log_score"] for r in lmscore.score_documents(docs(spark, [(1, None), (2, " ")])).collect()] == [0.0, 0.0]


def test_large_counts():
    """Numbers of n-grams come back whole, also where a corpus has more than 2**40 of one."""
    edges = np.array([0, 2, 3])
    keys = np.array([1, 2, 1], np.uint64)
    n = np.array([2**40 - 1, 3, 2**45 + 300])
    rows = lmscore._rows(np.array([7, 8]), np.array([0, 0]), np.array([2, 1]), [*[lmscore._binary(x, edges) for x in lmscore._packed_keys(keys, edges)], *lmscore._planes(n, edges)])
    out = lmscore._count(1, 2)(pa.Table.from_batches([rows]))
    assert lmscore._numbers(out.slice(1), "abc").tolist() == [2**40 - 1 + n[2], 3, 2**40 - 1 + n[2]]


def test_words_of_batches_without_a_frequent_word_count(spark):
    rare = " ".join(f"w{i}" for i in range(3000))
    for texts in ([rare], ["a b a b a", rare, "a b"]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(len(texts), "doc_id")
        got = {r["doc_id"]: r for r in lmscore.score_documents(df).collect()}
        assert [(got[i]["n_words"], got[i]["log_score"]) for i in range(len(texts))] == lmscore.brute_force(texts)
