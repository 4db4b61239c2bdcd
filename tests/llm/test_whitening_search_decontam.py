import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import decontam, queries, search, whitening
from docmill.llm.common import MARKS, hash_words
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = "item_id bigint, text string"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_decontamination"])
def test_oracle(spark, connection, name):
    compare(queries.QUERIES[name](spark, FOLDER), connection, queries.ORACLE_SQL[name])


# --- whitening ---------------------------------------------------------------------------------------------------------


def exact_model(vectors):
    """x, n, S and the covariance of x, all exact."""
    width = max(len(v) for v in vectors)
    x = [[math.floor(1024 * float(c)) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(width)] for i in range(width)]
    return n, y, np.array([[float(c) for c in row] for row in cov])


def check_whitening(rows, vectors, components=8):
    n, y, cov = exact_model(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, len(cov))
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    by = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    assert [r["deviation"] for r in by[::k]] == [sum(a * a for a in row) for row in y]
    z = np.array([r["whitened"] for r in by]).reshape(n, k)
    got = np.array([r["explained"] for r in by]).reshape(n, k)
    assert np.allclose(got, values[:k] / np.trace(cov), rtol=1e-9)
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-9 and abs(by[0]["identity_error"]) < 1e-9 and len({r["identity_error"] for r in by}) == 1
    # projections: the covariance of whitened values with the centred vectors is sqrt(e) times the component
    loads = np.array(y, float).T / n @ z / n / np.sqrt(values[:k])
    assert np.allclose(np.linalg.norm(loads, axis=0), 1, atol=1e-9)
    assert np.allclose(cov @ loads, loads * values[:k], atol=1e-9 * values[0])


def test_whitening_against_exact_arithmetic(spark):
    r = random.Random(5)
    vectors = [[r.gauss(0, 1) * (10.0 ** (j % 3)) + 300 for j in range(12)] for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(7)
    check_whitening(whitening.whiten_embeddings(df).collect(), vectors)


def test_whitening_of_wide_and_short_vectors(spark):
    r = random.Random(6)
    vectors = [[r.gauss(0, 1) * 2.0**45, r.gauss(0, 1) * 2.0**44][: 2 - (i % 5 == 0)] for i in range(40)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(3)
    n, y, cov = exact_model(vectors)
    model = whitening.fit(df)
    assert model.n == n and np.allclose(model.covariance, cov, rtol=1e-15)
    rows = sorted(whitening.whiten_embeddings(df).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [r["deviation"] for r in rows[::2]] == [min(2**63 - 1, sum(a * a for a in row)) for row in y]
    assert rows[0]["identity_error"] < 1e-9


def test_gram_is_exact(monkeypatch):
    r = np.random.default_rng(3)
    for top in (2**14, 2**40, 2**62):
        y = r.integers(-top, top, (200, 5))
        g = whitening.Gram(5)
        for part in np.array_split(y, 9):
            g.add(part)
        got = sum(d.astype(object) * (1 << (32 * i)) for i, d in enumerate(g.digits()))
        assert (got == y.astype(object).T @ y.astype(object)).all()
        assert all(np.abs(d).max() < 2**33 for d in g.digits())
    big = y.astype(object) * 2**40
    g = whitening.Gram(5)
    g.add(big)
    assert (sum(d.astype(object) * (1 << (32 * i)) for i, d in enumerate(g.digits())) == big.T @ big).all()


def test_whitening_edges(spark):
    kind = "vec_id bigint, embedding array<float>, component int, row string, v int"
    odd = [(1, None, 1, "a", 1), (2, [1.0, None], 1, "a", 1), (3, [float("nan"), 1.0], 1, "a", 1), (4, [float("inf"), 1.0], 1, "a", 1)]
    assert whitening.whiten_embeddings(spark.createDataFrame(odd, kind)).count() == 0
    assert whitening.whiten_embeddings(spark.createDataFrame([], kind)).count() == 0
    same = whitening.whiten_embeddings(spark.createDataFrame([(1, [1.0, 2.0], 1, "a", 1)] * 3 + odd, kind)).collect()
    assert len(same) == 6 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, 0.0, 0.0)}
    line = whitening.whiten_embeddings(spark.createDataFrame([(None if i == 2 else i, [float(i), 2.0 * i], 1, "a", 1) for i in range(4)], kind)).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: r["component"])] == [False] * 4 + [True] * 4
    assert sum(r["vec_id"] is None for r in line) == 2


# --- lexical search ----------------------------------------------------------------------------------------------------


def words(text):
    return [w.decode() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())] if text else []


def low(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def brute_search(docs, items, k=10):
    bags = [(d, Counter(low(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_words = len(bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // n_words
            s = 0
            for t in set(low(text)):
                if tf := b.get(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in bags) + 1)))
                    s += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=r.randrange(0, 40)))) for i in range(n)]


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 16)
    monkeypatch.setattr(search, "SHARD_DOCS", 50)
    docs = corpus(400, 1) + [(1000 + i, "the same Text É1") for i in range(40)] + [(2000, "x " * 5000), (2001, None), (2002, ""), (2003, "--- !")]
    items = [*[(i, t) for i, t in corpus(30, 2)], (100, "SAME text é1 É1"), (101, None), (102, "..."), (103, "nowhere"), (104, "w0"), (105, "x w1 w2 w3 w4 w5 w6")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, ITEMS)
    got = sorted(tuple(r) for r in search.search_documents(d, b).collect())
    assert got == brute_search(docs, items)
    assert got == sorted(tuple(r) for r in search.search_documents(d.coalesce(1).orderBy(F.desc("doc_id")), b).collect())
    monkeypatch.setattr(search, "QUERY_WORDS", 40)  # several blocks of queries
    assert got == sorted(tuple(r) for r in search.search_documents(d, b).collect())


def test_search_skips_documents(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choices(["and", "of", "the", "in", "a", "b", "c"], k=30)) + (" zebra quagga okapi" if i < 400 else "")) for i in range(20_000)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame([(1, "the zebra and quagga of okapi in")], ITEMS)
    index = search.build_index(d)
    scored = search.search(index, b, stats=True).agg(F.sum("score")).first()[0]
    assert scored < 6_000  # of 20 000, all of which hold terms of the item: after the first windows, only those beyond the pivot
    assert {x["doc_id"] for x in search.search(index, b).collect()} <= set(range(400))


def test_search_edges(spark):
    kind = "doc_id bigint, text string, score int, item int, rank string"
    docs = spark.createDataFrame([(1, "apple pie", 1, 1, ""), (1, "apple pie", 1, 1, ""), (None, "apple pie", 1, 1, ""), (2, None, 1, 1, "")], kind)
    items = spark.createDataFrame([(7, "apple apple", 1), (7, "apple apple", 1), (None, "pie", 2), (8, None, 3)], "item_id bigint, text string, doc_id int")
    rows = sorted(((r["item_id"] is None, r["item_id"] or 0), r["rank"], r["doc_id"]) for r in search.search_documents(docs, items).collect())
    seven = [((False, 7), 1, 1), ((False, 7), 2, 1), ((False, 7), 3, None)]
    assert [r for r in rows if r[0] == (False, 7)] == sorted(seven * 2, key=lambda x: x[1]) and len(rows) == 9
    assert search.search_documents(docs.where("false"), items).count() == 0 and search.search_documents(docs, items.where("false")).count() == 0
    assert search.search_documents(docs.where("doc_id = 2"), items).columns == ["item_id", "rank", "doc_id", "score"]


# --- decontamination ---------------------------------------------------------------------------------------------------


def brute_judge(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, named = low(text), set(), set()
        for item, t in items:
            b = low(t)
            n = min(window, len(b))
            grams = {tuple(b[p : p + n]) for p in range(len(b) - n + 1)} if b else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    named.add(item)
        names = sorted(str(x) for x in named if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted(seed):
    r = random.Random(seed)
    items = [(i, " ".join(f"a{r.randrange(30)}" for _ in range(r.choice([3, 9, 10, 11, 25, 40])))) for i in range(25)]
    items += [(50, items[4][1]), (51, "Zz " * 14), (52, None), (53, "!?"), (None, "only in here are these words that nobody else has at all"), (54, "z9")]
    docs = []
    for i in range(120):
        parts = [" ".join(f"a{r.randrange(30)}" for _ in range(r.randrange(60)))]
        if i % 3 == 0:
            part = r.choice(items[:25])[1].split()
            a = r.randrange(len(part))
            parts += [" ".join(part[a : a + r.randrange(4, 40)]), "tail, " * r.randrange(4)]
        docs.append((i, " ".join(parts)))
    docs += [(200 + i, "x " + items[7][1].upper() + ". y") for i in range(30)] + [(300, "zz-" * 40), (301, None), (302, ""), (303, "z9"), (304, "Only in here are these words that nobody else has at all")]
    return docs, items


def test_contamination_against_brute_force(spark):
    docs, items = planted(1)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, ITEMS)
    want = brute_judge(docs, items)
    for options in ({}, {"size": 25}, {"item_words": 60}, {"size": 40, "item_words": 150}):  # also texts in pieces, items in blocks
        assert sorted((tuple(r) for r in decontam.judge(d, b, **options).collect()), key=str) == want, options
    kept = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    assert kept == {r[0] for r in want if not r[5]}


def test_longest_matches(spark):
    docs, items = planted(2)
    got = set()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, ITEMS)
    for r in decontam.longest_matches(d, b).collect():
        got.add((r["row"]["doc_id"], r["item"], r["item_start"], r["start"], r["length"]))
    want = set()
    for i, text in docs:
        w = low(text)
        for item, t in items:
            v = low(t)
            for p in range(len(v)):
                for a in range(len(w)):
                    if w[a] == v[p] and not (p and a and w[a - 1] == v[p - 1]):
                        n = 0
                        while p + n < len(v) and a + n < len(w) and w[a + n] == v[p + n]:
                            n += 1
                        if n >= min(10, len(v)):
                            want.add((i, None if item is None else str(item), p, a, n))
    assert got == want and max(x[4] for x in got) > 12


def test_suffix_array_is_sorted():
    r = random.Random(4)
    for texts in ([[]], [["a"]], [["a"] * 70, [], ["a"] * 70, ["b", "a"] * 40], [r.choices("abc", k=50) for _ in range(9)] * 3):
        flat = " ".join(w for t in texts for w in t).encode()
        h, _ = hash_words(np.frombuffer(flat, np.uint8), np.array([0, len(flat)]), MARKS)
        s = decontam.Suffixes(h, np.array([len(t) for t in texts]))
        tails = [s.codes[a:].tolist() for a in s.order]
        assert sorted(s.order.tolist()) == list(range(len(s.codes))) and tails == sorted(tails)


def test_contamination_edges(spark):
    kind = "doc_id bigint, text string, row int, hits string, items int, n_words string"
    docs = spark.createDataFrame([(1, "one two three", 1, "", 1, ""), (1, "one two three", 1, "", 1, ""), (None, "Two", 2, "", 1, ""), (3, None, 3, "", 1, "")], kind)
    items = spark.createDataFrame([(5, "two", 1), (5, "THREE", 1), (6, "", 1)], "item_id bigint, text string, words int")
    rows = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.judge(docs, items).collect()))
    assert rows == [(0, 1, 1, 1), (1, 3, 2, 1), (1, 3, 2, 1), (3, 0, 0, 0)]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items).collect()] == [3] and decontam.decontaminate(docs, items).columns == docs.columns
    none = decontam.judge(docs, items.where("false")).collect()
    assert [r["contaminated"] for r in none] == [False] * 4 and none[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontam.judge(docs.where("false"), items).count() == 0
