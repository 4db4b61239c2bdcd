"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document's set is that of its distinct word shingles. Documents with equal sets form a class, and each set goes on once, under a
64-bit number of its own (``rep``), for the class; the texts of an id that has several are sets of their own, linked by that id. Each set has ``TOKENS`` minwise hashes of its set. A tree branches
recursively: a node picks one or two of the tokens (1 / threshold on average), and a document goes to the child of each picked
token's value; so two documents of similarity s stay together in a branch with probability s at each level. Nodes of at
most ``LEAF`` documents (``WIDE`` from level ``DEPTH`` on) are compared exhaustively on their tokens; larger ones branch again
until they are small, however deep that is: different texts that share a passage come apart level by level. ``TREES`` independent trees bring the expected
recall of a pair at the threshold to 0.99 and more. Pairs whose tokens agree enough are confirmed on the full sets, and links
are closed to components.

Groups of copies of any size never come apart. So from level ``DEPTH`` on, a larger node whose hubs (``HUBS`` members) are near
each other is a *crowd* and branches no more. A crowd, and any node over ``LEAF``, is dealt into blocks that all meet its hubs;
what is not linked to its largest component by then is compared with every member, in pairs of blocks. Within a component no further pair is
needed, so the work on a large group of copies grows with its size, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_PER_BATCH, batches_of, forget, hash_words, mix, runs, small_batches, store, text_buffer
from .urlfilter import build_filter, mark, probe

WORDS = 5
PERCENT = 80
TOKENS = 128
TREES = 10
DEPTH = 3  # levels before large nodes are looked at for crowds
DEEPEST = 32  # a node that is large after so many levels is taken for a crowd, too
LEAF = 64
WIDE = 1_024  # from level DEPTH on, few nodes are left: pairs within those of so many cost less than further levels
HUBS = 16
DENSE = 0.5  # part of the pairs of hubs that are near each other in a crowd, at least
PACK = 512  # documents of a block where a crowd is compared with its rest
LOCAL = 1 << 16  # links that one task may join to components
SLACK = 3.7  # standard deviations of the token agreement that a pair at the threshold may fall short


def shingle_sets(column, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text: runs of ``words`` words, or all words as one if there are fewer; empty without words."""
    h, counts = hash_words(*text_buffer(column))
    factor = [mix(np.array([2 * k + 1], np.uint64))[0] | np.uint64(1) for k in range(words + 1)]
    m = max(0, len(h) - words + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(words):
        rolled += h[k : k + m] * factor[k]
    rolled = mix(rolled)
    at = 0
    for n in counts.tolist():
        if n == 0:
            yield np.zeros(0, np.uint64)
        elif n < words:
            yield mix(np.array([np.bitwise_xor.reduce(mix(h[at : at + n] * factor[:n])) + np.uint64(n)], np.uint64) * factor[words])
        else:
            yield np.unique(rolled[at : at + n - words + 1])
        at += n


_A = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(10_001, 10_001 + TOKENS, dtype=np.uint64))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The upper halves of the least of TOKENS hashes of each (not empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), TOKENS), np.uint32)
    for k in range(TOKENS):
        x = flat * _A[k] + _B[k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = np.minimum.reduceat(x, starts) >> np.uint64(32)
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit number for a set, as a signed one."""
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = list(shingle_sets(part.column(1), words))
                some = [s for s in sets if len(s)]
                tokens = iter(minwise(some)) if some else iter(())
                rows = [(len(s), set_id(s) if len(s) else None, next(tokens).tobytes() if len(s) else None) for s in sets]
                yield pa.record_batch([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "n_shingles", "rep", "tokens"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = list(shingle_sets(part.column(1), words))
                known = [i for i, s in enumerate(sets) if len(s)]
                if known:
                    tokens = minwise([sets[i] for i in known])
                    yield pa.record_batch([pa.array([set_id(sets[i]) for i in known], pa.int64()), pa.array([sets[i].tobytes() for i in known], pa.binary()), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["rep", "members", "tokens"])

    return run


# --- the trees ---------------------------------------------------------------------------------------------------------


def _children(trees: int, percent: int):
    """(rep, node, tokens) to (rep, node): the children that each document of a node goes to; a null node stands for the roots."""
    more = int((100 / percent - 1) * 2**32)  # part of the nodes that pick two tokens

    def pick(rep: np.ndarray, node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seed = mix(node)
        first = (seed % np.uint64(TOKENS)).astype(np.int64)
        second = (first + 1 + ((seed >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
        two = (seed >> np.uint64(32)) < np.uint64(more)
        row = np.arange(len(rep))
        out = []
        for at, pos in ((row, first), (row[two], second[two])):
            value = tokens[at, pos].astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(32))
            out.append((rep[at], mix(node[at] * np.uint64(0x9E3779B97F4A7C15) + mix(value))))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column("rep").to_numpy()
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            if batch.schema.get_field_index("node") >= 0:
                parts = [pick(rep, batch.column("node").to_numpy().view(np.uint64), tokens)]
            else:
                parts = [pick(rep, np.full(len(rep), t + 1, np.uint64), tokens) for t in range(trees)]
            for r, n in parts:
                yield pa.record_batch({"rep": r, "node": n.view(np.int64)})

    return run


def _sizes(members: DataFrame) -> DataFrame:
    h = F.xxhash64("rep")
    return members.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("n > 1")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens in which each of ``a`` agrees with each of ``b``."""
    out = np.empty((len(a), len(b)), np.int32)
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int32)
    return out


def _least(percent: int) -> int:
    p = percent / 100
    return int(np.floor(TOKENS * p - SLACK * np.sqrt(TOKENS * p * (1 - p))))


class _Block:
    """The documents of one block: ids, set sizes, tokens, and, where they have been fetched, full sets and labels."""

    def __init__(self, t: pa.Table) -> None:
        names = t.schema.names
        self.ids = t.column("rep").to_numpy()
        self.tokens = np.frombuffer(b"".join(t.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
        self.sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()] if "members" in names else []
        self.sizes = np.array([len(x) for x in self.sets]) if self.sets else t.column("n_shingles").to_numpy()
        self.labels = t.column("label").to_numpy() if "label" in names else self.ids


def _likely(a: _Block, b: _Block, percent: int) -> np.ndarray:
    """Agreeing tokens of each pair that may be linked, else 0. The sizes alone rule out many pairs."""
    n = _agree(a.tokens, b.tokens)
    sizes = 100 * np.minimum(a.sizes[:, None], b.sizes[None, :]) >= percent * np.maximum(a.sizes[:, None], b.sizes[None, :])
    return np.where((n >= _least(percent)) & sizes, n, 0)


def _linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the similarity."""
    if len(u) < len(v):
        u, v = v, u
    at = np.searchsorted(u, v)
    at[at == len(u)] = 0
    both = int((u[at] == v).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def _find(root: dict, k):
    while root.setdefault(k, k) != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def _dense(percent: int):
    """The large nodes that are crowds, of rows (node, block, rep, n_shingles, tokens) of their hubs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["node"]):
            t = _Block(table)
            pairs = len(t.ids) * (len(t.ids) - 1) // 2
            if (np.triu(_likely(t, t, percent), 1) > 0).sum() >= DENSE * pairs:
                yield pa.record_batch({"node": table.column("node").combine_chunks()[:1]})

    return run


def _groups(percent: int):
    """Of each block: its documents that likely pairs join, as groups (grp, n, rep); grp is a hash of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["node", "block"]):
            t = _Block(table)
            root: dict = {}
            for p, q in zip(*np.nonzero(np.triu(_likely(t, t, percent), 1)), strict=True):
                u, v = _find(root, int(t.ids[p])), _find(root, int(t.ids[q]))
                root[max(u, v)] = min(u, v)
            groups: dict[int, list[int]] = {}
            for k in list(root):
                groups.setdefault(_find(root, k), []).append(k)
            for ids in groups.values():
                if len(ids) > 1:
                    rep = np.sort(np.array(ids, np.int64))
                    h = np.bitwise_xor.reduce(mix(rep.view(np.uint64) + np.uint64(1)))
                    yield pa.record_batch({"grp": np.full(len(rep), h, np.uint64).view(np.int64), "n": np.full(len(rep), len(rep), np.int64), "rep": rep})

    return run


def _within(percent: int):
    """Of each group: (a, b), each document that links join to others, with the smallest id of those. Every likely pair is
    confirmed on the full sets unless the two are joined already, the most similar pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["grp", "n"]):
            t = _Block(table)
            near = np.triu(_likely(t, t, percent), 1)
            p, q = np.nonzero(near)
            root: dict = {}
            for k in np.argsort(-near[p, q], kind="stable"):
                u, v = _find(root, int(t.ids[p[k]])), _find(root, int(t.ids[q[k]]))
                if u != v and _linked(t.sets[p[k]], t.sets[q[k]], percent):
                    root[max(u, v)] = min(u, v)
            links = [(k, r) for k in list(root) if (r := _find(root, k)) != k]
            if links:
                yield pa.record_batch({"a": np.array([x for x, _ in links], np.int64), "b": np.array([x for _, x in links], np.int64)})

    return run


def _across(percent: int):
    """Of a block of a crowd and a part of what it has besides its main component: links (a, b) between labels, one for each
    two that confirmed pairs join and that are not yet joined here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for i in range(batch.num_rows):
                t, r = (_Block(pa.Table.from_struct_array(batch.column(c).slice(i, 1).flatten())) for c in ("rows", "rest"))
                near = _likely(t, r, percent)
                p, q = np.nonzero(near)
                root: dict = {}
                for k in np.argsort(-near[p, q], kind="stable"):
                    u, v = _find(root, int(t.labels[p[k]])), _find(root, int(r.labels[q[k]]))
                    if u != v and _linked(t.sets[p[k]], r.sets[q[k]], percent):
                        root[max(u, v)] = min(u, v)
                        x.append(max(u, v))
                        y.append(min(u, v))
            yield pa.record_batch({"a": np.array(x, np.int64), "b": np.array(y, np.int64)})

    return run


def _block(size: int, n: str = "n"):
    """The block of each member of a node of n: about ``size`` to a block, dealt by hash."""
    return F.when(F.col(n) <= size, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / F.lit(size)))).cast("int")


def _numbers(n: str, size: int):
    """All blocks of a node of n."""
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / F.lit(size)).cast("int") - 1))


def _packed(members: DataFrame, size: int, n: str, block: str, rows: str) -> DataFrame:
    """(main, block, rows): the members of each crowd in blocks, a row a block."""
    return members.withColumn(block, _block(size, n)).groupBy("main", block).agg(F.collect_list(F.struct("rep", "members", "tokens", "label")).alias(rows))


def _by(df: DataFrame, *keys: str) -> DataFrame:
    """Each group's rows one after another in one partition, for :func:`runs`."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


# --- full sets and components ------------------------------------------------------------------------------------------


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, members, tokens) of the sets ``wanted`` (rep, holder), made again from the texts of their holders.

    A Bloom filter keeps all other texts from being read further; what is shuffled is one set for each of ``wanted``.
    """
    bloom, blocks = build_filter(wanted.select("holder").distinct(), "holder")
    some = probe(docs.select("doc_id", "text"), "doc_id", bloom, blocks)
    sets = small_batches(some).mapInArrow(_sets(words), "rep bigint, members binary, tokens binary")
    return store(sets.groupBy("rep").agg(F.first("members").alias("members"), F.first("tokens").alias("tokens")).join(wanted.select("rep"), "rep", "left_semi"), "sets")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of one task."""
    root: dict = {}
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = _find(root, u), _find(root, v)
            root[max(x, y)] = min(x, y)
    found = [(k, r) for k in list(root) if (r := _find(root, k)) != k]
    yield pa.record_batch({"id": np.array([k for k, _ in found], np.int64), "label": np.array([r for _, r in found], np.int64)})


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """(id, label): the smallest id reachable from each id of the links (a, b), by alternating large and small stars.

    A large star hangs the larger neighbours of an id on the smallest; a small star hangs it and its smaller neighbours on
    the smallest. Each round writes its links to the shared folder; the number of rounds grows with the logarithm of the
    longest chain. Nothing but two numbers a round comes to the driver. Up to ``local`` links, counted before, are joined
    by one task instead.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= local:
        return edges.coalesce(1).mapInArrow(_joined, "id bigint, label bigint")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = store(small, "edges")
        forget(edges)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = now


def _hubs(members: DataFrame) -> DataFrame:
    """(node, rep, n): at most HUBS members of each node, chosen by hash."""
    return members.groupBy("node", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(HUBS)).alias("hub")).agg(F.min_by("rep", F.xxhash64("rep")).alias("rep"), F.first("n").alias("n"))


def branch(reps: DataFrame, trees: int = TREES, percent: int = PERCENT) -> tuple[DataFrame, bool]:
    """(node, n, x, lo, hi, rep) of the nodes to compare, and whether some of them are crowds or wide.

    A level's members are (rep, node) only; a node's x, lo and hi tell whether it has the same members as another.
    """
    spark = reps.sparkSession
    kind = "rep bigint, node bigint"
    level, found, crowds, d = reps.mapInArrow(_children(trees, percent), kind), [], False, 0
    held = []
    while True:
        d += 1
        members = store(level.distinct() if d > 1 else level, "members")
        sizes = store(_sizes(members), "nodes")
        held += [members, sizes]
        found.append(members.join(sizes.where(f"n <= {LEAF}"), "node"))
        large = sizes.where(f"n > {LEAF}")
        if large.isEmpty():
            break
        if d >= DEPTH:
            found.append(members.join(large if d >= DEEPEST else large.where(f"n <= {WIDE}"), "node"))
            crowds = True
            large = large.where(f"n > {WIDE}")
            if d >= DEEPEST or large.isEmpty():
                break
            big = members.join(large, "node")
            with batches_of(spark, ROWS_PER_BATCH):
                hubs = _by(_hubs(big).join(reps, "rep").select("node", "rep", "n_shingles", "tokens"), "node")
                dense = store(hubs.mapInArrow(_dense(percent), "node bigint"), "dense")
            found.append(big.join(dense, "node", "left_semi"))
            large = store(large.join(dense, "node", "left_anti"), "nodes")
            held += [dense, large]
            if large.isEmpty():
                break
        big = members.join(large, "node")
        level = big.select("rep", "node").join(reps, "rep").select("rep", "node", "tokens").mapInArrow(_children(trees, percent), kind)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = store(out.select("node", "n", "x", "lo", "hi", "rep"), "found")
    for t in held:
        forget(t)
    return out, crowds


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * shared shingles >= ``percent`` * shingles of either. ``component_id`` is the smallest doc_id
    that links reach; ``kept`` says whether that is the document's own. Texts that are null, empty or without words have no
    shingles and are linked with nothing. Rows with a null doc_id stand for themselves: no component_id, kept. Rows that
    repeat a doc_id are one document: the links of all its texts count, and join what they reach. Extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store(small_batches(docs).mapInArrow(_signatures(words), "doc_id bigint, n_shingles bigint, rep bigint, tokens binary"), "signed")
    known = signed.where("rep is not null and doc_id is not null")
    reps = store(known.groupBy("rep").agg(F.min("doc_id").alias("holder"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")), "reps")
    keys = store(signed.select("doc_id", "n_shingles", "rep"), "keys")
    forget(signed)

    found, crowds = branch(reps, trees, percent)
    # The same group in several trees is compared once.
    one = found.groupBy("n", "x", "lo", "hi").agg(F.min("node").alias("node")).select("node")
    groups = store(found.join(one, "node", "left_semi").select("node", "n", "rep").distinct(), "groups")
    forget(found)

    spark = docs.sparkSession
    members = groups.withColumn("block", _block(LEAF)).select("node", "block", "rep")
    if crowds:  # every block of a crowd meets its hubs
        wide = groups.where(f"n > {LEAF}")
        members = members.unionByName(_hubs(wide).select("node", _numbers("n", LEAF).alias("block"), "rep")).distinct()
    with batches_of(spark, ROWS_PER_BATCH):
        likely = store(_by(members.join(reps, "rep").select("node", "block", "rep", "n_shingles", "tokens"), "node", "block").mapInArrow(_groups(percent), "grp bigint, n bigint, rep bigint").distinct(), "likely")
    ids = likely.select("rep")
    if crowds:
        ids = ids.unionByName(wide.select("rep"))
    wanted = store(ids.distinct().join(reps.select("rep", "holder"), "rep"), "wanted")
    forget(reps)
    sets = full_sets(docs, wanted, words)
    with batches_of(spark, ROWS_PER_BATCH):
        links = store(_by(likely.join(sets, "rep").select("grp", "n", "rep", "members", "tokens"), "grp", "n").mapInArrow(_within(percent), "a bigint, b bigint").distinct(), "links")
    several = keys.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("doc_id", "a")
    own = keys.where("rep is not null").join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    labels = components(links.unionByName(own))
    if crowds:
        labels = _rest_of_crowds(wide, labels, sets, percent)
    forget(sets)

    at = classes_of(keys).join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "first", F.coalesce("label", "rep").alias("label"))
    least = at.groupBy("label").agg(F.min("first").alias("component_id"))
    final = at.join(least, "label").select(F.col("rep").alias("__k"), "component_id")
    out = keys.join(final, F.col("rep") == F.col("__k"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest_of_crowds(wide: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``labels`` after what is not in a crowd's main component has been compared with the whole crowd, block by block.

    Nodes with the same main component, as the trees give them, make one crowd, so that no pair is looked at once a tree. Pairs
    of blocks are dealt by both blocks, so no crowd is one task.
    """
    spark = wide.sparkSession
    at = store(wide.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", F.coalesce("label", "rep").alias("label")), "labelled")
    most = at.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    crowd = store(at.join(most, "node").select("main", "rep", "label").distinct(), "crowd")
    sizes = store(crowd.groupBy("main").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("main")).alias("others")).where("others > 0"), "sizes")
    forget(at)
    if sizes.isEmpty():
        return labels
    full = crowd.join(sizes, "main").join(sets, "rep")
    against = _packed(full, PACK, "n", "block", "rows")
    rest = _packed(full.where("label <> main"), PACK, "others", "other", "rest")
    pairs = sizes.select("main", "others", _numbers("n", PACK).alias("block")).select("main", "block", _numbers("others", PACK).alias("other"))
    met = pairs.join(against, ["main", "block"]).join(rest, ["main", "other"]).select("rows", "rest").repartition(spark.sparkContext.defaultParallelism * 4)
    with batches_of(spark, 1):
        more = store(met.mapInArrow(_across(percent), "a bigint, b bigint").distinct(), "links")
    if more.isEmpty():
        return labels
    moved = components(more).select(F.col("id").alias("__from"), F.col("label").alias("__to"))
    known = labels.unionByName(moved.select(F.col("__from").alias("id"), F.col("__from").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
    return known.join(moved, F.col("label") == F.col("__from"), "left").select("id", F.coalesce("__to", "label").alias("label"))


def classes_of(keys: DataFrame) -> DataFrame:
    """(rep, first): the smallest doc_id of each set."""
    return keys.where("rep is not null and doc_id is not null").groupBy("rep").agg(F.min("doc_id").alias("first"))


def drop_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` kept, one row for each doc_id; rows with a null doc_id all stay.

    Most texts are not shuffled: a Bloom filter finds the rows whose id may be dropped or repeated, and only these meet the
    exact list. Of rows that repeat a kept doc_id one stays, the first by its text.
    """
    each = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    odd = store(each.where("not __kept or __n > 1").select(F.col("doc_id").alias("__id"), "__kept"), "odd")
    bloom, blocks = build_filter(odd, "__id")
    marked = mark(docs, "doc_id", bloom, blocks)
    met = marked.where("__maybe").drop("__maybe").join(odd, F.col("doc_id") == F.col("__id"), "left")
    one = met.where("__id is not null and __kept").select("doc_id", F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))
    one = one.groupBy("doc_id").agg(F.min_by("__row", F.struct("__text")).alias("__row")).select("__row.*")
    return marked.where("not __maybe").select(*docs.columns).unionByName(met.where("__id is null").select(*docs.columns)).unionByName(one.select(*docs.columns))
