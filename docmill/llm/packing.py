"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import mixing
from .common import store

CAPACITY = 2_048  # words of a bin
PER_SOURCE = 2  # documents of one source in a bin, at most
GROUP_ROWS = 8_192  # rows packed together by one task, about
FREQUENT = 8  # sources with at least 1 / FREQUENT of the rows have lists of bins of their own
CELL_SLOTS = 512  # slots of the mixture whose rows are counted together


def pack(items: list[tuple[int, int, int | None]], capacity: int, per_source: int = PER_SOURCE) -> Iterator[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster) in the order given; lengths are at most ``capacity``.

    Open bins lie in lists ordered by residual space, then age. For an item the search starts at the first residual that
    holds it and goes to the successor until a bin agrees: the item's duplicate cluster must not be in the bin's cluster
    bitmap, and its source not in the last of the bin's ``per_source`` source bitmaps (bitmap i has the sources that the bin
    holds more than i times). That is the tightest bin that may take the item; without one it opens a bin. An item of length
    0 fits anywhere that has no conflict. A cluster of None conflicts with nothing.
    """
    items = list(items)
    shares = Counter(source for _, source, _ in items)
    frequent = sum(1 << s for s, n in shares.items() if n * FREQUENT >= len(items))
    # Open bins by the frequent sources that are in their last bitmap, each list ordered by (residual, bin): a search looks into no
    # list whose bins all hold the item's source too often.
    lists: dict[int, list[tuple[int, int]]] = {}
    sources: list[list[int]] = []
    clusters: list[int] = []
    for length, source, cluster in items:
        s, c = 1 << source, 0 if cluster is None else 1 << cluster
        best, best_key, best_at = (capacity + 1, 0), 0, 0
        for key, order in lists.items():
            if key & s:
                continue
            i = bisect_left(order, (length, -1))
            while i < len(order) and order[i] < best and (clusters[order[i][1]] & c or sources[order[i][1]][-1] & s):
                i += 1
            if i < len(order) and order[i] < best:
                best, best_key, best_at = order[i], key, i
        if best[0] <= capacity:
            residual, b = lists[best_key].pop(best_at)
        else:
            residual, b = capacity, len(clusters)
            sources.append([0] * per_source)
            clusters.append(0)
        clusters[b] |= c
        for level in range(per_source):
            if not sources[b][level] & s:
                sources[b][level] |= s
                break
        insort(lists.setdefault(sources[b][-1] & frequent, []), (residual - length, b))
        yield b, capacity - residual


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def text_cluster(text: Column) -> Column:
    """Documents with the same lower-case words are duplicates; null or blank texts are in no cluster."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.sha2(plain, 256))


def mixture_groups(rows: DataFrame, group_rows: int) -> DataFrame:
    """``bin_group`` of rows with (round, slot): runs of slots, one after another, of about ``group_rows`` rows.

    A slot stays whole; it has the number of the rows before it, divided by ``group_rows``. These numbers come from the totals
    of cells of CELL_SLOTS slots, so no task gets more than one row a cell or one row a slot of a cell.
    """
    slots = rows.groupBy("round", "slot").agg(F.count("*").alias("n")).withColumn("cell", F.expr(f"slot div {CELL_SLOTS}"))
    before = Window.orderBy("round", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = slots.groupBy("round", "cell").agg(F.sum("n").alias("n")).select("round", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("round", "cell").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(cells, ["round", "cell"])
    slots = slots.select("round", "slot", F.expr(f"(base + start) div {int(group_rows)}").alias("bin_group"))
    return rows.join(slots, ["round", "slot"])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS, size: Column | None = None, cluster: Column | None = None, keys: list[str] | None = None, mixed: bool = True, block: int = mixing.BLOCK) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` words and pack these into bins.

    Returns one row a piece: the ``keys`` (doc_id), piece (from 0), start and length in words, ``bin_group``, ``bin`` and
    ``offset`` in the bin. Bins belong to groups of about ``group_rows`` rows, so no task grows with the input, nor with a source
    or a cluster; within a group the longest pieces go first. ``mixed``: groups are consecutive runs of the slots that
    :func:`mixing.mix` gives the rows (blocks of ``block`` characters of the text), ties go by the mixture's order, and the bins
    of a group are numbered by their earliest row in it, so bins read by (``bin_group``, ``bin``) follow the mixture; numbers of
    groups may have gaps. Else rows are dealt to groups by a hash
    of their keys, words and cluster, so that null and repeated keys are no group, and ties go by these, then piece. No two pieces of a bin have the same duplicate ``cluster`` (default: equal words) and no more than
    ``per_source`` the same source; pieces of one document conflict only if others share its cluster. Documents without words have one piece of length 0. A null source is a source of its own;
    repeated rows are packed each.
    """
    keys = keys or ["doc_id"]
    size = word_count(F.col("text")) if size is None else size
    cluster = text_cluster(F.col("text")) if cluster is None else cluster
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    columns = [*keys, size.cast("bigint").alias("words"), source.alias("source"), cluster.cast("string").alias("cluster")]
    if mixed:
        rows = docs.select(*columns, (F.length(F.coalesce(F.col("text"), F.lit(""))) + 1).alias("chars"))
        # The mixture reads its rows several times; texts are read once.
        rows = mixture_groups(mixing.mix(store(rows, "packing"), size=F.col("chars"), block=block, order=keys), group_rows)
        rows, order = rows.select(*keys, "words", "source", "cluster", "round", "slot", "place", "bin_group"), ["round", "slot", "place", *keys]
    else:
        groups = max(1, -(-docs.count() // group_rows))
        rows, order = docs.select(*columns).withColumn("bin_group", F.pmod(F.xxhash64(*keys, "words", "cluster"), F.lit(groups).cast("bigint"))), [*keys, "words", "cluster"]
    kinds = rows.select(*keys).schema.simpleString()[7:-1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", na_position="first").reset_index(drop=True)
        words = pdf["words"].to_numpy()
        pieces = []
        for i, n in enumerate(words.tolist()):
            pieces += [(i, p, min(capacity, n - p * capacity)) for p in range(max(1, -(-n // capacity)))]
        pieces.sort(key=lambda x: -x[2])
        src = pd.factorize(pdf["source"])[0].tolist()
        code = pdf["cluster"]
        shared = code.where(code.map(code.value_counts()).fillna(0) > 1)  # a cluster of one needs no bit
        dup = [None if c < 0 else c for c in pd.factorize(shared)[0].tolist()]
        placed = list(pack([(n, src[i], dup[i]) for i, _, n in pieces], capacity, per_source))
        out = pdf[keys].iloc[[i for i, _, _ in pieces]].reset_index(drop=True)
        out["piece"] = [p for _, p, _ in pieces]
        out["start"] = [p * capacity for _, p, _ in pieces]
        out["length"] = [n for _, _, n in pieces]
        out["bin_group"] = int(pdf["bin_group"].iloc[0])
        number = {}
        if mixed:
            first: dict[int, int] = {}
            for (i, _, _), (b, _) in zip(pieces, placed, strict=True):
                first[b] = min(i, first.get(b, i))
            number = {b: k for k, b in enumerate(sorted(first, key=lambda b: (first[b], b)))}
        out["bin"] = [number.get(b, b) for b, _ in placed]
        out["offset"] = [o for _, o in placed]
        return out

    return rows.groupBy("bin_group").applyInPandas(run, f"{kinds}, piece bigint, start bigint, length bigint, bin_group bigint, bin bigint, offset bigint")
