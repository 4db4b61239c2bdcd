"""URL list filter: a blocked Bloom filter passes possible hits to an exact hash join; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, store

WORDS = 8  # 64-bit words of a block; a key sets one bit in each
KEYS_PER_BLOCK = 32  # 16 bits a key
MAX_BLOCKS = 1 << 16  # blocks of one broadcast, at most (4.5 MB); a longer filter is broadcast in several parts
MAX_PARTS = 4  # a filter of more parts is not broadcast, but joined like any other table

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://`` or for null."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return _of(url, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://`` or for null."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return _of(url, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _of(url: Column, value: Column) -> Column:
    return F.when(url.contains("://"), value).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or a port 80 or 443, and the path, at least ``/``; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", ""), F.when(path == "", F.lit("/")).otherwise(path))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint"))


def build_filter(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter of ``listed``, whose keys should be distinct: (block, 8 words of 64 bits), and its number of blocks, which grows with the list."""
    blocks = 1 << max(0, math.ceil(math.log2(max(1, listed.count() / KEYS_PER_BLOCK))))
    ones = [F.bit_or(F.expr(f"shiftleft(1L, __b{i})")).alias(f"__w{i}") for i in range(WORDS)]
    rows = listed.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("__block"), *[b.alias(f"__b{i}") for i, b in enumerate(_bits(F.col(key)))])
    return store(rows.groupBy("__block").agg(*ones), "filter"), blocks


def probe(df: DataFrame, key: str, words: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in the filter that :func:`build_filter` made; null keys never are."""
    return mark(df, key, words, blocks).where("__maybe").drop("__maybe")


def mark(df: DataFrame, key: str, words: DataFrame, blocks: int, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Add boolean ``__maybe``: whether the row's ``key`` may be in the filter that :func:`build_filter` made.

    The filter goes to all tasks in parts of at most ``max_blocks`` blocks, one broadcast join each, in one pass over ``df``. A filter of
    more than MAX_PARTS such parts, whose size has no bound, meets the rows by a shuffle on the block instead, with the same result.
    """
    names = [f"__w{i}" for i in range(WORDS)]
    df = df.withColumn("__at", _block(F.col(key), blocks)).withColumns({w: F.lit(None).cast("bigint") for w in names})
    shuffled = blocks > MAX_PARTS * max_blocks
    for first in [0] if shuffled else range(0, blocks, max_blocks):
        part = words.where(F.col("__block").between(first, first + max_blocks - 1)) if blocks > max_blocks and not shuffled else words
        part = part.select("__block", *[F.col(w).alias(f"{w}_") for w in names])
        df = df.join(part if shuffled else F.broadcast(part), F.col("__at") == F.col("__block"), "left")
        df = df.withColumns({w: F.coalesce(w, f"{w}_") for w in names}).drop("__block", *[f"{w}_" for w in names])
    hit = F.lit(True)
    for w, b in zip(names, _bits(F.col(key)), strict=True):
        hit = hit & (F.call_function("shiftrightunsigned", F.col(w), b).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return df.withColumn("__maybe", F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("__at", *names)


def is_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str, out: str = "listed") -> DataFrame:
    """Add boolean ``out``: whether the row's ``key`` is among ``listed[listed_key]``.

    Rows that the filter rules out skip the join; the others meet the distinct listed keys in a hash or sort-merge join that
    removes the filter's false positives. A null key is never listed; nulls in the list are ignored; repeats count once. The
    list is read once and its distinct keys are stored.
    """
    names = store(listed.select(F.col(listed_key).alias("__listed")).where("__listed is not null").distinct(), "listed")
    probed = mark(df, key, *build_filter(names, "__listed"))
    no = probed.where("not __maybe").withColumn(out, F.lit(False)).drop("__maybe")
    exact = probed.where("__maybe").join(names, F.col(key) == F.col("__listed"), "left")
    return no.unionByName(exact.withColumn(out, F.col("__listed").isNotNull()).drop("__maybe", "__listed"))


def judge(pages: DataFrame, listed: DataFrame, listed_url: str = "url", rules: list[tuple[str, str, str]] | None = None, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict (allow or block) to ``pages``.

    The longest rule that fits decides (ties: the one given first); without one, a listed canonical URL is blocked and any
    other allowed. Listed URLs are canonicalised as the pages' are. A null URL, or one without ``://``, has empty host and
    path, no rule, and is allowed unless the list holds such a URL. Columns of these four names in the input are replaced;
    others pass as they are, whatever they are called. Repeated rows are judged each; an empty table gives none, an empty list blocks nothing.
    """
    rules = RULES if rules is None else rules
    df = pages.select(F.struct(*pages.columns).alias("__page"), F.col(url).cast("string").alias("__u"))
    df = df.withColumn("host", url_host(F.col("__u"))).withColumn("path", url_path(F.col("__u")))
    df = df.withColumn("__key", canonical(F.col("host"), F.col("path"))).drop("__u")
    names = listed.select(F.col(listed_url).alias("__u")).select(canonical(url_host(F.col("__u")), url_path(F.col("__u"))).alias("__name"))
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    df = is_listed(df, "__key", names, "__name", "__here").withColumn("rule", rule)
    df = df.withColumn("verdict", F.coalesce(verdict, F.when(F.col("__here"), "block").otherwise("allow")))
    new = ["host", "path", "rule", "verdict"]
    return df.select(*[F.col("__page").getField(c).alias(c) for c in pages.columns if c not in new], *new)
