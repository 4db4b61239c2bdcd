"""Weighted rendezvous hashing of stable record keys over shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_rows


def _cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from the top 53 bits of a hash of (key, shard): exponential, so the smallest wins in proportion to weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def choose_shard(key: Column, weights: list[float]) -> Column:
    """The shard whose cost is least for ``key`` (ties: the smaller shard). A shard of weight 0 or less gets nothing.

    Another shard added at the end changes no other shard's cost, so keys move only into it; a null key is a key like any
    other, and rows with the same key share a shard.
    """
    costs = [F.struct(_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not costs:
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*costs))["shard"]


def assign_shards(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None, grown: list[float] | None = None, order: list[str] | None = None) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with the weights ``grown``; null without them) and ``slot``, the row's gapless place in its shard.

    ``weights`` defaults to 16 equal shards. Nothing but the key decides the shard, so there is no shuffle before numbering;
    the places come from :func:`number_rows`, in the order of a hash of ``order`` (the key, if not given), which needs no task
    per shard. Rows that agree there may swap places. Repeated rows get places of their own; an
    empty table stays empty; columns of these three names in the input are replaced.
    """
    weights = weights or [1.0] * 16
    df = df.withColumn("shard", choose_shard(F.col(key), weights))
    df = df.withColumn("grown_shard", choose_shard(F.col(key), grown) if grown else F.lit(None).cast("int"))
    return number_rows(df, ["shard"], [F.col(c) for c in order or [key]], "slot")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents by key: size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null text: that of no bytes), shard, slot, grown_shard."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    out = assign_shards(rows, "doc_id", [1.0] * shards, [1.0] * (shards + 1), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))
