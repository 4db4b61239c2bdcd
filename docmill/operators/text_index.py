"""A stored full-text index: postings of each token in blocks of falling score, in folders by a hash of the token.

A search for the best ``k`` documents that hold any of some tokens reads the folders of these tokens only, and of each token the blocks
that hold its best ``k`` documents only: as the score is the document's own, no other can be among the best of all. Inserts add a
generation of blocks; a search merges the generations, ``compact`` makes one of them.

Postings are shuffled once, by ranges, and written as blocks: first with places within their task, then with those within the token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.workspace import exists, remove, written
from .retrieval import _tokens, query_parts

BUCKETS = 64
BLOCK = 1_024


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _cut(block: int):
    """Rows (task, token, score, id), sorted by token, as rows (task, token, at, most, postings) of up to ``block`` postings; ``at`` is the place
    of the first among the task's rows of the token. Holds one batch, and of the batch before what is left of its last block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before = None, 0  # rows of a block that may go on, and its ``at``

        def blocks(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table, int]:
            n, token = rows.num_rows, rows["token"].combine_chunks()
            new = np.append(True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))
            place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
            place[: n if new.sum() == 1 else int(np.flatnonzero(new)[1])] += before
            cuts = np.flatnonzero(place % block == 0)
            ends = np.append(cuts, n) if last else cuts
            at, left = cuts[: len(ends) - 1], int(ends[-1])
            if not len(at):
                return None, rows, before
            firsts, done = rows.take(pa.array(at)), rows.slice(0, left)
            postings = pa.StructArray.from_arrays([done["score"].combine_chunks(), done["id"].combine_chunks()], names=["score", "id"])
            columns = [firsts["task"], firsts["token"], pa.array(place[at], pa.int64()), firsts["score"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings)]
            out = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["task", "token", "at", "most", "postings"])
            return out, rows.slice(left), 0 if last else int(place[left])

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                out, rest, before = blocks(rows if rest is None else pa.concat_tables([rest, rows]), False)
                if out:
                    yield out
        if rest is not None:
            yield blocks(rest, True)[0]

    return run


class TextIndex:
    """The index under ``path``: (bucket, token, block, most, postings), where postings are structs (score, id), best first, and ``most`` is
    the best score of the block. Null scores come last. Where two tasks share a token, a block may lie in two rows of its number."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
        self.spark, self.path, self.buckets, self.block = spark, path.rstrip("/"), buckets, block

    def _generations(self) -> list[int]:
        at, out = 1, []
        while exists(self.spark, f"{self.path}/{at}") or exists(self.spark, f"{self.path}/gone-{at}"):
            if exists(self.spark, f"{self.path}/{at}/_SUCCESS"):
                out.append(at)
            at += 1
        return out

    def blocks(self) -> DataFrame | None:
        """The blocks of all generations that were written to their end."""
        out = None
        for g in self._generations():
            rows = self.spark.read.parquet(f"{self.path}/{g}")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _write(self, postings: DataFrame, generation: int) -> None:
        """(token, id, score) as blocks. A frequent token's postings are sorted and cut by many tasks, each of which has few buckets."""
        order = [_bucket(F.col("token"), self.buckets), F.col("token"), F.desc_nulls_last("score"), F.col("id")]
        placed = postings.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("task"), "token", "score", "id")
        kinds = placed.schema
        pair = StructType([StructField("score", kinds["score"].dataType), StructField("id", kinds["id"].dataType)])
        schema = StructType([StructField("task", IntegerType()), kinds["token"], StructField("at", LongType()), StructField("most", kinds["score"].dataType), StructField("postings", ArrayType(pair))])
        pieces = written(placed.mapInArrow(_cut(self.block), schema).withColumn("n", F.size("postings")), "postings")
        earlier = Window.partitionBy("token").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        firsts = pieces.groupBy("token", "task").agg(F.sum("n").alias("__n")).withColumn("__first", F.sum("__n").over(earlier)).where("__first is not null").drop("__n")  # at most a row a task
        blocks = pieces.join(F.broadcast(firsts), ["token", "task"], "left").withColumn("block", F.expr(f"int((at + coalesce(__first, 0)) div {self.block})"))
        blocks = blocks.select("token", "block", "most", "postings", _bucket(F.col("token"), self.buckets).alias("bucket"))
        blocks.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(f"{self.path}/{generation}")

    def insert(self, docs: DataFrame, columns: list[str], id_col: str, score: str) -> TextIndex:
        """Add the documents whose id the index doesn't hold. Documents without a token aren't held."""
        tokens = F.array_join(F.filter(F.array_distinct(_tokens(columns)), lambda t: t != ""), " ")  # a text, as arrays take twice the room in a shuffle
        new = docs.select(F.col(id_col).alias("id"), F.col(score).alias("score"), tokens.alias("tokens")).where("tokens <> ''")
        if (held := self.ids()) is not None:  # no anti join, which would go before the split and shuffle the texts
            new = new.join(held.select(F.col("id").alias("__held")), F.col("id") == F.col("__held"), "left").where("__held is null").drop("__held")
        new = written(new.dropDuplicates(["id"]), "inserted")
        if new.isEmpty():
            return self
        generations = self._generations()
        self._write(new.select(F.explode(F.split("tokens", " ")).alias("token"), "id", "score"), (generations[-1] if generations else 0) + 1)
        return self

    def ids(self) -> DataFrame | None:
        rows = self.blocks()
        return None if rows is None else rows.select(F.explode("postings").alias("p")).select("p.id").distinct()

    def best(self, tokens: list[str], k: int) -> DataFrame:
        """(id, score) of the best ``k`` documents that hold any of ``tokens`` (ties: by id).

        At most len(tokens) * (k + BLOCK) rows a generation are left to merge, in one task and without a shuffle.
        """
        rows = self.blocks()
        if rows is None or not tokens or k <= 0:
            return self.spark.createDataFrame([], "id bigint, score bigint")
        wanted = sorted(set(tokens))
        folders = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(_bucket(F.col("t"), self.buckets)).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(folders) & F.col("token").isin(wanted) & (F.col("block") * self.block < k))
        found = rows.select(F.explode("postings").alias("p")).select("p.id", "p.score")
        return found.coalesce(1).dropDuplicates(["id"]).orderBy(F.desc("score"), "id").limit(k)

    def search(self, query: str, k: int) -> DataFrame:
        """:meth:`best` for the tokens that a search text stands for."""
        return self.best(query_parts(query), k)

    def compact(self) -> TextIndex:
        """Put all generations into one. The old ones go when the new one is complete; a search that began before may have to be repeated."""
        old = self._generations()
        if len(old) > 1:
            rows = self.blocks().select("token", F.explode("postings").alias("p")).select("token", "p.id", "p.score").dropDuplicates(["token", "id"])
            self._write(rows, old[-1] + 1)
            for g in old:
                self.spark.range(0).write.parquet(f"{self.path}/gone-{g}")
                remove(self.spark, f"{self.path}/{g}")
        return self
