"""The learned corpus: inserts, deletes, merges, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import written


def new_records(stored: DataFrame, incoming: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Insert or ignore: the incoming rows whose key is not stored yet, one for each key (the first by ``order``, else any)."""
    fresh = incoming.where(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti")
    if not order:
        return fresh.dropDuplicates([key])
    return fresh.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows, but the incoming row where a key occurs in both."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete(stored: DataFrame, key: str, values: list) -> DataFrame:
    return stored.where(~F.col(key).isin(values)) if values else stored


def split_exactly(rows: DataFrame, id_col: str, share: float, seed: str = "0") -> DataFrame:
    """Add ``part`` (``val`` or ``train``): exactly int(n * share) rows in the order of a seeded hash are for validation.

    The hash's cut is found by counting in buckets, so that no task sorts all rows: only the rows of the bucket in which the
    cut lies are ranked.
    """
    rows = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy("__b").agg(F.count("*").alias("n")).orderBy("__b").collect()  # 4096 at most
    want, before = int(sum(r["n"] for r in counts) * share), 0
    cut = "zzz"
    for r in counts:
        if before + r["n"] > want:
            cut = r["__b"]
            break
        before += r["n"]
    edge = rows.where(F.col("__b") == cut).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col))).withColumn("part", F.when(F.col("__r") <= want - before, "val").otherwise("train")).drop("__r")
    rest = rows.where(F.col("__b") != cut).withColumn("part", F.when(F.col("__b") < cut, "val").otherwise("train"))
    return rest.unionByName(edge).drop("__h", "__b")


def first_of_splits(splits: dict[str, DataFrame], n: int, order: str) -> DataFrame:
    """The first ``n`` records of the splits, read one after another in the order given, with the name of each one's ``split``. A
    split after those that suffice is not read."""
    out = None
    for name, rows in splits.items():
        have = rows.count()
        part = (rows if have <= n else rows.orderBy(order).limit(n)).withColumn("split", F.lit(name))
        out, n = part if out is None else out.unionByName(part), n - min(n, have)
        if n <= 0:
            break
    return out


def number_in_order(rows: DataFrame, order: list[str], out: str = "n", group: str | None = None) -> DataFrame:
    """Add ``out``: each row's place from 1 in the order of the columns ``order``, within each ``group`` if one is given.

    Rows are sorted by ranges, each in its own task, and the ranges' sizes (one row a task) give each its first number; so
    neither the table nor a group is one task. A group's numbers are counted from its first one. Rows that agree in all these
    columns may swap places.
    """
    keys = [group, *order] if group else order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = written(placed, "numbered")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a task
    firsts = placed.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    placed = placed.join(F.broadcast(firsts), "__p").withColumn(out, F.col("__first") + F.col("__i") + 1).drop("__p", "__i", "__first")
    if not group:
        return placed
    least = placed.groupBy(F.col(group).alias("__g")).agg(F.min(out).alias("__least"))
    return placed.join(least, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn(out, F.col(out) - F.col("__least") + 1).drop("__g", "__least")


def running_totals(rows: DataFrame, order: list[str], group: str, totals: dict[str, Column]) -> DataFrame:
    """Add, for each name of ``totals``, the sum of its column over the rows of the ``group`` up to this one in the order of the columns ``order``.

    Rows are sorted by ranges; a range's part of a group is summed up in one task, and the sums of the parts before (one row a task
    and group) are added to it. So a group with a third of all rows is many tasks. Null counts as 0. Rows that agree in ``order`` may swap places.
    """
    keys = [group, *order]
    placed = rows.withColumns({f"__x_{n}": F.coalesce(c, F.lit(0)) for n, c in totals.items()}).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    placed = written(placed, "placed")
    upto = Window.partitionBy("__p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a range's part of a group
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a task
    parts = placed.groupBy(group, "__p").agg(*[F.sum(f"__x_{n}").alias(f"__s_{n}") for n in totals])
    parts = parts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in totals])
    out = placed.withColumns({f"__u_{n}": F.sum(f"__x_{n}").over(upto) for n in totals}).join(parts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return out.select(*rows.columns, *[(F.col(f"__u_{n}") + F.col(f"__b_{n}")).alias(n) for n in totals])


def keep_newest(files: DataFrame, by: list[str], order: Column, keep: int) -> DataFrame:
    """Rotation: of each group all but the newest ``keep`` are marked for removal."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(order.desc()))
    return files.withColumn("rank", r).withColumn("remove", F.col("rank") > keep)


def manifest_of_existing(manifest: DataFrame, files: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Manifest rows whose file exists, in order of the key; the first ``n``."""
    rows = manifest.join(files.select(key), key, "left_semi")
    return rows if n is None else rows.orderBy(key).limit(n)


def new_uploads(files: DataFrame) -> DataFrame:
    """One of each (name, size, modified)."""
    return files.dropDuplicates(["name", "size", "modified"])


def record_payload(images: DataFrame) -> DataFrame:
    """(image_id, payload): the record as JSON, its text cut to 2000 characters."""
    return images.select("image_id", F.to_json(F.struct("filename", "label_name", "form_type", "quality_score", F.substring("ocr_text", 1, 2000).alias("ocr_text"))).alias("payload"))


def field_vocabulary(records: DataFrame, fields: str = "fields") -> DataFrame:
    """The distinct keys of all records' maps, in order."""
    return records.select(F.explode(F.map_keys(fields)).alias("field_name")).distinct().orderBy("field_name")


def tagged(fields: Column) -> Column:
    """A map as ``<s_k>v</s_k>`` in order of the keys."""
    items = F.array_sort(F.map_entries(fields))
    return F.array_join(F.transform(items, lambda e: F.concat(F.lit("<s_"), e["key"], F.lit(">"), e["value"], F.lit("</s_"), e["key"], F.lit(">"))), "")
