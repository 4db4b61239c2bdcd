"""Lines on a page: order, fragments, choice between recognisers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..catalog import HEIGHT_RATIO, MERGE_GAP, MIN_HEIGHT, SPACE_GAP
from .documents import per_document


def reading_order(lines: DataFrame) -> DataFrame:
    """Add ``position`` from 1: by the top edge to two decimals, then the left edge, then line_no."""
    return lines.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("y1", 2), "x1", "line_no")))


def merge_islands(lines: DataFrame) -> DataFrame:
    """Fragments of a visual line as one, set-based: lines of a document in rows of equal rounded centre, cut where the gap to all before exceeds the limit.

    Exact where rows are clearly apart; :func:`merge_fragments` follows the greedy rule in every case.
    """
    rows = lines.withColumn("row", F.round((F.col("y1") + F.col("y2")) / 2, 2))
    w = Window.partitionBy("doc_id", "row").orderBy("x1", "line_no", "text")
    reach = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("cut", F.coalesce((F.col("x1") - reach > MERGE_GAP).cast("int"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("cut").over(w))
    return fuse(rows.withColumn("grp", F.struct("row", "part")))


def fuse(rows: DataFrame) -> DataFrame:
    """One line of each (doc_id, grp): box around, least confidence, texts from left to right with a blank at visible gaps."""
    w = Window.partitionBy("doc_id", "grp").orderBy("x1", "line_no", "text")
    piece = F.when(F.col("x1") - F.lag("x2").over(w) > SPACE_GAP, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("piece", piece)
    parts = F.array_sort(F.collect_list(F.struct("x1", "line_no", "text", "piece")))
    return rows.groupBy("doc_id", "grp").agg(
        F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["piece"]), ""), r"\s+", " ")).alias("text"), F.min("confidence").alias("confidence"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    ).drop("grp")


def _grow(lines: list) -> list[tuple]:
    """Number the groups of one document: each line that is still free starts one and takes what fits it, in the page's order."""
    rows = sorted(lines, key=lambda r: ((r.y1 + r.y2) / 2, r.x1, r.line_no, r.text))
    mid, tall = [(r.y1 + r.y2) / 2 for r in rows], [max(r.y2 - r.y1, MIN_HEIGHT) for r in rows]
    group = [-1] * len(rows)
    for start in range(len(rows)):
        if group[start] >= 0:
            continue
        group[start], reach = start, rows[start].x2
        for i in range(start + 1, len(rows)):
            low, high = sorted((tall[start], tall[i]))
            if group[i] < 0 and abs(mid[i] - mid[start]) <= low / 2 and high / low <= HEIGHT_RATIO and rows[i].x1 - reach <= MERGE_GAP:
                group[i], reach = start, max(reach, rows[i].x2)
    return [(*r, g) for r, g in zip(rows, group, strict=True)]


def merge_fragments(lines: DataFrame) -> DataFrame:
    """Fragments of a visual line as one, by the greedy rule; lines without a box stay as they are."""
    cols = ["doc_id", "line_no", "text", "confidence", "x1", "y1", "x2", "y2"]
    boxed = lines.where("x1 is not null").select(*cols)
    out = fuse(per_document(boxed, _grow, StructType([*boxed.schema.fields, StructField("grp", LongType())])))
    bare = lines.where("x1 is null").select(*cols).withColumn("n", F.lit(1).cast("bigint"))
    return out.unionByName(bare)


def normalise_lines(lines: DataFrame, default: float = 0.85, floor: float | None = None) -> DataFrame:
    """Blank lines go, a missing confidence becomes the default, texts are squeezed; with ``floor``, weaker lines go."""
    from ..functions import text as T

    squeezed = lines.select(*[c for c in lines.columns if c != "text"], F.explode(F.array(T.squeeze(F.col("text")))).alias("text")).select(*lines.columns)
    rows = squeezed.where("text <> ''").withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(default)))))
    return rows if floor is None else rows.where(F.col("confidence") >= floor)


def choose_engine(first: DataFrame, second: DataFrame, least_lines: int = 3, least_confidence: float = 0.55) -> DataFrame:
    """The first recogniser's lines, but the second's for documents where the first found too few or too weak lines and the second at least as many."""
    a = first.groupBy("doc_id").agg(F.count("*").alias("n1"), F.avg("confidence").alias("c1"))
    b = second.groupBy("doc_id").agg(F.count("*").alias("n2"))
    pick = b.join(a, "doc_id", "left").where(((F.coalesce("n1", F.lit(0)) < least_lines) | (F.coalesce("c1", F.lit(0.0)) < least_confidence)) & (F.col("n2") >= F.coalesce("n1", F.lit(0)))).select("doc_id")
    return first.join(pick, "doc_id", "left_anti").unionByName(second.join(pick, "doc_id", "left_semi"))
