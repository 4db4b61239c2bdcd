"""Nearest neighbours, correction recall and text search."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..catalog import TOP_CORRECTIONS
from ..functions import text as T
from ..functions.vectors import cosine


def clamp_k(k: int, most: int = TOP_CORRECTIONS) -> int:
    """At most five; nothing for 0 or less."""
    return max(0, min(k, most))


def nearest(rows: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """The k rows most similar to one vector (ties: by id; none for k of 0 or less): each task keeps k rows, then one merge of those.
    With ``digits``, similarities are rounded first, so that what rounds alike is a tie."""
    q = F.array(*[F.lit(float(x)) for x in query])
    similarity = cosine(F.col(vector), q)
    return rows.withColumn("similarity", similarity if digits is None else F.round(similarity, digits)).orderBy(F.desc("similarity"), id_col).limit(max(0, k))


NEAR = 1 << 22  # similarities that a task holds at once
SURE = 1e-9  # more than what two ways to add up a product may differ by


def _matrix(vectors: list, width: int) -> np.ndarray:
    return np.array(vectors, np.float64).reshape(len(vectors), width)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as :func:`~docmill.functions.vectors.dot` adds."""
    return np.cumsum(x, axis=1)[:, -1]


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero, as SQL does."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits + 0.0  # no -0.0


def _best_of_group(k: int, id_col: str, scope: list[str], digits: int | None):
    """Of a group's rows those that are among the ``k`` nearest of each of its queries: a product of matrices leaves few pairs, whose cosines
    are then added up as :func:`~docmill.functions.vectors.cosine` does."""
    sure = SURE if digits is None else SURE + 10.0**-digits  # what rounds to the k-th similarity or more is looked at

    def units(held: list, widths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(widths == width)
        x = _matrix([held[i] for i in at], width)
        norm = np.sqrt(_sums(x * x))
        plain = np.isfinite(norm) & ((norm > 1e-150) | (norm == 0))
        return at, x, norm, np.where(plain[:, None], x / np.where(norm > 0, norm, 1.0)[:, None], np.nan)

    def width_of(v: list | None) -> int:
        return 0 if v is None or None in v else len(v)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = right.column(id_col).combine_chunks(), left.column("query_id").combine_chunks()
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        vectors, wanted = right.column("embedding").to_pylist(), left.column("q").to_pylist()
        wide, asked_wide = np.array([width_of(v) for v in vectors], np.int64), np.array([width_of(v) for v in wanted], np.int64)
        out_q, out_r, out_s = [], [], []
        for width in sorted(set(asked_wide.tolist())) if len(ids) and k > 0 else []:
            with np.errstate(all="ignore"):
                rows_at, x, norm, unit = units(vectors, wide, width) if width else (np.zeros(0, np.int64), *[np.zeros((0, 0))] * 3)
                queries_at, y, y_norm, y_unit = units(wanted, asked_wide, width) if width else (np.flatnonzero(asked_wide == 0), *[np.zeros((0, 0))] * 3)
                step = max(1, NEAR // len(ids))
                for start in range(0, len(queries_at), step):
                    these = slice(start, start + step)
                    near = np.zeros((len(queries_at[these]), len(ids)))
                    if len(rows_at):
                        found = y_unit[these] @ unit.T
                        near[:, rows_at] = np.where(np.isnan(found), np.inf, found)  # what has no plain product is looked at in any case
                    least = np.partition(near, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(near), -np.inf)
                    for i in range(len(near)):
                        some = np.flatnonzero(near[i] >= least[i] - sure)
                        exact = np.zeros(len(some))
                        if len(rows_at):
                            at = np.searchsorted(rows_at, some)
                            fits = rows_at[np.minimum(at, len(rows_at) - 1)] == some
                            at = at[fits]
                            length = norm[at] * y_norm[start + i]
                            exact[fits] = np.where(length == 0, 0.0, _sums(x[at] * y[start + i]) / np.where(length == 0, 1.0, length))
                        exact = exact if digits is None else _rounded(exact, digits)
                        first = np.lexsort((place[some], -exact, ~np.isnan(exact)))[:k]  # NaN is the greatest, as in Spark
                        out_q.append(np.full(len(first), queries_at[start + i]))
                        out_r.append(some[first])
                        out_s.append(exact[first])
        q, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_r))
        s = np.concatenate(out_s) if out_s else np.zeros(0)
        return pa.table([asked.take(pa.array(q)), *[left.column(c).combine_chunks().take(pa.array(q)) for c in scope], ids.take(pa.array(r)), pa.array(s, pa.float64())], names=["query_id", *scope, id_col, "similarity"])

    return run


def nearest_in_scope(rows: DataFrame, queries: DataFrame, scope: list[str], k: int = TOP_CORRECTIONS, id_col: str = "id", parts: int | Column = 16, digits: int | None = None) -> DataFrame:
    """Filter, then top-k: for each query (query_id, q, scope columns) its k most similar rows of the same scope, as (query_id, scope columns,
    id, similarity, rank). With ``digits``, similarities are rounded first, so that what rounds alike is a tie, which goes by id.

    The rows of a scope are dealt to ``parts`` groups (a number, or a column made of the scope), to each of which the scope's queries go; each
    group keeps k rows a query before these are ranked together. So a scope with a third of all rows is no task, and pairs are no rows.
    """
    parts = F.lit(parts) if isinstance(parts, int) else parts
    some = reduce(and_, [F.col(c).isNotNull() for c in scope], F.lit(True))
    rows = rows.where(some).select(id_col, *scope, "embedding").withColumn("__part", F.pmod(F.xxhash64(id_col), parts).cast("int"))
    asked = queries.where(some).select("query_id", "q", *scope).withColumn("__part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    kinds, id_kind = asked.schema, rows.schema[id_col]
    schema = StructType([kinds["query_id"], *[kinds[c] for c in scope], id_kind, StructField("similarity", DoubleType())])
    found = asked.groupBy(*scope, "__part").cogroup(rows.groupBy(*scope, "__part")).applyInArrow(_best_of_group(max(0, k), id_col, scope, digits), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= max(0, k))


def nearest_then_type(rows: DataFrame, query: list[float], k: int, document_type: str, id_col: str = "id", type_col: str = "form_type", unknown: str = "Unbekannt", digits: int | None = None) -> DataFrame:
    """Top-k (at most five) first, then the rows of the type or of unknown type; all k if that leaves none."""
    top = nearest(rows, query, clamp_k(k), id_col, digits=digits)
    any_fit = F.max(F.col(type_col).isin(document_type, unknown)).over(Window.partitionBy())  # over at most five rows
    return top.withColumn("__any", any_fit).where(F.col(type_col).isin(document_type, unknown) | ~F.col("__any")).drop("__any")


def recall_corrections(fields: DataFrame, corrections: DataFrame, k: int = TOP_CORRECTIONS) -> DataFrame:
    """Add corrected value: of the k corrections of the same field and document type that are most similar (``similarity``,
    else in order of id), the first whose original equals the field's raw text, case and outer blanks apart.

    Without vectors every correction of the scope has the same similarity; the rank is then by id.
    """
    raw = T.strip(F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.col("value")))
    f = fields.withColumn("__raw", F.lower(raw))
    sim = F.col("similarity") if "similarity" in corrections.columns else F.lit(0.0)
    c = corrections.select(F.col("field").alias("field_name"), "doc_type", "id", "original", "corrected", sim.alias("__s"))
    c = c.withColumn("__r", F.row_number().over(Window.partitionBy("field_name", "doc_type").orderBy(F.desc("__s"), "id"))).where(F.col("__r") <= clamp_k(k))
    c = c.select("field_name", "doc_type", F.lower(T.strip(F.col("original"))).alias("__raw"), "corrected", "__r")
    c = c.groupBy("field_name", "doc_type", "__raw").agg(F.min_by("corrected", "__r").alias("recalled"))
    rows = f.join(c, ["field_name", "doc_type", "__raw"], "left").withColumn("recalled", F.when(F.col("__raw") != "", F.col("recalled")))
    return rows.drop("__raw")


def overlay_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """User corrections (doc_id, field_name, corrected) replace values; status becomes CORRECTED, confidence stays. The last by ``at`` counts."""
    c = corrections.groupBy("doc_id", "field_name").agg(F.max_by("corrected", "at").alias("__c"))
    rows = fields.join(c, ["doc_id", "field_name"], "left")
    return rows.withColumn("value", F.coalesce("__c", "value")).withColumn("status", F.when(F.col("__c").isNotNull(), "CORRECTED").otherwise(F.col("status"))).drop("__c")


def valid_corrections(corrections: DataFrame) -> DataFrame:
    """Corrections with a field name and a corrected value."""
    return corrections.where(~T.blank(F.col("field")) & F.col("corrected").isNotNull())


def _tokens(columns: list[str]) -> Column:
    return F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}_]+")


def inverted_index(docs: DataFrame, columns: list[str], id_col: str, keep: list[str] | None = None) -> DataFrame:
    """(token, id): lower-case tokens of the columns, each once a document; with the columns ``keep`` beside."""
    return docs.select(F.col(id_col), *(keep or []), F.explode(F.array_distinct(_tokens(columns))).alias("token")).where("token <> ''")


def query_parts(query: str) -> list[str]:
    """The tokens that a search text stands for: its first eight terms of four or more characters, split as texts are."""
    terms = [t.lower() for t in (re.sub(r"[^\w-]", "", w) for w in query.split()) if len(t) >= 4][:8]
    return sorted({p for t in terms for p in re.split(r"[^\w]+|-", t) if p})


def search(docs: DataFrame, index: DataFrame | list[str], query: str, k: int, id_col: str, score: str, document_type: str | None = None, type_col: str = "form_type") -> DataFrame:
    """Documents that hold any of the query's terms, best ``score`` first (ties: by id); without terms, those of the type.

    ``index`` is a stored :func:`inverted_index`, or the columns to scan: one search reads the texts once, without a shuffle.
    """
    parts = query_parts(query)
    if not parts:
        rows = docs if document_type is None else docs.where(F.col(type_col) == document_type)
    else:
        if isinstance(index, list):
            rows = docs.where(F.arrays_overlap(_tokens(index), F.array(*[F.lit(p) for p in parts])))
        else:
            rows = docs.join(index.where(F.col("token").isin(*parts)).select(id_col).distinct(), id_col)
    return rows.orderBy(F.desc(score), id_col).limit(max(0, k))


