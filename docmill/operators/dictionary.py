"""Labels and keywords by dictionaries of any size, which may be tables: one pass of an automaton over each line or text, or, of labels by
a dictionary that is too large for a task, joins of parts of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..catalog import LABELS, UNKNOWN
from ..functions import text as T
from ..functions.automaton import Automaton
from ..sources.workspace import written
from .mapper import _plain

PART = 100_000  # words that go to the tasks together, at most: labels of a larger dictionary are matched by joins, keywords part by part
STARTS = 1 << 17  # hash values of first letters, each with the lengths of the patterns that begin so: the most rows that are broadcast


def label_rows(spark) -> DataFrame:
    """The built-in dictionary as a table (doc_type, field, name, place)."""
    rows = [(t, f, n) for t, fields in LABELS.items() for f, names in fields.items() for n in names]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_type string, field string, name string, place bigint")


class _Labels:
    """The synonyms of one document type, in the order in which they win: longest first, then by place, then the greater field. ``looks``: whether
    lines that look like a label are asked for."""

    def __init__(self, rows: list[tuple[str, int | None, str]], looks: bool) -> None:
        rows = sorted(sorted(rows, key=lambda r: r[2], reverse=True), key=lambda r: (-len(r[0]), r[1] is None, r[1]))
        self.names, self.fields = [r[0] for r in rows], [r[2] for r in rows]
        self.at = {n: i for i, n in enumerate(self.names)}
        self.long = [i for i, n in enumerate(self.names) if len(n) >= 4]
        self.inside = Automaton([self.names[i] for i in self.long])
        self.three = [i for i, n in enumerate(self.names) if looks and len(n) >= 3]
        self.seen = Automaton([self.names[i] for i in self.three])

    def match(self, keys: list[str]) -> list[str | None]:
        """The winner's field for each distinct, not empty key."""
        outer = [k for k in keys if len(k) >= 4]
        first = dict(zip(outer, Automaton(outer).first_texts(self.names[i] for i in self.long), strict=True)) if outer else {}
        out = []
        for k in keys:
            wins = [self.long[first[k]]] if first.get(k, -1) >= 0 else []
            wins += [self.long[i] for i in self.inside.ends(k)]
            if k in self.at and len(k) < 4:
                wins.append(self.at[k])
            out.append(self.fields[min(wins)] if wins else None)
        return out

    def looks(self, key: str) -> bool:
        longest = max((len(self.names[self.three[i]]) for i in self.seen.ends(key)), default=0)
        return longest >= 3 and len(key) <= longest + 4


def _matched(parts: dict[str, _Labels]):
    """Rows (row, key, line, doc_type, field, labelish) with what the dictionary says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, types = (batch.column(i).to_pylist() for i in range(1, 4))
            wanted: dict[str, list[str]] = {}
            for k, t in set(zip(keys, types, strict=True)):
                if k and t in parts:
                    wanted.setdefault(t, []).append(k)
            found = {(k, t): f for t, ks in wanted.items() for k, f in zip(ks, parts[t].match(ks), strict=True)}
            looks = {(x, t): parts[t].looks(x) for x, t in set(zip(lines, types, strict=True)) if x and t in parts}
            field = [found.get(k) for k in zip(keys, types, strict=True)]
            labelish = [looks.get(k, False) for k in zip(lines, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(field, pa.string()), pa.array(labelish, pa.bool_())], names=["row", "key", "line", "doc_type", "field", "labelish"])

    return run


def _begins(doc_type: Column, text: Column, at: Column | int, width: Column) -> Column:
    return F.pmod(F.xxhash64(doc_type, F.substring(text, at, width)), F.lit(STARTS))


def _contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """``texts`` with each part ``part`` of its column ``text`` that may be one of the ``patterns`` of its document type; all those that are, are among
    these. Patterns have four letters or more; their first letters (eight, or four of short ones) say where to cut, and how long."""
    long = F.char_length(pattern) >= 8
    starts = patterns.groupBy(_begins(F.col("doc_type"), F.col(pattern), 1, F.when(long, 8).otherwise(4)).alias("__start")).agg(F.collect_set(F.char_length(pattern)).alias("__lengths"))
    size = F.char_length(text)
    places = texts.where(size >= 4).withColumn("__at", F.explode(F.sequence(F.lit(1), size - 3))).withColumn("__width", F.explode(F.array(F.lit(4), F.lit(8)))).where(F.col("__at") + F.col("__width") <= size + 1)
    places = places.withColumn("__start", _begins(F.col("doc_type"), F.col(text), F.col("__at"), F.col("__width"))).join(F.broadcast(starts), "__start")
    cut = places.withColumn("__size", F.explode("__lengths")).where((F.col("__at") + F.col("__size") <= size + 1) & ((F.col("__size") >= 8) == (F.col("__width") == 8)))
    return cut.withColumn("part", F.substring(F.col(text), F.col("__at"), F.col("__size"))).drop("__start", "__at", "__width", "__size", "__lengths")


def _fields_by_joins(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_type, key, field) of the distinct ``keys`` (doc_type, key) that have a field by distinct ``names`` (doc_type, name, best)."""
    inner, outer = names.where(F.char_length("name") >= 4), keys.where(F.char_length("key") >= 4)
    shorter = _contained(keys, "key", inner, "name").join(inner.withColumnRenamed("name", "part"), ["doc_type", "part"]).select("doc_type", "key", "best")
    longer = _contained(inner, "name", outer, "key").groupBy("doc_type", F.col("part").alias("key")).agg(F.max("best").alias("best")).join(outer, ["doc_type", "key"]).select("doc_type", "key", "best")
    equal = keys.join(names.where(F.char_length("name") < 4).withColumnRenamed("name", "key"), ["doc_type", "key"]).select("doc_type", "key", "best")
    return shorter.unionByName(longer).unionByName(equal).groupBy("doc_type", "key").agg(F.max("best").getField("field").alias("field"))


def _looks_by_joins(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_type, line) of the distinct ``lines`` (doc_type, line) that hold a name of three letters or more and at most four letters beside it."""
    size = F.char_length("line")
    cut = lines.where(size >= 3).withColumn("__size", F.explode(F.sequence(F.greatest(F.lit(3), size - 4), size))).withColumn("__at", F.explode(F.sequence(F.lit(1), size - F.col("__size") + 1)))
    cut = cut.select("doc_type", "line", F.substring(F.col("line"), F.col("__at"), F.col("__size")).alias("name"))
    return cut.join(names.select("doc_type", "name"), ["doc_type", "name"], "left_semi").select("doc_type", "line").distinct()


def match_labels(lines: DataFrame, dictionary: DataFrame, key: str = "key", line: str | None = "text", doc_type: str = "doc_type", part: int = PART) -> DataFrame:
    """Add ``field`` and ``labelish`` to ``lines`` by a dictionary (doc_type, field, name, place), as ``mapper.match_label`` does for its
    ``key`` and ``mapper.looks_like_label`` for its ``line``; without a ``line``, no row looks like a label.

    The longest synonym of the line's document type wins, then the one with the least place, then the greater field. Synonyms under four letters
    must equal the key; others may be contained in it or, from four letters on, contain it. Null keys and types have no field.

    Synonyms that are repeated count once. Up to ``part`` of them go to the tasks as one automaton, in one pass over the lines. Of more,
    none comes to the driver or is held by a task: distinct keys and synonyms are cut where the first letters and the length fit, and joined.
    """
    names = dictionary.where("doc_type is not null and name is not null and field is not null").select(F.col("doc_type").cast("string").alias("doc_type"), F.col("field").cast("string").alias("field"), T.alnum_key(F.col("name")).alias("name"), F.col("place").cast("bigint").alias("place"))
    names = names.where("name <> ''").groupBy("doc_type", "name").agg(F.max(F.struct(F.char_length("name").alias("n"), (-F.col("place")).alias("o"), "field")).alias("best"))
    looked = T.alnum_key(F.col(line)) if line else F.lit(None).cast("string")
    rows = lines.select(F.struct(*lines.columns).alias("row"), T.alnum_key(F.col(key)).alias("key"), looked.alias("line"), F.col(doc_type).cast("string").alias("doc_type"))
    kept = [F.col("row").getField(c).alias(c) for c in lines.columns if c not in ("field", "labelish")]
    held = names.limit(part + 1).collect()
    if len(held) <= part:
        by: dict[str, list] = {}
        for r in held:
            by.setdefault(r["doc_type"], []).append((r["name"], None if r["best"]["o"] is None else -r["best"]["o"], r["best"]["field"]))
        schema = StructType([*rows.schema.fields, StructField("field", StringType()), StructField("labelish", BooleanType())])
        return rows.mapInArrow(_matched({t: _Labels(x, line is not None) for t, x in by.items()}), schema).select(*kept, "field", "labelish")
    names = written(names, "names")
    keys = written(rows.where("key <> '' and doc_type is not null").select("doc_type", "key").distinct(), "keys")
    rows = rows.join(_fields_by_joins(keys, names), ["doc_type", "key"], "left")
    if line:
        looks = _looks_by_joins(rows.where("line <> ''").select("doc_type", "line").distinct(), names).withColumn("labelish", F.lit(True))
        rows = rows.join(looks, ["doc_type", "line"], "left")
    return rows.select(*kept, "field", F.coalesce("labelish", F.lit(False)).alias("labelish") if line else F.lit(False).alias("labelish"))


def keyword_types(docs: DataFrame, keywords: DataFrame, text: str = "text", unknown: str = UNKNOWN, part: int = PART) -> DataFrame:
    """Add ``document_type``: the type of ``keywords`` (kind, place, word) of which a text contains most distinct words, whatever their case;
    ties go to the type with the least place, and ``unknown`` if it contains none. Words come to the tasks ``part`` at a time."""
    words = keywords.where("kind is not null and word <> ''").select("kind", F.lower("word").alias("word"), "place").distinct()
    kinds = [r["kind"] for r in words.groupBy("kind").agg(F.min("place").alias("p")).orderBy("p", "kind").collect()]  # document types, not words
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t"), F.array_repeat(F.lit(0).cast("bigint"), len(kinds)).alias("counts"))
    schema, place = rows.schema, {k: i for i, k in enumerate(kinds)}

    def counted(held: list):
        by: dict[str, set[int]] = {}
        for kind, word in held:
            by.setdefault(word, set()).add(place[kind])
        patterns = sorted(by)
        owners = [sorted(by[p]) for p in patterns]
        automaton = Automaton(patterns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = batch.column(2).to_pylist()
                for c, t in zip(counts, batch.column(1).to_pylist(), strict=True):
                    for i in automaton.found(t):
                        for k in owners[i]:
                            c[k] += 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.list_(pa.int64()))], names=["row", "t", "counts"])

        return run

    held: list = []
    for r in words.select("kind", "word").distinct().toLocalIterator():
        held.append((r["kind"], r["word"]))
        if len(held) == part:
            rows, held = rows.mapInArrow(counted(held), schema), []
    if held:
        rows = rows.mapInArrow(counted(held), schema)
    names = F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<string>")
    most = F.array_max("counts")
    kind = F.when(most > 0, F.element_at(names, F.array_position("counts", most).cast("int"))).otherwise(F.lit(unknown))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "document_type"], kind.alias("document_type"))
