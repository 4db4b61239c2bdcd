"""Readers and writers of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import SCHEMAS


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log; blank and broken lines are skipped."""
    return spark.read.schema(SCHEMAS["audit_log"]).option("mode", "DROPMALFORMED").json(path)


def append_audit(records: DataFrame, path: str) -> None:
    """Append JSON lines, compressed, partitioned by day: rotation is the removal of old days."""
    records.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").option("compression", "gzip").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of images; a file that is no array of objects gives no rows."""
    rows = spark.read.schema(SCHEMAS["manifest"]).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return rows.where("filename is not null")


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Records of JSON lines, broken ones left out; the first ``limit`` by ``order``, if these are given."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if limit is None else (rows.orderBy(order) if order else rows).limit(limit)


def write_extractions(rows: DataFrame, path: str) -> None:
    """Extractions by document type, so that a query on one type reads its folder only."""
    rows.write.mode("append").partitionBy("document_type").parquet(path)


def find_extraction(spark: SparkSession, path: str, extraction_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("extraction_id") == extraction_id)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, document_type, field_name, value) of a JSON object of file names; names with a leading underscore are left out."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<document_type: string, fields: map<string, string>>>", {"mode": "PERMISSIVE"})
    rows = raw.select(F.explode(entries).alias("doc_id", "spec")).where(~F.startswith("doc_id", F.lit("_")))
    return rows.select("doc_id", "spec.document_type", F.explode("spec.fields").alias("field_name", "value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_log(rows: DataFrame, path: str, at: str, line: str) -> None:
    """A log written by many tasks: each line carries its place in the order of ``at``."""
    rows.select(F.col(at).alias("at"), F.col(line).cast("string").alias("value")).write.mode("append").json(path)


def ordered_log_tail(spark: SparkSession, path: str, lines: int = 60, at: str = "bigint") -> DataFrame:
    """(at, value): the last lines of a log that :func:`write_log` wrote, in order; each task keeps the last ones only."""
    rows = spark.read.schema(f"at {at}, value string").json(path)
    return rows.orderBy(F.desc("at")).limit(lines).orderBy("at")


def log_tail(spark: SparkSession, path: str, lines: int = 60) -> DataFrame:
    """The last lines of a log file, in order: the file's lines carry their place, and each task keeps the last ones only."""
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return rows.orderBy(F.desc("at")).limit(lines).orderBy("at")
