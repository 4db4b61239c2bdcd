"""Rotation of a log of many files by their size: a compressed archive with a mark of its completion, and removal of old archives."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .workspace import children, exists, read_text, remove, write_text

MOST_BYTES = 50 * 1024 * 1024
KEEP = 10


def files_to_archive(files: list[tuple[str, int, int]], most: int) -> list[str]:
    """Of (path, bytes, modified) the oldest files, as soon as the running total of bytes, newest first, reaches ``most``; none if it doesn't."""
    newest = sorted(files, key=lambda f: (f[2], f[0]), reverse=True)
    totals = list(accumulate(f[1] for f in newest))
    if not totals or totals[-1] < most:
        return []
    return [f[0] for f in newest][::-1]


def rotate(spark: SparkSession, log: str, archive: str, stamp: str, most: int = MOST_BYTES, keep: int = KEEP) -> dict:
    """Archive the files of the folder ``log`` if they have ``most`` bytes or more together, and keep the newest ``keep`` archives.

    The archive ``archive/<stamp>`` has all lines, compressed, in the order of the files. Its list of sources is written after its lines, and is
    what makes it complete: only then the sources are deleted. A rotation that broke off before that leaves a folder without the
    list, which the next one removes; one that broke off afterwards is finished by the next one. So no line is lost or archived
    twice. Returns what was ``archived`` (its name or None), its ``files`` and ``bytes``, and the ``removed`` archives.
    """
    log, archive = log.rstrip("/"), archive.rstrip("/")
    _finish(spark, archive)
    now = children(spark, log)
    chosen = files_to_archive([f for f in now if not f[0].rsplit("/", 1)[1].startswith(("_", "."))], most)
    sizes = {f[0]: f[1] for f in now}
    if chosen:
        rows = spark.read.text(chosen).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"), F.monotonically_increasing_id().alias("i"))
        rows.repartitionByRange("t", "f", "i").sortWithinPartitions("t", "f", "i").select("value").write.option("compression", "gzip").text(f"{archive}/{stamp}")
        write_text(spark, f"{archive}/{stamp}/_SOURCES", json.dumps(chosen))
        _finish(spark, archive)
    complete = sorted(n for n in _archives(spark, archive) if exists(spark, f"{archive}/{n}/_SOURCES"))
    gone = complete[: max(0, len(complete) - keep)]
    for n in gone:
        remove(spark, f"{archive}/{n}")
    return {"archived": stamp if chosen else None, "files": len(chosen), "bytes": sum(sizes[f] for f in chosen), "removed": gone}


def _archives(spark: SparkSession, archive: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def _finish(spark: SparkSession, archive: str) -> None:
    for n in _archives(spark, archive):
        sources = read_text(spark, f"{archive}/{n}/_SOURCES")
        if sources is None:
            remove(spark, f"{archive}/{n}")
        elif not exists(spark, f"{archive}/{n}/_DONE"):
            for f in json.loads(sources):
                remove(spark, f)
            write_text(spark, f"{archive}/{n}/_DONE", "")


def read_archives(spark: SparkSession, archive: str):
    """(archive, value): the lines of all complete archives."""
    names = [n for n in _archives(spark, archive) if exists(spark, f"{archive}/{n}/_SOURCES")]
    if not names:
        return spark.createDataFrame([], "archive string, value string")
    rows = spark.read.text([f"{archive}/{n}" for n in names])
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("archive"), "value")
