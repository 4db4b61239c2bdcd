"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: rows stay where they are, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without it gets a temporary folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="docmill-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark reaches; an older one goes."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder with all in it; whether it was there."""
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = _at(spark, old)
    return fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new))


def children(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified in ms) of the files right in a folder, by name; none if there is no folder."""
    fs, p = _at(spark, path)
    found = fs.listStatus(p) if fs.exists(p) else []
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found if f.isFile())
