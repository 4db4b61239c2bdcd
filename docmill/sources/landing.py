"""Uploads one at a time: a streaming source that offers the files of a landing folder in the order of their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, bytes bigint, place bigint"


class LandingReader(SimpleDataSourceStreamReader):
    """An offset is the name of the last file offered and its place from 1. Stored names begin with the time of arrival, so what comes
    later sorts later. Only names and sizes pass here; contents are read by Spark."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _files(self) -> list[tuple[str, str, int]]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        root = root.rstrip("/") + "/"
        files = ((f.path.removeprefix(root), f.size) for f in found if f.type == fs.FileType.File)
        return sorted((f"{self.folder.rstrip('/')}/{name}", name, size) for name, size in files if not any(part.startswith((".", "_")) for part in name.split("/")))

    def initialOffset(self) -> dict:
        return {"name": "", "place": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        later = [f for f in self._files() if f[1] > start["name"]]
        if not later:
            return iter([]), start
        path, name, size = later[0]
        return iter([(path, name, size, start["place"] + 1)]), {"name": name, "place": start["place"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        again = [f for f in self._files() if start["name"] < f[1] <= end["name"]]
        return iter([(path, name, size, start["place"] + i + 1) for i, (path, name, size) in enumerate(again)][: end["place"] - start["place"]])

    def commit(self, end: dict) -> None:
        pass


class LandingFolder(DataSource):
    """``spark.readStream.format("landing").option("path", folder)``: a file a batch, in order of names."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> LandingReader:
        return LandingReader(self.options["path"])


def start_uploads(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], poll: float = 0.1) -> StreamingQuery:
    """Call ``handle`` with each file of ``folder``, as a row (path, name, bytes, place), and the number of its batch, one after another.

    A file is in flight until ``handle`` returns; then its offset is committed and the next one is offered. If ``handle`` fails,
    the query ends, and a later start offers the same file again, under the same batch number. The query goes on until it is stopped.
    """
    spark.dataSource.register(LandingFolder)

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            handle(batch, number)

    return spark.readStream.format("landing").option("path", folder).load().writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(poll * 1000)} milliseconds").start()
