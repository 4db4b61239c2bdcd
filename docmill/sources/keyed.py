"""A keyed table that changes in place: a change rewrites the buckets that it touches, and a manifest says which files are the table.

``path/data/<id>/bucket=<b>`` holds rows, ``path/versions/<n>.json`` what version n consists of: a folder for each bucket. A change
reads the buckets of its keys, writes new folders for these, and then the next manifest, which names the old folders of all other
buckets; their files stay as they are. Readers take one manifest, so they see a version whole, also while the next one is made.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.corpus import upsert
from .workspace import children, exists, read_text, remove, rename, write_text

BUCKETS = 64


class ConflictError(RuntimeError):
    """Another change was committed meanwhile; the table is as that one left it."""


class KeyedTable:
    """Rows with a unique, not null ``key``. The number of buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
        """A new table of ``rows``; of rows that repeat a key any one stays, rows without a key are left out."""
        table = cls(rows.sparkSession, path)
        if table.version():
            raise ConflictError(f"there is a table in {path}")
        table._commit(1, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": {}}, rows.where(F.col(key).isNotNull()).dropDuplicates([key]), [])
        return table

    def version(self) -> int:
        """The number of the last version; 0 without a table."""
        names = [p.rsplit("/", 1)[1] for p, _, _ in children(self.spark, f"{self.path}/versions")]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        text = read_text(self.spark, f"{self.path}/versions/{version or self.version()}.json")
        if text is None:
            raise FileNotFoundError(f"no version {version} of {self.path}")
        return json.loads(text)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in sorted(m["folders"].items()) if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(m["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def find(self, values: list) -> DataFrame:
        """The rows with these keys; only their buckets are read."""
        m = self.manifest()
        keys = self.spark.createDataFrame([(v,) for v in values], StructType([f for f in StructType.fromJson(json.loads(m["schema"])).fields if f.name == m["key"]]))
        return self._rows(m, self._touched(keys, m)).join(keys, m["key"], "left_semi")

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those with the same key or are added; the new version. One row a key: of several any one."""
        m, n = self.manifest(), self.version()
        rows = rows.where(F.col(m["key"]).isNotNull()).dropDuplicates([m["key"]]).select(*StructType.fromJson(json.loads(m["schema"])).names)
        touched = self._touched(rows, m)
        self._commit(n + 1, m, upsert(self._rows(m, touched), rows, m["key"]), touched)
        return n + 1

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows whose key is in ``keys``; how many there were. If there were none, no version is made."""
        m, n = self.manifest(), self.version()
        keys = keys.select(m["key"])
        met = self._rows(m, self._touched(keys, m)).join(keys, m["key"], "left_semi")
        touched = self._touched(met, m)
        gone = met.count() if touched else 0
        if gone:
            self._commit(n + 1, m, self._rows(m, touched).join(keys, m["key"], "left_anti"), touched)
        return gone

    def vacuum(self, keep: int = 2) -> int:
        """Remove the files that only versions before the last ``keep`` have, and these versions; how many folders went."""
        n = self.version()
        old = [v for v in range(1, n - keep + 1) if exists(self.spark, f"{self.path}/versions/{v}.json")]
        used = {f for v in range(max(1, n - keep + 1), n + 1) for f in self.manifest(v)["folders"].values()}
        gone = {f for v in old for f in self.manifest(v)["folders"].values()} - used
        for f in gone:
            remove(self.spark, f"{self.path}/{f}")
        for v in old:
            remove(self.spark, f"{self.path}/versions/{v}.json")
        return len(gone)

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(m["key"]), F.lit(m["buckets"])).cast("int")

    def _touched(self, rows: DataFrame, m: dict) -> list[int]:
        """The buckets of rows' keys: a number each, as many as the table has at most."""
        return sorted(r[0] for r in rows.select(self._bucket(m)).distinct().collect())

    def _commit(self, n: int, m: dict, rows: DataFrame, touched: list[int]) -> None:
        place = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(m)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{place}")
        made = [b for b in (range(m["buckets"]) if n == 1 else touched) if exists(self.spark, f"{self.path}/{place}/bucket={b}")]
        folders = {b: f for b, f in m["folders"].items() if int(b) not in touched} | {str(b): f"{place}/bucket={b}" for b in made}
        target, draft = f"{self.path}/versions/{n}.json", f"{self.path}/drafts/{uuid.uuid4().hex}.json"
        write_text(self.spark, draft, json.dumps(m | {"folders": folders}))
        if n == 1:
            write_text(self.spark, f"{self.path}/versions/_made", "")
        if exists(self.spark, target) or not rename(self.spark, draft, target):
            remove(self.spark, f"{self.path}/{place}")
            raise ConflictError(f"version {n} of {self.path} was made by another change")
