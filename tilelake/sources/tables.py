"""Tables that are updated by key: rows in buckets, and small manifests that say which files a version is made of.

An update reads and rewrites the buckets that its keys fall into, and nothing else; files of the others stay under their
names. New files go to a folder of their own and count from the moment that a manifest naming them exists, which is one
small file that is created or not: readers see a version whole, a failed or repeated write leaves the one before, and of
two writers of one version the later fails. The driver holds one line a bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Folder:
    """A folder in any store that Spark can write to: small files, listings, deletions."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; fails if there is one. Written beside its place and renamed, so it is never seen in part."""
        if self._fs.exists(self._path(name)):
            raise FileExistsError(name)
        new = self._path(f"{name}.{uuid.uuid4().hex}.new")
        stream = self._fs.create(new, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if not self._fs.rename(new, self._path(name)):
            self._fs.delete(new, False)
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class KeyedTable:
    """Rows of one schema below root, in buckets by a hash of the key columns."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, Folder(spark, root), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def manifest(self) -> dict:
        """The newest version: its number, the folder of each bucket that has rows, and what its writer noted."""
        found = [n for n in self.folder.names("manifest") if n.endswith(".json")]
        return json.loads(self.folder.read(f"manifest/{found[-1]}")) if found else {"version": 0, "parts": {}, "note": {}}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The newest version's rows, or those of some buckets."""
        parts = [p for b, p in self.manifest()["parts"].items() if only is None or int(b) in only]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder.root}/{p}" for p in parts))

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets that the keys of rows fall into."""
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def update(self, rows: DataFrame, merged: Callable[[DataFrame], DataFrame], note: dict | None = None) -> int:
        """Rewrite the buckets that rows fall into: merged gets their present rows and returns the new ones. The new version."""
        touched = self.touched(rows)
        return self._publish(merged(self.read(touched)), touched, note)

    def replace(self, rows: DataFrame, note: dict | None = None) -> int:
        """All rows anew."""
        return self._publish(rows, set(range(self.buckets)), note)

    def remark(self, note: dict) -> int:
        """A version with the same rows and another note."""
        old = self.manifest()
        self._name(old["version"] + 1, old["parts"], old["note"] | note)
        return old["version"] + 1

    def _name(self, version: int, parts: dict, note: dict) -> None:
        self.folder.create(f"manifest/{version:012d}.json", json.dumps({"version": version, "parts": parts, "note": note}))

    def _publish(self, rows: DataFrame, touched: set[int], note: dict | None) -> int:
        old = self.manifest()
        version = old["version"] + 1
        data = f"data/{version:012d}-{uuid.uuid4().hex}"
        placed = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema), self.bucket().alias("bucket"))
        # A bucket of many rows is several tasks' and files: tables may have fewer buckets than a cluster has cores.
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder.root}/{data}")
        written = {int(n.split("=")[1]) for n in self.folder.names(data) if n.startswith("bucket=")}
        if not written <= touched:
            self.folder.delete(data)
            raise ValueError("an update may not move rows to other buckets")
        parts = {b: p for b, p in old["parts"].items() if int(b) not in touched} | {str(b): f"{data}/bucket={b}" for b in sorted(written)}
        try:
            self._name(version, parts, old["note"] | (note or {}))
        except FileExistsError:
            self.folder.delete(data)
            raise
        return version

    def clean(self, keep: int = 1) -> None:
        """Delete manifests but the newest keep, and data that none of these names."""
        names = [n for n in self.folder.names("manifest") if n.endswith(".json")]
        used = {p.split("/")[1] for n in names[-keep:] for p in json.loads(self.folder.read(f"manifest/{n}"))["parts"].values()}
        for n in names[:-keep]:
            self.folder.delete(f"manifest/{n}")
        for n in self.folder.names("data"):
            if n not in used:
                self.folder.delete(f"data/{n}")
