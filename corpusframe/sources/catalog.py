"""Collections as Parquet tables in versioned folders: create, write, switch, compact, list.

A write goes to a new folder and then one small pointer file is replaced, so readers see the old rows or the new ones, and a table may be
rewritten from its own rows.  A collection may be dealt into `BUCKETS` by a column: `replace` then rewrites only the buckets of the keys that
change, and the pointer tells which folder has each bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.operators import collections as ops
from corpusframe.operators import filters as flt
from corpusframe.schemas import TABLES


BUCKETS = 64


class Conflict(RuntimeError):
    """Somebody else has written the collection meanwhile."""


class Catalog:
    """The collections under a folder of any file system that Spark reads.  `namespace` keeps repositories apart."""

    def __init__(self, spark: SparkSession, root: str, namespace: str = "default"):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{namespace}"
        self._jvm = spark._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointer(self, name: str) -> dict | None:
        path = self._path(name, "current.json")
        if not self._fs().exists(path):
            return None
        stream = self._fs().open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, name: str, old: dict | None, value: dict) -> None:
        """Lets the pointer show new folders, unless another writer has moved it since `old` was read; folders that neither it nor its predecessor
        shows are removed, so those who still read the predecessor's rows can."""
        if self._pointer(name) != old:
            raise Conflict(name)
        before = _versions(old) if old else set()
        fs, new = self._fs(), self._path(name, f".{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(value | {"held": sorted(before)}).encode()))
        stream.close()
        target = self._path(name, "current.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(target), how)
        for version in set(old.get("held", []) if old else []) - before - _versions(value):
            fs.delete(self._path(name, version), True)

    def create(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """Opens a collection, and makes an empty one if there is none."""
        if self._pointer(name) is None:
            kind = schema or TABLES[name]
            self.write(name, self.spark.createDataFrame([], kind))
        return self.open(name)

    def open(self, name: str) -> DataFrame:
        pointer = self._pointer(name)
        if pointer is None:
            raise KeyError(f"there is no collection {name}")
        return self._rows(name, pointer)

    def _rows(self, name: str, pointer: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(pointer["schema"])
        if "buckets" not in pointer:
            folders = [f"{self.root}/{name}/{pointer['version']}"]
        else:
            folders = [f"{self.root}/{name}/{v}/__bucket={b}" for b, v in pointer["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def close(self, name: str) -> None:
        """Nothing is held open; cached file lists are dropped."""
        pointer = self._pointer(name)
        if pointer:
            self.spark.catalog.refreshByPath(f"{self.root}/{name}")

    def list(self) -> list[str]:
        fs, root = self._fs(), self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []

    def missing(self, names: list[str]) -> list[str]:
        there = set(self.list())
        return [n for n in names if n not in there]

    def write(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        """Replaces a collection; returns how many rows were written, as counted while they were."""
        version, old, seen = uuid.uuid4().hex, self._pointer(name), Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        writer = counted.write.partitionBy(*partition_by) if partition_by else counted.write
        writer.parquet(f"{self.root}/{name}/{version}")
        self._switch(name, old, {"version": version, "schema": json.loads(rows.schema.json())})
        return seen.get["n"]

    def write_buckets(self, name: str, rows: DataFrame, key: str, sort: list[str] = ()) -> None:
        """Replaces a collection, dealt into buckets by a column; within its files rows are sorted."""
        old = self._pointer(name)
        version, there = self._bucketed(name, rows, key, list(sort))
        self._switch(name, old, {"bucket_by": key, "sort": list(sort), "schema": json.loads(rows.schema.json()), "buckets": dict.fromkeys(there, version)})

    def _bucketed(self, name: str, rows: DataFrame, key: str, sort: list[str]) -> tuple[str, list[str]]:
        version = uuid.uuid4().hex
        dealt = rows.withColumn("__bucket", _bucket(key)).repartition("__bucket").sortWithinPartitions("__bucket", *sort)
        dealt.write.partitionBy("__bucket").parquet(f"{self.root}/{name}/{version}")
        found = self._fs().listStatus(self._path(name, version))
        return version, [s.getPath().getName().removeprefix("__bucket=") for s in found if s.getPath().getName().startswith("__bucket=")]

    def replace(self, name: str, fresh: DataFrame, changed: DataFrame, key: str, sort: list[str] = ()) -> None:
        """Takes away the rows of changed keys (a table with the column `key`) and adds the fresh ones, in the buckets of the changed keys
        alone.  A collection that has no buckets by that column yet, or isn't there, gets them."""
        old = self._pointer(name)
        if old is None:
            return self.write_buckets(name, fresh, key, sort)
        changed = changed.select(key).distinct()
        if old.get("bucket_by") != key:
            kept = self._rows(name, old).join(changed, key, "left_anti").select(*fresh.columns)
            return self.write_buckets(name, kept.unionByName(fresh), key, sort)
        touched = [r[0] for r in changed.select(_bucket(key)).distinct().collect()]  # BUCKETS numbers at most
        if not touched:
            return None
        kept = self._rows(name, old, touched)
        rows = kept.join(changed, key, "left_anti").select(*kept.columns).unionByName(fresh.select(*kept.columns))
        version, there = self._bucketed(name, rows, key, old["sort"])
        buckets = {b: v for b, v in old["buckets"].items() if int(b) not in touched} | dict.fromkeys(there, version)
        return self._switch(name, old, {k: v for k, v in old.items() if k != "held"} | {"buckets": buckets})

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> int:
        pointer = self._pointer(name)
        if pointer and pointer.get("bucket_by") == key:
            self.replace(name, rows, rows, key)
            return self.open(name).count()
        return self.write(name, ops.upsert(self.open(name), rows, key))

    def delete(self, name: str, filters: list[flt.Filter]) -> int:
        return self.write(name, flt.delete_where(self.open(name), filters))

    def lookup(self, name: str, keys: list, key: str = "id") -> DataFrame:
        return ops.lookup(self.open(name), key, keys)

    def count(self, name: str, filters: list[flt.Filter] = ()) -> int:
        return flt.where(self.open(name), filters).count()

    def update_schema(self, name: str, schema: T.StructType) -> None:
        """New fields are null in old rows; fields that are left out go."""
        old = self.open(name)
        self.write(name, old.select(*[(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields]))

    def force_merge(self, name: str, max_segments: int = 1) -> tuple[int, int]:
        """Rewrites a collection in that many files; how many there were before and are after."""
        rows = self.open(name)
        before = len(rows.inputFiles())
        self.write(name, rows.repartition(max_segments))
        return before, len(self.open(name).inputFiles())

    def status(self) -> DataFrame:
        """(collection, doc_count, segment_count)."""
        rows = [(n, self.open(n).count(), len(self.open(n).inputFiles())) for n in self.list()]
        return self.spark.createDataFrame(rows, "collection string, doc_count long, segment_count int")


def _versions(pointer: dict) -> set[str]:
    return set(pointer["buckets"].values()) if "buckets" in pointer else {pointer["version"]}


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
