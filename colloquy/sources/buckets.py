"""A sample table in hash buckets: a change rewrites the buckets of the ids that it has, and no others.

Each version's buckets lie in a folder of their own; a manifest names the folder of every bucket and the schema. The manifest is
written last, under the next number, and only if no other writer has taken that number: until then, and after a job that
broke off, readers see the version before, whole. Old versions stay readable until `vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators import store
from colloquy.scratch import hadoop_path, remove


class Conflict(RuntimeError):
    """Another writer has made the next version first. Nothing was changed; the change can be tried again."""


class BucketTable:
    """A table at path. The number of buckets is fixed by `create`: a bucket is written by one task a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, *, key: str = "id", buckets: int = 64) -> BucketTable:
        """A new table of these rows. Keys are unique and not null."""
        table = cls(rows.sparkSession, path)
        first = {"version": -1, "key": key, "buckets": buckets, "schema": json.loads(rows.schema.json()), "at": {}}
        table._put(first, rows)
        return table

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(manifest["key"]).cast("string")), F.lit(manifest["buckets"])).cast("int")

    def versions(self) -> list[int]:
        at, fs = hadoop_path(self.spark, f"{self.path}/manifest")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What the newest (or a given) version is made of."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path}: no such table or version")
        at = f"{self.path}/manifest/{known[-1] if version is None else version:012d}.json"
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(at, wholetext=True).collect()))

    def _switch(self, manifest: dict) -> None:
        """Write a manifest under its number, whole or not at all: a file of another name is renamed to a name that is free."""
        to, fs = hadoop_path(self.spark, f"{self.path}/manifest/{manifest['version']:012d}.json")
        own, _ = hadoop_path(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(own, to):
            fs.delete(own, False)
            raise Conflict(f"{self.path}: version {manifest['version']} is there already")

    def _put(self, before: dict, rows: DataFrame, touched: list[int] | None = None) -> dict:
        """Write rows as the buckets touched (all, if None) of the next version, then switch to it."""
        n = before["version"] + 1
        folder = f"v{n:012d}-{uuid.uuid4().hex[:8]}"
        count = before["buckets"] if touched is None else max(len(touched), 1)
        dealt = rows.withColumn("bucket", self._bucket(before)).repartition(count, "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        at, fs = hadoop_path(self.spark, f"{self.path}/data/{folder}")
        there = {x.getPath().getName()[7:] for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket=")}
        gone = {str(b) for b in touched or range(before["buckets"])} - there
        own = {b: f for b, f in before["at"].items() if b not in there and b not in gone} | dict.fromkeys(sorted(there, key=int), folder)
        manifest = before | {"version": n, "at": own}
        self._switch(manifest)
        return manifest

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        at = {b: f for b, f in manifest["at"].items() if buckets is None or int(b) in set(buckets)}
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in at.items()])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _of(self, manifest: dict, keys: DataFrame) -> list[int]:
        """The buckets that keys fall into: at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in keys.select(self._bucket(manifest).alias("b")).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys (a column of the key's name), from their buckets alone."""
        manifest = self.manifest()
        return self._rows(manifest, self._of(manifest, keys)).join(keys.select(manifest["key"]).distinct(), manifest["key"], "left_semi")

    def upsert(self, new: DataFrame, **columns: str) -> list[int]:
        """Lay new rows over the table, as `store.upsert` does; the buckets that were written come back. No rows, no new version."""
        manifest = self.manifest()
        touched = self._of(manifest, new)
        if touched:
            self._put(manifest, store.upsert(self._rows(manifest, touched), new, manifest["key"], **columns), touched)
        return touched

    def update(self, changes: DataFrame) -> list[int]:
        """Set columns of rows that are there, as `store.update` does; the buckets that were written come back."""
        manifest = self.manifest()
        touched = self._of(manifest, changes)
        if touched:
            self._put(manifest, store.update(self._rows(manifest, touched), changes, manifest["key"]), touched)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        manifest = self.manifest()
        touched = self._of(manifest, keys)
        if touched:
            self._put(manifest, self._rows(manifest, touched).join(keys.select(manifest["key"]).distinct(), manifest["key"], "left_anti"), touched)
        return touched

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the newest `keep` versions, and folders that no version names. No writer may be at work. Folders removed come back."""
        known = self.versions()
        kept = known[-max(keep, 1) :]
        used = {f for v in kept for f in self.manifest(v)["at"].values()}
        for v in known[: -len(kept)]:
            remove(self.spark, f"{self.path}/manifest/{v:012d}.json")
        at, fs = hadoop_path(self.spark, f"{self.path}/data")
        loose = [x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName() not in used]
        for name in loose:
            remove(self.spark, f"{self.path}/data/{name}")
        return len(loose)
