"""A keyed table in a folder: hash buckets that are copied on write, and a manifest per version that names them.

A batch rewrites only the buckets that hold its keys. A reader takes one manifest and sees one version, whatever is
written meanwhile. A manifest also says how far each writer has come, so a batch that is written again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.operators import merge


class KeyedStore:
    """`keys` are never null. On a conflict columns take the new value, but those of `keep`, `largest` and `guard` as in
    `merge.upsert`; of rows of one batch with one key the last by `order` counts as the new one. The number of buckets
    is set by the first batch."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64, order: tuple[str, ...] = (), **policy: tuple[str, ...]):
        self.spark, self.folder, self.keys, self.buckets, self.order, self.policy = spark, folder.rstrip("/"), keys, buckets, order, policy

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._path("manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the latest; one that a writer did not finish counts for nothing."""
        for v in reversed(self.versions()) if version is None else [version]:
            text = self.spark.read.text(f"{self.folder}/manifest/{v:012d}", wholetext=True).first()
            try:
                return json.loads(text[0]) if text else None
            except json.JSONDecodeError:
                continue
        return None

    def _commit(self, told: dict) -> None:
        fs, path = self._path(f"manifest/{told['version']:012d}")
        # fails where another writer has made this version: nothing of this batch is seen then, and it can be written again
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _rows(self, told: dict, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.folder}/data/{p}" for b, p in told["paths"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(told["schema"]).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of one version; None before the first."""
        told = self.manifest(version)
        if told is None:
            return None
        return self._rows(told) if told["paths"] else self.spark.createDataFrame([], told["schema"])

    def folded(self, batch: DataFrame) -> DataFrame:
        """One row per key of a batch."""
        rest = [c for c in batch.columns if c not in self.keys]
        if not rest:
            return batch.select(*self.keys).distinct()
        place = F.struct(*self.order, *rest)

        def pick(c: str) -> Column:
            if c in self.policy.get("keep", ()):
                return F.min_by(c, place)
            if c in self.policy.get("largest", ()):
                return F.max(c)
            if c in self.policy.get("guard", ()):
                said = F.col(c) != ""
                return F.coalesce(F.max_by(F.when(said, F.col(c)), F.when(said, place)), F.max(c))
            return F.max_by(c, place)

        return batch.groupBy(*self.keys).agg(*[pick(c).alias(c) for c in rest])

    def write(self, batch: DataFrame, number: int, writer: str = "main") -> int:
        """Upsert the batch of this number of a writer and return the version that holds it."""
        told = self.manifest()
        if told and told["done"].get(writer, -1) >= number:
            return told["version"]
        told = told or {"version": 0, "buckets": self.buckets, "schema": None, "done": {}, "paths": {}}
        n = told["buckets"]
        if told["schema"]:
            kinds = self.spark.createDataFrame([], told["schema"]).schema
            batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        new = self.folded(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = [r[0] for r in new.select(self._bucket(n).alias("b")).distinct().collect()]
            paths = dict(told["paths"])
            if touched:
                old = self._rows(told, touched)
                if old is None or len(new.columns) == len(self.keys):
                    both = new if old is None else old.unionByName(new).distinct()
                else:
                    both = merge.upsert(old, new, self.keys, **self.policy).select(*new.columns)
                name = uuid.uuid4().hex
                both.withColumn("bucket_", self._bucket(n)).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.folder}/data/{name}")
                paths |= {str(b): f"{name}/bucket_={b}" for b in touched}
            schema = told["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
            self._commit({"version": told["version"] + 1, "buckets": n, "schema": schema, "done": told["done"] | {writer: number}, "paths": paths})
        finally:
            new.unpersist()
        return told["version"] + 1

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last `keep` versions, and the data that none of them names."""
        kept = self.versions()[-keep:]
        named = {p.partition("/")[0] for v in kept for p in (self.manifest(v) or {"paths": {}})["paths"].values()}
        for v in set(self.versions()) - set(kept):
            fs, path = self._path(f"manifest/{v:012d}")
            fs.delete(path, False)
        fs, path = self._path("data")
        for status in fs.listStatus(path) if fs.exists(path) else []:
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)
