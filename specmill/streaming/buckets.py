"""Catalogue state in hash buckets: a batch writes only the buckets it touches, and a manifest says which files are the state."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import c
from ..operators.merge import upsert

TRIES = 10


class Outdated(RuntimeError):
    """Another writer has published the version that was to be written."""


class BucketTable:
    """Upserted rows by ``key``, in ``buckets`` hash buckets under ``root``.

    A batch is merged into the present rows of its buckets only: later batches override field by field, later rows (by ``pos``) win inside a
    batch, nulls override nothing. New files and those of all other buckets are listed in the next manifest, a small file
    that is written beside and renamed into its place, so readers see a batch whole or not at all. Manifests are numbered, and the number
    is the order of the batches: no clock is asked. A manifest also names the last batch of each query, so a retry
    changes nothing. Of two writers of one version the second begins anew on the first one's. Columns that come later are
    part of the state. Rows without key are dropped.

    The number of buckets is fixed by the first batch; choose it so that a bucket has some hundred megabytes. Files of earlier versions
    stay until ``vacuum``. Manifests are written by the file system's classes in the JVM, so not over Spark Connect.
    """

    def __init__(self, root: str, key: str = "id", pos: str = "_pos", buckets: int = 64):
        self.root, self.key, self.pos, self.buckets = root.rstrip("/"), key, pos, buckets

    # -- manifests ------------------------------------------------------------------------------------------------

    def _path(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, spark: SparkSession) -> list[int]:
        folder, fs = self._path(spark, "manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict:
        found = self.versions(spark)
        if not found:
            return {"version": 0, "buckets": self.buckets, "files": {}, "applied": {}}
        text = spark.read.text(f"{self.root}/manifest/v{version or found[-1]:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, spark: SparkSession, manifest: dict) -> None:
        place, fs = self._path(spark, f"manifest/v{manifest['version']:010d}.json")
        beside, _ = self._path(spark, f"manifest/.{uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise Outdated(f"version {manifest['version']} is there already")

    # -- rows -----------------------------------------------------------------------------------------------------

    def append(self, batch: DataFrame, batch_id: int, query: str = "batch") -> int:
        """Merge a batch; gives the version that holds it. Batches of one query come in rising order."""
        for _ in range(TRIES):
            try:
                return self._append(batch, batch_id, query)
            except Outdated as e:
                last = e
        raise last

    def _append(self, batch: DataFrame, batch_id: int, query: str) -> int:
        spark, now = batch.sparkSession, self.manifest(batch.sparkSession)
        if now["applied"].get(query, -1) >= batch_id:
            return now["version"]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(now["buckets"])).cast("int")
        rows = batch.filter(c(self.key).isNotNull())
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # at most one row per bucket
        version, files = now["version"] + 1, dict(now["files"])
        if touched:
            held = [files[str(b)] for b in touched if str(b) in files]
            base = self._read(spark, held) if held else spark.createDataFrame([], T.StructType([rows.schema[self.key], rows.schema[self.pos]]))
            folder = f"data/v{version:010d}-{uuid4().hex}"
            merged = upsert(base, rows, key=self.key, pos=self.pos).withColumn("_bucket", bucket)
            merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            files |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._publish(spark, {"version": version, "buckets": now["buckets"], "files": files, "applied": {**now["applied"], query: batch_id}})
        return version

    def _read(self, spark: SparkSession, files: list[str]) -> DataFrame:
        return spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{f}" for f in files])

    def current(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The state after the last batch, or as of a version whose files are still there."""
        now = self.manifest(spark, version)
        if not now["files"]:
            raise ValueError(f"no rows in {self.root}")
        return self._read(spark, sorted(now["files"].values()))

    def vacuum(self, spark: SparkSession, keep: int = 1) -> int:
        """Delete manifests but the last ``keep``, and the files that none of those lists; gives how many folders went.

        Nobody may be reading an older version or writing meanwhile.
        """
        found = self.versions(spark)
        needed = {f for v in found[-keep:] for f in self.manifest(spark, v)["files"].values()}
        for v in found[:-keep]:
            path, fs = self._path(spark, f"manifest/v{v:010d}.json")
            fs.delete(path, False)
        folder, fs = self._path(spark, "data")
        gone = 0
        for s in fs.listStatus(folder) if fs.exists(folder) else ():
            for b in fs.listStatus(s.getPath()):
                name = f"data/{s.getPath().getName()}/{b.getPath().getName()}"
                if b.isDirectory() and name not in needed:
                    gone += bool(fs.delete(b.getPath(), True))
        return gone
