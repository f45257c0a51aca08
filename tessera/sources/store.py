"""A versioned table: every write is a new folder, and a pointer file names the current one.

A reader sees a whole version or the one before. There is one writer at a time, as with the
stores this replaces; a cluster's catalog or table format can take its place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by or []
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        pointers = self._fs.globStatus(self._path(f"{self.path}/current-*"))
        names = sorted(p.getPath().getName() for p in pointers) if pointers else []
        return names[-1].split("-", 2)[2] if names else None

    def read(self) -> DataFrame | None:
        version = self.current()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else None

    def write(self, df: DataFrame) -> str:
        """A new version; readers move to it when it is complete, by one rename-free creation of its pointer."""
        version = uuid.uuid4().hex
        writer = df.write.partitionBy(*self.partition_by) if self.partition_by else df.write
        writer.parquet(f"{self.path}/{version}")
        pointers = self._fs.globStatus(self._path(f"{self.path}/current-*"))
        number = 1 + max([int(p.getPath().getName().split("-")[1]) for p in pointers], default=0) if pointers else 1
        self._fs.create(self._path(f"{self.path}/current-{number:012d}-{version}"), False).close()
        return version


    def expire(self, keep: int = 2) -> int:
        """Deletes all but the newest versions; the number of those deleted. Readers of older ones must be done."""
        pointers = self._fs.globStatus(self._path(f"{self.path}/current-*"))
        names = sorted(p.getPath().getName() for p in pointers) if pointers else []
        old = names[: max(0, len(names) - keep)]
        for name in old:
            self._fs.delete(self._path(f"{self.path}/{name.split('-', 2)[2]}"), True)
            self._fs.delete(self._path(f"{self.path}/{name}"), False)
        return len(old)


class BucketedTable:
    """Rows of files in buckets of their paths' hash: a change rewrites the buckets it touches and no others.

    A version is a small file that names the folder of each bucket; it is written last, so readers
    see a whole version or the one before. expire() deletes folders that no kept version names.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "file_path"):
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, key
        self._jvm = spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.path}/version-*"))
        return sorted(f.getPath().getName() for f in found) if found else []

    def _folders(self, version: str) -> dict[str, str]:
        stream = self._fs.open(self._path(f"{self.path}/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        versions = self._versions()
        if not versions:
            return None
        folders = self._folders(versions[-1])
        schema = T.StructType.fromJson(json.loads(folders["schema"]))
        paths = [p for k, p in folders.items() if k != "schema"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, rows: DataFrame, touched: DataFrame) -> list[int]:
        """All rows of the keys in touched replaced by rows; the buckets that were rewritten."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        numbers = sorted(r[0] for r in touched.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
        versions = self._versions()
        folders = self._folders(versions[-1]) if versions else {}
        old = [folders[str(b)] for b in numbers if str(b) in folders]
        new = rows
        if old:
            kept = self.spark.read.schema(rows.schema).parquet(*old)
            new = kept.join(touched.select(self.key).distinct(), self.key, "left_anti").select(*rows.columns).unionByName(rows)
        number = 1 + (int(versions[-1].split("-")[1]) if versions else 0)
        place = f"{self.path}/data-{number:012d}-{uuid.uuid4().hex}"
        new.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(place)
        there = {f.getPath().getName().split("=")[1] for f in self._fs.globStatus(self._path(f"{place}/bucket=*")) or []}
        for b in map(str, numbers):
            folders.pop(b, None)
            if b in there:
                folders[b] = f"{place}/bucket={b}"
        folders["schema"] = rows.schema.json()
        out = self._fs.create(self._path(f"{self.path}/version-{number:012d}"), False)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        return numbers

    def expire(self, keep: int = 2) -> int:
        """Deletes all but the newest versions and the folders that only they name; the number of folders deleted."""
        versions = self._versions()
        named = {p.split("/bucket=")[0].rpartition("/")[2] for v in versions[-keep:] for k, p in self._folders(v).items() if k != "schema"}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/{v}"), False)
        gone = [f.getPath() for f in self._fs.globStatus(self._path(f"{self.path}/data-*")) or [] if f.getPath().getName() not in named]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


def replace_files(target: DataFrame | None, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """target with all rows of the files in fresh replaced and of those in gone left out.

    Files whose extraction failed keep their last good rows.
    """
    good = fresh.where("error is null") if "error" in fresh.columns else fresh
    rows = good.drop("error") if "error" in good.columns else good
    if target is None:
        return rows
    kept = target.join(rows.select("file_path").distinct(), "file_path", "left_anti")
    if gone is not None:
        kept = kept.join(gone.select("file_path").distinct(), "file_path", "left_anti")
    return kept.select(*rows.columns).unionByName(rows)


def mark_indexed(state: DataFrame | None, indexed: DataFrame) -> DataFrame:
    """The file state with the files of indexed(file_path, content_hash, size, mtime_ms, symbol_count, indexed_at) updated."""
    if state is None:
        return indexed
    both = state.unionByName(indexed)
    rest = [c for c in both.columns if c != "file_path"]
    return both.groupBy("file_path").agg(F.max_by(F.struct(*rest), F.col("indexed_at")).alias("v")).select("file_path", "v.*")
