"""Live index: new and changed files of a folder, as a stream over its file source."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.cut import Cutter
from tessera.sources import extract, tree
from tessera.sources.store import BucketedTable


def watch(spark: SparkSession, root: str, store: str, checkpoint: str, once: bool = False, interval: str = "300 milliseconds", fresh_only: bool = False) -> StreamingQuery:
    """Keeps the table symbols under store up to date with files added below root.

    In one batch the last version of a path counts. A file that no longer has symbols loses its
    rows, one that can't be parsed keeps them. Only the buckets of the batch's paths are
    rewritten, in the tables symbols and files alike. With fresh_only, files that were there
    before the start are left to the first batch load (index_tree). The file source doesn't see
    deletions; reconcile() removes what is gone, from time to time. store and checkpoint must lie
    in folders that all executors share.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("ignoreChanges", "true")
    if fresh_only:
        stream = stream.option("modifiedAfter", datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"))
    stream = stream.load(root)
    files = stream.select(tree.relative(F.col("path"), root).alias("file_path"), "modificationTime", F.col("length").alias("size"), "content").where(tree.should_index(F.col("file_path")))

    def apply(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        newest = F.max_by(F.struct("content", "size", F.unix_millis("modificationTime").alias("mtime_ms")), "modificationTime").alias("v")
        last = batch.groupBy("file_path").agg(newest).select("file_path", "v.*")
        if batch.isEmpty():
            return
        cutter = Cutter(session, "watch")
        fresh = cutter.cut(extract.extract_symbols(last))
        failed = fresh.where("error is not null").select("file_path").distinct()
        done = last.join(failed, "file_path", "left_anti")
        BucketedTable(session, f"{store}/symbols").replace(fresh.where("error is null").drop("error"), done.select("file_path"))
        counts = fresh.where("error is null").groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
        state = tree.with_hash(done).join(counts, "file_path", "left").select("file_path", "content_hash", "size", "mtime_ms", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.current_timestamp().alias("indexed_at"))
        BucketedTable(session, f"{store}/files").replace(state, done.select("file_path"))
        for name in ("symbols", "files"):
            BucketedTable(session, f"{store}/{name}").expire()
        cutter.release(fresh)

    writer = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def reconcile(spark: SparkSession, root: str, store: str) -> int:
    """Removes the symbols and states of files that are gone; their number of files."""
    symbols, files = BucketedTable(spark, f"{store}/symbols"), BucketedTable(spark, f"{store}/files")
    state, rows = files.read(), symbols.read()
    if state is None or rows is None:
        return 0
    gone = state.select("file_path").join(tree.list_files(spark, root).select("file_path"), "file_path", "left_anti")
    gone = Cutter(spark, "reconcile").cut(gone)
    n = gone.count()
    if n:
        symbols.replace(rows.limit(0), gone)
        files.replace(state.limit(0), gone)
    return n


def progress(query: StreamingQuery) -> dict[str, object]:
    last = query.lastProgress or {}
    return {"active": query.isActive, "batch": last.get("batchId", -1), "rows": last.get("numInputRows", 0)}
