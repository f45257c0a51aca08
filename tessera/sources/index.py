"""Incremental index of a source tree: what changed is parsed, the rest is kept."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.cut import Cutter
from tessera.sources import extract, tree
from tessera.sources.store import BucketedTable


def index_tree(spark: SparkSession, root: str, store: str, ignored: tuple[str, ...] = ()) -> dict[str, int]:
    """Brings the tables symbols and files under store up to date with root; counts of what was done.

    Files whose size and time are as before aren't opened. A file that can't be parsed keeps its
    last good symbols, isn't marked and is tried again next time. Files that are gone are purged.
    """
    symbols, state = BucketedTable(spark, f"{store}/symbols"), BucketedTable(spark, f"{store}/files")
    known = state.read()
    files = tree.list_files(spark, root, ignored)
    if known is not None:
        seen = known.select("file_path", F.col("size").alias("s0"), F.col("mtime_ms").alias("m0"))
        stat = files.drop("content").join(seen, "file_path", "left")
        touched = stat.where("s0 is null or not (s0 = size and m0 = mtime_ms)").select("file_path")
        gone = Cutter(spark, "gone").cut(known.join(files.select("file_path"), "file_path", "left_anti").select("file_path"))
    else:
        touched, gone = files.select("file_path"), None
    cutter = Cutter(spark, "index")
    hashed = tree.with_hash(files.join(touched, "file_path", "left_semi"))
    if known is not None:
        hashed = hashed.join(known.select("file_path", F.col("content_hash").alias("h0")), "file_path", "left").where("h0 is null or h0 <> content_hash").drop("h0")
    fresh = cutter.cut(extract.extract_symbols(hashed))
    failed = fresh.where("error is not null").select("file_path").distinct()
    n_gone = gone.count() if gone is not None else 0
    done = hashed.join(failed, "file_path", "left_anti")
    counts = fresh.where("error is null").groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
    marked = cutter.cut(done.join(counts, "file_path", "left").select("file_path", "content_hash", "size", "mtime_ms", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.current_timestamp().alias("indexed_at")))
    n_done, n_failed = marked.count(), failed.count()
    if n_done or n_gone or known is None:
        touched = marked.select("file_path")
        touched = touched if gone is None else touched.unionByName(gone)
        symbols.replace(fresh.where("error is null").drop("error"), touched)
        state.replace(marked, touched)
        for t in (symbols, state):
            t.expire()
    return {"indexed": n_done, "failed": n_failed, "purged": n_gone}
