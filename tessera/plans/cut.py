"""Lineage cuts: a plan's rows written to the shared checkpoint folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_checkpoint_dir


def application_folder(spark: SparkSession) -> str:
    """Where this application's tables lie, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables and indexes that this application has written for itself; no result may be read afterwards."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Cutter:
    """Writes numbered tables into one folder; written once, they survive the loss of executors.

    Unlike checkpoint(), which computes its rows twice, a written table is computed once and
    under adaptive execution. release() removes tables that no later plan reads, clean_up() all of
    an application when it is done with its results.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def release(self, df: DataFrame) -> None:
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
