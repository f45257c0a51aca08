"""Tables and indexes that several queries share, made once for one application and its inputs.

They lie in the shared checkpoint folder. A table whose input files change is made anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tessera.operators.inverted import WORDS, InvertedIndex, index_of
from tessera.plans.cut import application_folder

_MADE: dict[str, set[str]] = {}


def _place(spark: SparkSession, name: str, source: DataFrame) -> str:
    """A folder that depends on the application, the name and the input files with their times and sizes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for f in sorted(source.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    digest = hashlib.sha256("\n".join(files).encode()).hexdigest()[:24]
    return f"{application_folder(spark)}/stored/{name}-{digest}"


def stored_table(spark: SparkSession, name: str, source: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() gives, written the first time it is asked for."""
    path = _place(spark, name, source)
    made = _MADE.setdefault(spark.sparkContext.applicationId, set())
    if path not in made:
        build().write.mode("overwrite").parquet(path)
        made.add(path)
    return spark.read.parquet(path)


def stored_index(spark: SparkSession, name: str, docs: DataFrame, key: str, text: Column, tokens: str = WORDS, positions: bool = False) -> InvertedIndex:
    """The inverted index over docs, built the first time it is asked for."""
    return index_of(spark, _place(spark, name, docs), docs, key, text, tokens, positions)
