"""Debt markers in comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debt_markers(files: DataFrame, key: str, path: str, content: str, marker: str = "rin") -> DataFrame:
    """(key, line_no, comment, has_upgrade) of comment lines that begin with a marker.

    In JavaScript and TypeScript a line inside a template string, by the parity of the back
    quotes before it, is no comment. has_upgrade says that the comment names a trigger. Null
    contents give no row. One fold over the lines of each text carries the parity and keeps the
    few lines that count: no window, no shuffle, and no line is looked at twice.
    """
    pattern = rf"(?i)^\s*(?://|#|\*)\s*{marker}:\s*(.+)$"
    script = F.coalesce(F.col(path).rlike(r"\.[cm]?[jt]sx?$"), F.lit(False))
    rows = files.where(F.col(content).rlike(rf"(?im)^\s*(?://|#|\*)\s*{marker}:")).select(F.col(key), script.alias("script"), F.split(F.col(content), "\n").alias("lines"))
    none = F.expr("cast(array() as array<struct<pos:int,line:string>>)")
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), none.alias("hits"))

    def step(acc, line):  # noqa: ANN001, ANN202
        odd = F.regexp_count(F.replace(line, F.lit("\\`"), F.lit("")), F.lit("`")) % 2 == 1
        hit = line.rlike(pattern) & ~(F.col("script") & acc["open"])
        hits = F.when(hit, F.concat(acc["hits"], F.array(F.struct(acc["n"].alias("pos"), line.alias("line"))))).otherwise(acc["hits"])
        return F.struct((acc["n"] + 1).alias("n"), (acc["open"] != odd).alias("open"), hits.alias("hits"))

    one = rows.select(key, F.explode(F.aggregate("lines", state, step, lambda acc: acc["hits"])).alias("h")).select(key, "h.pos", "h.line")
    comment = F.trim(F.regexp_extract("line", pattern, 1))
    return one.select(key, (F.col("pos") + 1).alias("line_no"), comment.alias("comment"), comment.rlike(r"(?i),|if\s|when\s|until\s").alias("has_upgrade"))


def debt_ledger(markers: DataFrame, by: str = "id") -> DataFrame:
    """(by, n, n_without_trigger) of markers."""
    return markers.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_upgrade")).alias("n_without_trigger"))
