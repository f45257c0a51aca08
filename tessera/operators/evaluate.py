"""Paired evaluation of task outcomes: metrics of an arm, and deltas between two arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import signed_text


def metrics(outcomes: DataFrame) -> DataFrame:
    """One row: tasks, completion, first_pass, repeated_rate, repeated, median_ms (of successes), mean_tokens."""
    n = F.count(F.lit(1))
    return outcomes.agg(
        n.alias("tasks"), (F.count_if("success") / n).alias("completion"), (F.count_if(F.col("success") & (F.col("attempts") == 1)) / n).alias("first_pass"),
        (F.count_if(F.col("repeated_failures") > 0) / n).alias("repeated_rate"), F.sum("repeated_failures").alias("repeated"),
        F.median(F.when(F.col("success"), F.col("duration_ms"))).alias("median_ms"), F.avg("input_tokens").alias("mean_tokens"),
    )


def latency(rows: DataFrame, by: str, ms: str) -> DataFrame:
    """(by, n, min_ms, median_ms, max_ms): exact figures of the known latencies; a null name is a name of its own."""
    return rows.where(F.col(ms).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("min_ms"), F.median(ms).alias("median_ms"), F.max(ms).alias("max_ms"))


def report_lines(figures: DataFrame) -> DataFrame:
    """(name, value) of deltas as people read them: shares in percentage points, the rest with a sign."""
    pairs = [(n, signed_text(F.round(F.col(f"d_{n}") * 100, 1), " pp")) for n in ("completion", "first_pass", "repeated_rate")] + [(n, signed_text(F.round(F.col(f"d_{n}"), 1))) for n in ("repeated", "median_ms", "mean_tokens")]
    return figures.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])).alias("x")).select("x.name", "x.value")


def unpaired(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """(task_id, missing_in) of the tasks that only one arm has."""
    a, b = baseline.select("task_id", F.lit(1).alias("a")), treatment.select("task_id", F.lit(1).alias("b"))
    both = a.join(b, "task_id", "full_outer").where("a is null or b is null")
    return both.select("task_id", F.when(F.col("a").isNull(), "baseline").otherwise("treatment").alias("missing_in"))


def invalid(outcomes: DataFrame) -> DataFrame:
    """(task_id, problem) of rows that break a rule: bounds, more repeated failures than retries, a task named twice."""
    problem = (
        F.when(F.col("task_id").isNull() | (F.trim("task_id") == ""), "task_id is empty").when(F.col("success").isNull(), "success is missing").when(F.coalesce("attempts", F.lit(0)) < 1, "attempts below 1")
        .when(F.coalesce("repeated_failures", F.lit(-1)) < 0, "repeated_failures below 0").when(F.col("repeated_failures") > F.col("attempts") - 1, "more repeated failures than retries")
        .when(F.coalesce("duration_ms", F.lit(-1)) < 0, "duration_ms below 0").when(F.coalesce("input_tokens", F.lit(-1)) < 0, "input_tokens below 0")
    )
    twice = outcomes.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id", F.lit("task named twice").alias("problem"))
    return outcomes.select("task_id", problem.alias("problem")).where("problem is not null").unionByName(twice)


def deltas(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """One row of treatment minus baseline; both sides are one aggregate row, so the join is of two rows."""
    a, b = metrics(baseline), metrics(treatment)
    names = ["completion", "first_pass", "repeated_rate", "repeated", "median_ms", "mean_tokens"]
    left = a.select(F.lit(1).alias("one"), *[F.col(n).alias(f"a_{n}") for n in names])
    right = b.select(F.lit(1).alias("one"), *[F.col(n).alias(f"b_{n}") for n in names])
    return left.join(right, "one").select(*[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(f"d_{n}") for n in names])


def read_outcomes(spark, path: str) -> DataFrame:
    """JSON evidence with a fixed schema; a line that doesn't fit it fails the read."""
    schema = "task_id string, success boolean, attempts int, repeated_failures int, duration_ms bigint, input_tokens bigint"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
