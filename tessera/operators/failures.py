"""Repeat-failure guard over the log of commands, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLEAN, RECORDED, BLOCKING = STATES = ("CLEAN", "RECORDED", "BLOCKING")


def guard_batch(events: DataFrame, keys: list[str], order: str, ok: str, retry: str, width: int = 1_000_000) -> DataFrame:
    """Adds state_before, state_after and refused to every event of a command's log.

    The first failure after a success is recorded, the second blocks. An attempt while blocked is
    refused, changes nothing and isn't run, unless it is an explicit retry. A success that is run
    clears the record. A null outcome counts as a failure, null keys are keys like others.

    order is a whole number that orders a key's log. The log is cut into stretches of `width`
    numbers, so that a command that holds a third of all rows is spread over many tasks: a first
    pass finds where a stretch leads from each of the three states, these few rows are chained
    for each key, and a second pass fills in the states from each stretch's own beginning. Chains
    are built in levels of at most LINKS links, as such maps can be put together, as many levels
    as the largest number asks for, so a command with a million stretches is no long array either.
    """
    names = [c for c in events.columns]
    marked = events.withColumn("_key", F.to_json(F.struct(*keys))).withColumn("_part", F.floor(F.col(order) / width))
    marked = marked.withColumn("_good", F.coalesce(F.col(ok), F.lit(False))).withColumn("_force", F.coalesce(F.col(retry), F.lit(False)))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, states, out = None, [], []
        for pdf in batches:
            for key, part, good, force in zip(pdf["_key"], pdf["_part"], pdf["_good"], pdf["_force"]):
                if (key, part) != now:
                    if now is not None:
                        out.append((*now, *states))
                    now, states = (key, part), list(STATES)
                states = [next_state(s, good, force)[0] for s in states]
            yield pd.DataFrame(out, columns=["_key", "_part", *STATES])
            out = []
        if now is not None:
            yield pd.DataFrame([(*now, *states)], columns=["_key", "_part", *STATES])

    spread = marked.select("_key", "_part", F.col(order).alias("_at"), "_good", "_force").repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_at")
    leads = spread.select("_key", "_part", "_good", "_force").mapInPandas(ends, f"_key string, _part long, {', '.join(f'{s} string' for s in STATES)}")
    last, levels = events.agg(F.max(order)).first()[0] or 0, 0
    while last // width >= LINKS ** (levels + 1):
        levels += 1
    starts = _starts(leads, levels)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, CLEAN
        for pdf in batches:
            before, after, refused = [], [], []
            for key, part, start, good, force in zip(pdf["_key"], pdf["_part"], pdf["_start"], pdf["_good"], pdf["_force"]):
                if (key, part) != now:
                    now, state = (key, part), start
                before.append(state)
                state, no = next_state(state, good, force)
                after.append(state)
                refused.append(no)
            yield pdf[names].assign(state_before=before, state_after=after, refused=refused)

    started = marked.join(starts, ["_key", "_part"]).repartition("_key", "_part").sortWithinPartitions("_key", "_part", order)
    schema = T.StructType([*events.schema.fields, *[T.StructField(c, T.StringType()) for c in ("state_before", "state_after")], T.StructField("refused", T.BooleanType())])
    return started.mapInPandas(fill, schema)


LINKS = 1000  # of one chain


def _follow(state: Column, step: Column) -> Column:
    """Where a stretch, or several put together, leads from a state."""
    return F.when(state == RECORDED, step[RECORDED]).when(state == BLOCKING, step[BLOCKING]).otherwise(step[CLEAN])


def _starts(leads: DataFrame, level: int) -> DataFrame:
    """(_key, _part, _start) from leads(_key, _part, CLEAN, RECORDED, BLOCKING), the state that each part begins in."""
    none = F.expr("cast(array() as array<struct<_part:bigint,start:string,end:string>>)")

    def link(first: Column):  # noqa: ANN202
        def step(acc: Column, part: Column) -> Column:
            start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], first)
            return F.concat(acc, F.array(F.struct(part["_part"].alias("_part"), start.alias("start"), _follow(start, part).alias("end"))))

        return step

    def begun(parts: DataFrame, first: Column) -> DataFrame:
        return parts.select("_key", F.explode(F.aggregate("parts", none, link(first))).alias("p")).select("_key", "p._part", F.col("p.start").alias("_start"))

    listed = F.sort_array(F.collect_list(F.struct("_part", *STATES))).alias("parts")
    if not level:
        return begun(leads.groupBy("_key").agg(listed), F.lit(CLEAN))
    groups = leads.groupBy("_key", F.floor(F.col("_part") / LINKS).alias("_group")).agg(listed)
    whole = [F.aggregate("parts", F.lit(s), _follow).alias(s) for s in STATES]
    above = _starts(groups.select("_key", F.col("_group").alias("_part"), *whole), level - 1)
    return begun(groups.join(above.withColumnRenamed("_part", "_group"), ["_key", "_group"]), F.col("_start"))


def settled_records(events: DataFrame, keys: list[str], order: str, symptom: str, guarded: DataFrame) -> DataFrame:
    """(keys, symptom, n, last, status) of the failures that were run: unresolved until the command next succeeds.

    guarded is guard_batch of the events; attempts it refused weren't run and count neither way.
    One record for each command and symptom, as failures are recorded.
    """
    ran = guarded.where("not refused")
    good = F.coalesce("ok", F.lit(False))
    solved = ran.where(good).groupBy(*keys).agg(F.max(order).alias("solved"))
    failed = ran.where(~good).groupBy(*keys, symptom).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
    same = failed
    for k in keys:
        solved = solved.withColumnRenamed(k, f"_{k}")
    joined = same.join(solved, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    status = F.when(F.col("solved") > F.col("last"), "resolved").otherwise("unresolved")
    return joined.select(*keys, symptom, "n", "last", status.alias("status"))


def next_state(state: str, ok: bool | None, retry: bool | None) -> tuple[str, bool]:
    """(state after, refused) of one attempt."""
    if state == BLOCKING and not retry:
        return BLOCKING, True
    if ok:
        return CLEAN, False
    return (RECORDED if state == CLEAN else BLOCKING), False


def failure_records(events: DataFrame) -> DataFrame:
    """(title, tag, command, symptom, n, last_id): one record for each command and symptom, as it would be stored."""
    symptom = F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace("symptom", r"\s+", " ")), 1, 300), F.lit("")), F.lit("Command returned a failure."))
    failed = events.where(~F.coalesce("ok", F.lit(False)) & F.col("command").isNotNull()).select("failure_id", "command", symptom.alias("symptom"))
    grouped = failed.groupBy("command", "symptom").agg(F.count(F.lit(1)).alias("n"), F.max("failure_id").alias("last_id"))
    title = F.concat(F.substring("command", 1, 50), F.lit(" "), F.substring(F.sha2(F.concat("command", F.lit("\n"), "symptom"), 256), 1, 8))
    return grouped.select(title.alias("title"), F.concat(F.lit("command-"), F.substring(F.sha2("command", 256), 1, 16)).alias("tag"), "n", "last_id")
