"""Token budgets: counting, truncation with both ends kept, and ordered packing of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import TOKENS

_TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}|[^\s]")
Counter = Callable[[str], int]


def surrogate(text: str) -> int:
    return len(_TOKEN.findall(text))


def truncate(text: str, budget: float | None) -> str:
    """Text cut to a token budget: 60 % of what fits from the front, the rest from the end, a marker between.

    A budget that is no finite number is 0, and 0 gives an empty text. The marker counts; if not
    even it fits, one ellipsis is left, or nothing.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    limit = int(max(0, budget // 1)) if budget is not None and budget == budget and abs(budget) != float("inf") else 0
    if len(spans) <= limit:
        return text
    if not limit:
        return ""
    kept = limit
    while kept >= 0:
        head = kept * 6 // 10
        tail = kept - head
        marker = f"\n… [{len(spans) - kept} tokens truncated] …\n"
        out = (text[: spans[head - 1][1]] if head else "") + marker + (text[spans[len(spans) - tail][0] :] if tail else "")
        over = surrogate(out) - limit
        if over <= 0:
            return out
        kept -= max(1, over)
    return "…" if limit >= 1 else ""


def truncated(rows: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, text) cut to the budget; nulls stay null. Texts within it never leave the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[truncate(t, budget) for t in pdf["text"]])

    rows = rows.select(F.col(key), F.col(text).alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(TOKENS)), F.lit(0))
    long = rows.where(size > budget).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")
    return rows.where(size <= budget).unionByName(long)


def pack_step(state: tuple[int, int, int], tokens: int, budget: int) -> tuple[int, int, int]:
    """(used, included, dropped) after one more chunk.

    A chunk that doesn't fit is dropped; later, smaller ones may still fit. If more than 100
    tokens are left it is truncated into them and the budget is used up. It counts as dropped
    either way, and with the budget used up nothing more is looked at.
    """
    used, included, dropped = state
    if dropped and used >= budget:
        return state
    if used + tokens <= budget:
        return used + tokens, included + 1, dropped
    if budget - used > 100:
        return budget, included + 1, dropped + 1
    return used, included, dropped + 1


def pack_context(chunks: DataFrame, group: str, key: str, content: str, score: str, budget: int) -> DataFrame:
    """(group, used, included, dropped) of the chunks of every group under one budget.

    Chunks go by score, nulls last, ties by key, and every chunk of a group is looked at. Only
    keys, scores and token counts are shuffled and sorted; a group's chunks then stream through
    one running state, so a group of any size takes no memory of its own.
    """
    counted = chunks.select(F.col(group), F.to_json(F.struct(F.col(group).alias("k"))).alias("_group"), F.col(key).alias("_key"), F.col(score).alias("_score"), F.regexp_count(F.coalesce(F.col(content), F.lit("")), F.lit(TOKENS)).alias("_tokens"))
    ordered = counted.repartition("_group").sortWithinPartitions("_group", F.desc_nulls_last("_score"), "_key").select(group, "_group", "_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, state, kind = None, None, (0, 0, 0), None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *[pa.int64()] * 3])], [group, "used", "included", "dropped"])

        for batch in batches:
            values, out = batch.column(0), []
            kind = values.type
            for k, (g, tokens) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if g != now:
                    if now is not None:
                        out.append((value, *state))
                    now, value, state = g, values[k].as_py(), (0, 0, 0)
                state = pack_step(state, tokens, budget)
            yield packed(out)
        if now is not None:
            yield packed([(value, *state)])

    schema = T.StructType([chunks.schema[group], *[T.StructField(c, T.LongType()) for c in ("used", "included", "dropped")]])
    return ordered.mapInArrow(run, schema)
