"""The repeat-failure guard over a stream of attempts, with one small state for each scope and command."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.failures import CLEAN, next_state

OUT = "failure_id long, state_before string, state_after string, refused boolean"


def guard_stream(events: DataFrame) -> DataFrame:
    """(failure_id, state_before, state_after, refused) of streamed events(failure_id, scope, command, ok, retry_known_failure).

    In a batch a key's events go by failure_id; between batches the order of arrival counts, as
    the guard knows no event time. The state is one word for each key. A null scope and a null
    command are keys of their own.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else CLEAN
        rows = pd.concat(list(batches)).sort_values("failure_id")
        out = []
        for i, ok, retry in zip(rows["failure_id"], rows["ok"], rows["retry_known_failure"]):
            after, refused = next_state(now, ok is not None and bool(ok), retry is not None and bool(retry))
            out.append((i, now, after, refused))
            now = after
        if now == CLEAN:
            if state.exists:
                state.remove()
        else:
            state.update((now,))
        yield pd.DataFrame(out, columns=["failure_id", "state_before", "state_after", "refused"])

    keyed = events.select("failure_id", F.coalesce("scope", F.lit("\x00")).alias("scope"), F.coalesce("command", F.lit("\x00")).alias("command"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("retry_known_failure", F.lit(False)).alias("retry_known_failure"))
    return keyed.groupBy("scope", "command").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)
