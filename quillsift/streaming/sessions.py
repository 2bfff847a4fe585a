"""Advancing sessions by their messages: all at once, or as they arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillsift.functions.session import STATE_SCHEMA, close, new_state, row, step

STATE_COLUMNS = [c.split()[0] for c in STATE_SCHEMA.replace("map<string,string>", "m").replace("map<string,double>", "m").replace("map<string,int>", "m").replace("map<string,array<string>>", "m").split(", ")]


def advance(session_id: str, state: dict, messages: Iterator[str | None], detection: bool = True, purification: bool = True) -> list[dict]:
    """One row for each message; the state is changed."""
    out = []
    for message in messages:
        done = step(state, message, detection, purification)
        out.append(row(session_id, state, done))
        close(state, message)
    return out


def fold(messages: DataFrame, detection: bool = True, purification: bool = True) -> DataFrame:
    """The state after each message of (session_id, turn, message), as rows of STATE_SCHEMA.

    Messages of a session go by turn, then text; a session's rows are the only ones that one task holds together.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["turn", "message"], kind="stable", na_position="first")
        return pd.DataFrame(advance(key[0], new_state(), ordered["message"], detection, purification), columns=STATE_COLUMNS)

    return messages.select(F.col("session_id").cast("string"), "turn", "message").groupBy("session_id").applyInPandas(run, STATE_SCHEMA)


def stream(messages: DataFrame, timeout: str | None = None, detection: bool = True, purification: bool = True) -> DataFrame:
    """fold() for a stream of (session_id, turn, message), in append mode: each message's row leaves with its batch.

    The state is kept as text in Spark's state store, so a restarted query goes on from its checkpoint. With a timeout,
    as in "30 minutes", the state of sessions without messages for that long is dropped, and a later message starts anew.
    """
    waits = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else new_state()
        rows = pd.concat(list(batches)).sort_values(["turn", "message"], kind="stable", na_position="first")
        out = advance(key[0], state, rows["message"], detection, purification)
        held.update((json.dumps(state),))
        if timeout:
            held.setTimeoutDuration(timeout)
        yield pd.DataFrame(out, columns=STATE_COLUMNS)

    keyed = messages.select(F.col("session_id").cast("string"), "turn", "message").groupBy("session_id")
    return keyed.applyInPandasWithState(run, STATE_SCHEMA, "state string", "append", waits)
