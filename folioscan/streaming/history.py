"""What each session asked last, kept by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscan.operators.panels import HISTORY

RING = "session {0}, change long, entry_no int, ran_at {1}, query string"
STATE = "change long, ran_at array<{0}>, query array<string>"


def history_stream(asked: DataFrame, limit: int = HISTORY, idle: str | None = None) -> DataFrame:
    """asked: a stream of session, ran_at, query.  For every session that asks
    something, its newest `limit` questions from 1, as `panels.history` gives them
    for a table; change counts a session's updates, so of several rings of a session
    the one with the greatest change holds.  The state of a session is that ring
    alone; with idle (milliseconds) a session that is silent so long is forgotten."""
    kinds = dict(asked.dtypes)

    def ring(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        change, times, texts = state.get if state.exists else (0, [], [])
        for part in parts:
            both = list(zip([*part["ran_at"], *times], [*part["query"], *texts], strict=True))
            newest = sorted(both, key=lambda e: e[0], reverse=True)[:limit]
            times, texts = [t for t, _ in newest], [q for _, q in newest]
        change += 1
        state.update((change, times, texts))
        if idle:
            state.setTimeoutDuration(int(idle))
        rows = {"session": key[0], "change": change, "entry_no": range(1, len(times) + 1), "ran_at": times, "query": texts}
        yield pd.DataFrame(rows)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return asked.select("session", "ran_at", "query").groupBy("session").applyInPandasWithState(
        ring, RING.format(kinds["session"], kinds["ran_at"]), STATE.format(kinds["ran_at"]), "update", timeout
    )
