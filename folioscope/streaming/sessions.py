"""State machines over streams of events: the latest state of each session and its broken transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_states(events: DataFrame, session: str, at: str, state: str, allowed: dict[str, tuple[str, ...]], late: str = "10 minutes", idle_seconds: int = 3600) -> DataFrame:
    """(session, n_events, n_invalid, state) of each session that a trigger touched.

    events: a stream; it is deduplicated by nothing, ordered by time within a trigger, and watermarked
    by `late`.  A transition that `allowed` doesn't name counts as invalid, but the state moves on.
    Null sessions are ignored.  The state of a session is let go idle_seconds of event time after its
    last event; should it come back, it begins anew.
    """
    legal = {(a, b) for a, bs in allowed.items() for b in bs}

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        n, bad, now = held.get if held.exists else (0, 0, "")
        rows = pd.concat(list(batches)).sort_values([at, state])
        for s in rows[state]:
            n, bad, now = n + 1, bad + ((now, s) not in legal), s
        held.update((n, bad, now))
        last = int(rows[at].max().timestamp() * 1000)
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + idle_seconds * 1000)
        yield pd.DataFrame({session: [str(key[0])], "n_events": [n], "n_invalid": [bad], "state": [now]})

    rows = events.where(f"{session} is not null").withWatermark(at, late).select(session, at, state)
    schema = f"{session} string, n_events long, n_invalid long, state string"
    return rows.groupBy(session).applyInPandasWithState(update, schema, "n long, bad long, now string", "update", GroupStateTimeout.EventTimeTimeout)
