"""Event counts and record states over streams of the event schema.

The inputs are streaming frames with event_id, ts, repository and event_type, or with
project, record_id, kind and ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The state that each kind leads to, and the states it may come from.
NEXT_STATE = {"issue_opened": "open", "issue_triaged": "triaged", "issue_closed": "closed"}
FROM_STATES = {"issue_opened": (None,), "issue_triaged": ("open",), "issue_closed": ("open", "triaged")}


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events for each day, repository and type; ids count once within the delay, later rows are dropped.

    State is one row for each id within the delay and one for each open day.
    """
    rows = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "repository", "event_type").agg(F.count("*").alias("events"))
    return out.select(F.to_date("w.start").alias("day"), "repository", "event_type", "events")


def hourly_coverage(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Repositories and hours that have events: what coverage counts."""
    rows = events.withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "repository").agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "repository", "events")


def in_window(start: Column, end: Column) -> Column:
    """Half open: what is outside is counted apart, not silently lost."""
    return (F.col("ts") >= start) & (F.col("ts") < end)


def record_states(events: DataFrame) -> DataFrame:
    """(project, record_id, kind, state, valid) of each event, checked against the record's state so far.

    A record's state is one word; events of a record within a batch are taken in time's order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for kind in rows["kind"]:
            valid = kind in NEXT_STATE and now in FROM_STATES[kind]
            now = NEXT_STATE[kind] if valid else now
            out.append((*key, kind, now, valid))
        state.update((now,))
        yield pd.DataFrame(out, columns=["project", "record_id", "kind", "state", "valid"])

    return events.groupBy("project", "record_id").applyInPandasWithState(step, "project long, record_id long, kind string, state string, valid boolean", "state string", "append", GroupStateTimeout.NoTimeout)
