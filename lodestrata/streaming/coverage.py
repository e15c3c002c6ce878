"""Coverage of a source's days over a stream: a day closes, its hours are judged, and what comes later is counted apart.

Rows have source, event_id, ts (when it happened) and arrived (when it came in), which
never falls. A day closes GRACE_HOURS after its end by the clock of arrival; whether a row
is late depends on the row alone, so that the batches into which the stream is cut do not
change the result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.observe import ratio

GRACE_HOURS = 2
WHOLE = (1 << 24) - 1
OUTPUT = "source string, day date, kind string, events long, hours int, status string"


def closes(day: Column) -> Column:
    """The instant at which a day closes."""
    return F.timestamp_add("HOUR", F.lit(24 + GRACE_HOURS), day.cast("timestamp"))


class _Day(StatefulProcessor):
    """One source's day: a bit for each hour with events, and the ids seen, until it closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "event_id string", "seen boolean")
        self.seen = handle.getValueState("seen", "events long, bits int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events, bits = self.seen.get() if self.seen.exists() else (0, 0)
        late, close = 0, None
        for r in rows:
            close = r.close_ms
            if r.late:
                late += 1
            elif not self.ids.containsKey((r.event_id,)):
                self.ids.updateValue((r.event_id,), (True,))
                events, bits = events + 1, bits | 1 << r.hour
        if events:
            if not self.seen.exists():
                self.handle.registerTimer(close)
            self.seen.update((events, bits))
        if late:
            yield Row(source=key[0], day=key[1], kind="late", events=late, hours=None, status=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        events, bits = self.seen.get()
        self.seen.clear()
        self.ids.clear()
        yield Row(source=key[0], day=key[1], kind="closed", events=events, hours=bits.bit_count(), status="complete" if bits == WHOLE else "partial")


def day_rows(rows: DataFrame) -> DataFrame:
    """The rows with day, hour, and whether they came after their day's closing."""
    day = F.to_date("ts")
    return rows.select("source", day.alias("day"), F.col("event_id").cast("string").alias("event_id"), F.hour("ts").alias("hour"), "arrived", (F.col("arrived") >= closes(day)).alias("late"), F.unix_millis(closes(day)).alias("close_ms"))


def covered_days(events: DataFrame) -> DataFrame:
    """OUTPUT rows of a stream: `closed` once for each day that had events in time, `late` with the rows that came after its closing, for each batch that has any.

    A timer closes the day, so that a day without further rows closes too. State is the ids
    of the open days; a closed day keeps none.
    """
    rows = day_rows(events).withWatermark("arrived", "0 seconds")
    return rows.groupBy("source", "day").transformWithState(_Day(), OUTPUT, "append", "eventTime")


def covered_days_of(events: DataFrame) -> DataFrame:
    """What `covered_days` has given when all days are closed, from a table: `late` in one row for each day."""
    rows = day_rows(events)
    on_time = rows.where("NOT late").groupBy("source", "day").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("hour").cast("int").alias("hours"))
    closed = on_time.select("source", "day", F.lit("closed").alias("kind"), "events", "hours", F.when(F.col("hours") == 24, "complete").otherwise("partial").alias("status"))
    late = rows.where("late").groupBy("source", "day").agg(F.count("*").alias("events"))
    return closed.unionByName(late.select("source", "day", F.lit("late").alias("kind"), "events", F.lit(None).cast("int").alias("hours"), F.lit(None).cast("string").alias("status")))


def gate(days: DataFrame) -> DataFrame:
    """Events for each active day of a source over OUTPUT rows, withheld where a day was covered in part; late rows are told beside it."""
    closed = F.col("kind") == "closed"
    out = days.groupBy("source").agg(
        F.coalesce(F.sum(F.when(closed, F.col("events"))), F.lit(0)).alias("events"), F.count_if(closed).alias("days"), F.count_if(closed & (F.col("status") == "partial")).alias("partial_days"), F.coalesce(F.sum(F.when(~closed, F.col("events"))), F.lit(0)).alias("late")
    )
    whole = (F.col("partial_days") == 0) & (F.col("days") > 0)
    return out.select("*", F.when(whole, ratio(F.col("events"), F.col("days"))).alias("events_per_day"), F.when(~whole, "partial_coverage").alias("reason"))
