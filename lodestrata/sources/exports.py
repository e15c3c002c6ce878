"""Readers of event, forge, tracker and lifecycle exports, with closed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import utc_instant, zone_rule

# Columns, kinds and states of the export formats.
EVENT_TYPES = ("PushEvent", "IssuesEvent", "IssueCommentEvent", "PullRequestEvent", "PullRequestReviewEvent", "PullRequestReviewCommentEvent", "ReleaseEvent")
EVENT_KEYS = ("event_id", "event_type", "occurred_at", "repository", "action", "ref", "object_number", "release_tag", "push_id")
FORGE_EVENT = "event_id string, kind string, timestamp string, actor_canonical_id string, pr_number int, commit_sha string"
TRACKER_EVENT = "event_id string, kind string, timestamp string, actor_canonical_id string, issue_number int, commit_sha string, record_type string, record_id string, state string, previous_state string, previous_event_id string, linked_event_id string, duration_seconds double"
LIFECYCLE_COLUMNS = ("fixture_kind", "record_type", "record_id", "project_id", "created_at", "in_progress_at", "first_review_at", "merged_at", "closed_at", "release_at", "status", "linked_record_id", "notes")


class ExportError(ValueError):
    """An export that breaks its contract; the message counts and names the first offenders."""


def _require_none(violations: DataFrame, what: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise ExportError(f"{what}: {[r.asDict() for r in found]}")


def read_events(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, strict: bool = True) -> DataFrame:
    """Events of NDJSON files: event_id, event_type, occurred_at (UTC), zone_rule, repository, action.

    Unknown keys and types, missing values and unreadable lines are errors. Of events with
    one id the first in time stays. With a window [start, end) an event outside is an
    error if `strict`, else it is left out.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    known = F.array(*map(F.lit, EVENT_KEYS))
    schema = ", ".join(f"{k} string" for k in EVENT_KEYS)
    rows = raw.select("value", keys.alias("keys"), F.from_json("value", schema).alias("e"))
    at = utc_instant(F.col("e.occurred_at"))
    bad = F.col("keys").isNull() | (F.size(F.array_except("keys", known)) > 0) | ~F.coalesce(F.col("e.event_type").isin(*EVENT_TYPES), F.lit(False)) | F.col("e.event_id").isNull() | F.col("e.repository").isNull() | at.isNull()
    _require_none(rows.where(bad).select("value"), "events that break the schema")
    events = rows.select("e.event_id", "e.event_type", at.alias("occurred_at"), zone_rule(F.col("e.occurred_at")).alias("zone_rule"), "e.repository", "e.action")
    if start and end:
        inside = (F.col("occurred_at") >= F.lit(start).cast("timestamp")) & (F.col("occurred_at") < F.lit(end).cast("timestamp"))
        if strict:
            _require_none(events.where(~inside), "events outside the window")
        events = events.where(inside)
    first = events.groupBy("event_id").agg(F.min(F.struct("occurred_at", "event_type", "zone_rule", "repository", "action")).alias("e"))
    return first.select("event_id", "e.*")


def _export(spark: SparkSession, path: str, event: str) -> DataFrame:
    rows = spark.read.schema(f"schema_version string, provider string, events array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in event.split(','))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select("schema_version", F.posexplode("events").alias("pos", "e")).select("schema_version", "pos", "e.*")
    twice = out.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1 OR event_id IS NULL")
    _require_none(twice, "event ids that are missing or repeated")
    return out.withColumn("ts", utc_instant(F.col("timestamp")))


def read_forge(spark: SparkSession, path: str) -> DataFrame:
    """Events of a forge export, a row each, in the order of the file (`pos`)."""
    return _export(spark, path, FORGE_EVENT)


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Events of a tracker export, a row each, in the order of the file (`pos`)."""
    return _export(spark, path, TRACKER_EVENT)


def read_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a lifecycle CSV, which has exactly the contract's columns; times as UTC."""
    header = spark.read.option("header", True).csv(path)
    if tuple(header.columns) != LIFECYCLE_COLUMNS:
        raise ExportError(f"lifecycle columns: {header.columns}")
    times = [c for c in LIFECYCLE_COLUMNS if c.endswith("_at")]
    rows = header.select(*(utc_instant(F.col(c)).alias(c) if c in times else F.col(c) for c in LIFECYCLE_COLUMNS))
    twice = rows.groupBy("project_id", "record_id").agg(F.count("*").alias("n")).where("n > 1")
    _require_none(twice, "repeated records")
    _require_none(rows.where("created_at IS NULL"), "records without created_at")
    return rows


def lifecycle_summary(rows: DataFrame) -> DataFrame:
    """Active days, median hours and releases of each project."""
    times = ("created_at", "in_progress_at", "first_review_at", "merged_at", "closed_at", "release_at")

    def hours(kind: str, to: str):
        return F.median(F.when(F.col("record_type") == kind, (F.unix_micros(to) - F.unix_micros("created_at")) / F.lit(3.6e9)))

    days = rows.select("project_id", F.explode(F.array_compact(F.array(*times))).alias("t")).groupBy("project_id").agg(F.countDistinct(F.to_date("t")).alias("active_days"))
    out = rows.groupBy("project_id").agg(hours("issue", "closed_at").alias("issue_to_close_hours"), hours("pull_request", "merged_at").alias("pr_to_merge_hours"), F.count_if(F.col("record_type") == "release").alias("releases"))
    return out.join(days, "project_id")
