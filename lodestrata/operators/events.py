"""Measures of timestamped events: counts, coverage and rhythm for each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantiles, rules
from ..functions.observe import ratio, rounded, rounded_duration
from ..functions.ordering import with_previous
from ..plans.surrogate import Frames

DAY = 86_400_000_000
HOUR = DAY // 24


def first_of_duplicates(events: DataFrame) -> DataFrame:
    """One row for each event_id, the first in time."""
    rest = [c for c in events.columns if c not in ("event_id", "micros")]
    return events.groupBy("event_id").agg(F.min(F.struct("micros", *rest)).alias("e")).select("event_id", "e.micros", *(F.col("e")[c].alias(c) for c in rest))


def archive_summary(f: Frames) -> DataFrame:
    """Events by repository, by day and by type, in one pass."""
    rows = f.events.select("repository", F.col("day").cast("string").alias("day"), "event_type")
    sets = rows.groupingSets([["repository"], ["day"], ["event_type"]], "repository", "day", "event_type").agg(F.count("*").alias("events"), F.grouping_id().alias("g"))
    # the id has a bit for each column that is summed over, the first column's the highest
    level = F.when(F.col("g") == 3, "repository").when(F.col("g") == 5, "day").otherwise("event_type")
    return sets.select(level.alias("level"), F.coalesce("repository", "day", "event_type").alias("key"), "events")


def source_coverage(f: Frames) -> DataFrame:
    """Source hours with events against the hours of the window (whole days from first to last), by repository."""
    window = f.events.agg(((F.datediff(F.max("day"), F.min("day")) + 1) * 24).cast("long").alias("expected"))
    seen = f.events.groupBy("repository").agg(F.countDistinct(F.floor(F.col("micros") / HOUR)).alias("observed"))
    out = seen.crossJoin(F.broadcast(window))  # one row
    return out.select("repository", "observed", "expected", (F.col("expected") - F.col("observed")).alias("missing"), ratio(F.col("observed"), F.col("expected"), 12).alias("rate"), F.when(F.col("observed") == F.col("expected"), "complete").otherwise("partial").alias("status"))


def _gaps(f: Frames) -> DataFrame:
    back = with_previous(f.events.select("repository", "event_id", "day", "micros"), ["repository"], F.col("day"), ["micros", "event_id"], {"micros": "before"})
    return back.where("before IS NOT NULL").select("repository", ((F.col("micros") - F.col("before")) / F.lit(float(HOUR))).alias("gap"))


def _days(f: Frames) -> DataFrame:
    return f.events.groupBy("repository", "day").agg(F.count("*").alias("n"))


def _upper_median(x: str):
    """The element at n // 2 of the sorted values: of days in a window, so the list is short."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def event_rhythm(f: Frames, exact: bool = False) -> DataFrame:
    """Active days, gaps, same-day and burst shares, release interval and shape of each repository's events.

    `exact` is the variant for bound exports: true medians, and quartiles that are rounded
    only after they were subtracted.
    """
    span = f.events.agg((F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("window_days"))
    days = _days(f)
    middle = F.median("n") if exact else _upper_median("n")
    per = days.groupBy("repository").agg(F.count("*").alias("active_days"), F.sum("n").alias("events"), middle.cast("double").alias("median_day"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("same_day"))
    bursts = days.join(per.select("repository", "median_day"), "repository").groupBy("repository").agg(F.count_if(F.col("n") >= F.greatest(F.lit(2.0), 2 * F.col("median_day"))).alias("burst_days"))
    points = {"gap_median": quantiles.linear(0.5), "low": quantiles.linear(0.25), "high": quantiles.linear(0.75)}
    gaps = quantiles.quantiles(_gaps(f), ["repository"], F.col("gap"), points).withColumnRenamed("n", "gaps")
    low, high = F.col("low"), F.col("high")
    iqr = rounded(high - low) if exact else rounded(rounded(high) - rounded(low))
    releases = f.events.where("event_type = 'ReleaseEvent'").select("repository", "event_id", "day", "micros")
    between = with_previous(releases, ["repository"], F.trunc("day", "month"), ["micros", "event_id"], {"micros": "before"}).where("before IS NOT NULL")
    middle = quantiles.linear(0.5) if exact else quantiles.upper_middle()
    interval = quantiles.quantiles(between, ["repository"], (F.col("micros") - F.col("before")) / F.lit(float(DAY)), {"interval": middle}).drop("n")
    out = per.join(bursts, "repository").join(gaps, "repository", "left").join(interval, "repository", "left").crossJoin(F.broadcast(span))
    burst_share = F.col("burst_days") / F.col("active_days")
    shape = F.when((F.col("events") < rules.SHAPE_EVENTS) | (F.col("active_days") < rules.SHAPE_DAYS), "not_proven:insufficient_population").when(F.col("window_days") < rules.SHAPE_WINDOW, "not_proven:window_too_short_for_shape").when((F.col("burst_days") > 0) & (burst_share >= 0.5), "burst").otherwise("constant")
    return out.select(
        "repository",
        "events",
        "window_days",
        ratio(F.col("active_days"), F.col("window_days")).alias("active_day_share"),
        rounded(F.col("gap_median")).alias("gap_median_hours"),
        F.when(F.col("gaps") >= 4, iqr).alias("gap_iqr_hours"),
        ratio(F.col("same_day"), F.col("events")).alias("same_day_share"),
        ratio(F.col("burst_days"), F.col("active_days")).alias("burst_day_share"),
        rounded(F.col("interval")).alias("release_interval_days"),
        shape.alias("shape"),
    )


def _medians(rows: DataFrame, key: str, value: Column, kinds: dict[str, str]) -> DataFrame:
    """`key` and the median of `value` of each kind, as a column of its name."""
    points = quantiles.quantiles(rows.where(F.col("kind").isin(*kinds)), [key, "kind"], value, {"median": quantiles.linear(0.5)})
    return points.groupBy(key).agg(*(F.max(F.when(F.col("kind") == kind, F.col("median"))).alias(name) for kind, name in kinds.items()))


def tracker_summary(f: Frames) -> DataFrame:
    """Event counts, hours from opening to triage and closing, and the share of linked issues, by project."""
    rows = f.tracker
    opened = rows.where("kind = 'issue_opened'").select("project", "record_id", F.col("sec").alias("start"))
    hours = (F.col("sec") - F.col("start")) / F.lit(3600.0)
    timed = rows.join(opened, ["project", "record_id"], "left")
    out = timed.groupBy("project").agg(
        F.count("*").alias("events"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in ("issue_opened", "issue_triaged", "issue_closed", "issue_linked"))
    )
    medians = _medians(timed, "project", hours, {"issue_triaged": "triage", "issue_closed": "close"})
    out = out.join(medians, "project", "left")
    return out.select("project", "events", "issue_opened", "issue_triaged", "issue_closed", "issue_linked", rounded_duration(F.col("triage")).alias("triage_median_hours"), rounded_duration(F.col("close")).alias("close_median_hours"), ratio(F.col("issue_linked"), F.col("issue_opened")).alias("linked_issue_share"))


def lifecycle_summary(f: Frames) -> DataFrame:
    """Active days, duration medians, release interval and linked shares of each project."""
    rows = f.lifecycle
    times = ("created", "in_progress", "first_review", "merged", "closed", "released")
    days = rows.select("project", F.explode(F.array_compact(F.array(*times))).alias("sec")).groupBy("project").agg(F.countDistinct(F.floor(F.col("sec") / 86400)).alias("active_days"))

    # hours from the creation, of issues and pull requests
    spans = {"issue_to_progress_hours": ("issue", "in_progress"), "issue_to_closed_hours": ("issue", "closed"), "pr_to_review_hours": ("pull_request", "first_review"), "pr_to_merged_hours": ("pull_request", "merged")}
    each = F.array(*(F.struct(F.lit(name).alias("kind"), F.when(F.col("record_type") == kind, (F.col(to) - F.col("created")) / F.lit(3600.0)).alias("hours")) for name, (kind, to) in spans.items()))
    medians = _medians(rows.select("project", F.explode(each).alias("s")).select("project", "s.*"), "project", F.col("hours"), {name: name for name in spans})
    issue, release = F.col("record_type") == "issue", F.col("record_type") == "release"
    out = rows.groupBy("project").agg(
        F.count_if(release).alias("releases"),
        F.count_if(issue).alias("issues"),
        F.count_if(issue & F.col("linked").isNotNull()).alias("linked_issues"),
    )
    shipped = rows.where(release & F.col("released").isNotNull()).select("project", "record_id", "released")
    gaps = with_previous(shipped, ["project"], F.floor(F.col("released") / (86400 * 31)), ["released", "record_id"], {"released": "before"}).where("before IS NOT NULL")
    interval = quantiles.quantiles(gaps, ["project"], (F.col("released") - F.col("before")) / F.lit(86400.0), {"median": quantiles.linear(0.5)}).select("project", rounded_duration(F.col("median")).alias("release_interval_days"))
    out = out.join(medians.select("project", *(rounded_duration(F.col(name)).alias(name) for name in spans)), "project", "left")
    return out.join(days, "project").join(interval, "project", "left").select("*", ratio(F.col("linked_issues"), F.col("issues")).alias("linked_issue_share")).drop("linked_issues")


def lifecycle_violations(f: Frames) -> DataFrame:
    """How many lifecycle rows break each rule."""
    c = F.col
    issue, pr = c("record_type") == "issue", c("record_type") == "pull_request"
    broken = {
        "created_missing": c("created").isNull(),
        "issue_with_review": issue & (c("first_review").isNotNull() | c("merged").isNotNull() | c("released").isNotNull()),
        "open_issue_in_progress": issue & (c("state") == "O") & c("in_progress").isNotNull(),
        "closed_issue_without_close": issue & (c("state") == "F") & c("closed").isNull(),
        "pr_with_progress": pr & (c("in_progress").isNotNull() | c("released").isNotNull()),
        "merged_pr_without_merge": pr & (c("state") == "F") & c("merged").isNull(),
        "open_pr_with_review": pr & (c("state") == "O") & c("first_review").isNotNull(),
        "release_without_release": (c("record_type") == "release") & c("released").isNull(),
        "issue_out_of_order": issue & ((c("in_progress") < c("created")) | (c("closed") < c("in_progress"))),
        "pr_out_of_order": pr & ((c("first_review") < c("created")) | (c("merged") < c("first_review"))),
    }
    out = f.lifecycle.agg(*(F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in broken.items()))
    return out.unpivot([], list(broken), "rule", "violations")


def lifecycle_links(f: Frames) -> DataFrame:
    """Linked records by project: found, missing, and linked to the wrong kind."""
    rows = f.lifecycle.select("project", "record_id", "record_type", "linked")
    target = rows.select("project", F.col("record_id").alias("linked"), F.col("record_type").alias("other"))
    out = rows.where("linked IS NOT NULL").join(target, ["project", "linked"], "left")
    return out.groupBy("project").agg(F.count("*").alias("links"), F.count_if(F.col("other").isNull()).alias("broken"), F.count_if(F.col("other").isNotNull() & ~(((F.col("record_type") == "issue") & (F.col("other") == "pull_request")) | ((F.col("record_type") == "pull_request") & (F.col("other") == "issue")))).alias("wrong_kind"))


def sequence_violations(f: Frames) -> DataFrame:
    """Tracker events that don't follow from the record's state before, by kind.

    A record has a few events, so its window is small.
    """
    states = f.tracker.where("kind <> 'issue_linked'")
    order = Window.partitionBy("project", "record_id").orderBy("sec", "pos")
    back = states.select("kind", F.lag("state").over(order).alias("before"))
    bad = F.when(F.col("kind") == "issue_opened", F.col("before").isNotNull()).when(F.col("kind") == "issue_triaged", ~F.col("before").eqNullSafe("open")).otherwise(~F.coalesce(F.col("before").isin("open", "triaged"), F.lit(False)))
    return back.groupBy("kind").agg(F.count("*").alias("events"), F.count_if(bad).alias("violations"))


def record_window(f: Frames) -> DataFrame:
    """First and last instant of each project's records: created, else released, else closed."""
    at = F.coalesce("created", "released", "closed")
    return f.lifecycle.groupBy("project").agg(F.min(at).alias("first_sec"), F.max(at).alias("last_sec"))
