"""Chains of tracker events: each event names the one before it, and some name another that they are linked to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.surrogate import Frames
from ..sources.staging import staged, staged_count

#: By how many seconds a duration may differ from its timestamps.
TOLERANCE = 1e-6
FIRST_KINDS = ("issue_opened", "milestone_set")
LINKABLE = ("open", "triaged")
SCHEMA = "project long, event_id long, position long, record_type string, record_id long, kind string, state string, previous_event_id long, previous_state string, linked_event_id long, sec double, duration_seconds double"


def roots(events: DataFrame) -> DataFrame:
    """event_id, root, depth and cyclic: where the chain of predecessors begins; null and cyclic if it runs in a circle.

    The way doubles each round, and only events that have not come to their root go on. An
    event that is open after `reach` steps has all further events of its way open before it,
    so that who moves on beyond `most` steps is in a circle or leads into one.
    """
    asks = events.where("previous_event_id IS NOT NULL").select("event_id", "previous_event_id")
    known = events.select(F.col("event_id").alias("previous_event_id"), F.lit(True).alias("known"))
    starts = events.where("previous_event_id IS NULL").select("event_id", F.col("event_id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("open"))
    step = F.when(F.col("known"), F.col("previous_event_id"))
    first = asks.join(known, "previous_event_id", "left").select("event_id", F.coalesce(step, "event_id").alias("root"), step.isNotNull().cast("long").alias("depth"), step.isNotNull().alias("open"))
    here, left = staged_count(starts.unionByName(first), "steps", F.col("open"))
    done, reach, most = here.where("NOT open"), 1, left
    while left and reach <= most:
        to = done.unionByName(here.where("open")).select(F.col("event_id").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"), F.col("open").alias("on"))
        moved = here.where("open").join(to, "root").select("event_id", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("on").alias("open"))
        here, left = staged_count(moved, "steps", F.col("open"))
        done, reach = done.unionByName(here.where("NOT open")), reach * 2
        most = min(most, reach + left - 1)
    circles = here.where("open").select("event_id", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    return done.select("event_id", "root", "depth", F.lit(False).alias("cyclic")).unionByName(circles)


def chain_faults(events: DataFrame) -> DataFrame:
    """project, event_id, kind and fault of every fault of the chains; an event may have several.

    Predecessors and targets are met by id, and their position must be smaller. Every kind
    but the first ones needs a predecessor of its own record with the state that the event
    names, and a duration that is the difference of the two times. Only ids go to look for
    them, and only events that name one; the events themselves wait for the answers.
    """
    events = staged(events.where("event_id IS NOT NULL").dropDuplicates(["event_id"]), "events")
    asks = events.where("previous_event_id IS NOT NULL").select("event_id", "previous_event_id", (F.col("kind") != "issue_linked").alias("follows"))
    before = events.select(F.col("event_id").alias("previous_event_id"), F.struct("position", "record_type", "record_id", "state", "sec").alias("p"))
    forks = asks.where("follows").groupBy("previous_event_id").agg(F.count("*").alias("after"))
    met = asks.join(before, "previous_event_id").join(forks, "previous_event_id", "left").select("event_id", "p", "after")
    target = events.select(F.col("event_id").alias("linked_event_id"), F.struct("position", "record_type", "state").alias("t"))
    links = events.where("kind = 'issue_linked' AND linked_event_id IS NOT NULL").select("event_id", "linked_event_id").join(target, "linked_event_id").select("event_id", "t")
    circles = roots(events).where("cyclic").select("event_id", "cyclic")
    rows = events.join(met, "event_id", "left").join(links, "event_id", "left").join(circles, "event_id", "left")
    c, first, linked = F.col, F.col("kind").isin(*FIRST_KINDS), F.col("kind") == "issue_linked"
    there, elapsed = c("p").isNotNull(), c("sec") - c("p.sec")
    same = c("p.record_type").eqNullSafe(c("record_type")) & c("p.record_id").eqNullSafe(c("record_id"))
    broken = {
        "first_has_previous": first & c("previous_event_id").isNotNull(),
        "broken_previous": ~first & ~there,
        "previous_not_earlier": there & (c("p.position") >= c("position")),
        "crosses_records": there & ~same,
        "previous_state_differs": there & ~c("previous_state").eqNullSafe(c("p.state")),
        "duration_missing": ~first & (c("duration_seconds").isNull() | F.isnan("duration_seconds")),
        "negative_duration": there & (elapsed < 0),
        "duration_differs": there & (elapsed >= 0) & (F.abs(c("duration_seconds") - elapsed) > TOLERANCE),
        "branching": ~linked & there & (c("after") > 1),
        "cyclic": c("cyclic"),
        "broken_link": linked & c("t").isNull(),
        "link_not_earlier": linked & (c("t.position") >= c("position")),
        "link_target_unfit": linked & c("t").isNotNull() & ~((c("t.record_type") == "milestone") & (c("t.state") == "active")),
        "linked_when_closed": linked & ~c("state").isin(*LINKABLE),
    }
    return rows.select("project", "event_id", "kind", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in broken.items())))).alias("fault"))


def model_events(f: Frames) -> DataFrame:
    """SCHEMA rows of the model's issues, with milestones for its releases; some predecessors and durations are changed by fixed rules."""
    c, steps = F.col, {"issue_opened": 0, "issue_triaged": 1, "issue_closed": 2, "issue_linked": 3}
    number = F.create_map(*(F.lit(x) for kv in steps.items() for x in kv))
    rows = f.tracker.withColumn("k", number[c("kind")]).select("project", "record_id", "kind", "state", "sec", "k", (c("record_id") * 4 + c("k")).alias("event_id"), c("opened").alias("sec0"), c("triaged").alias("sec1"))
    r = c("record_id")
    to = F.when((c("k") == 2) & c("sec1").isNotNull() & (r % 127 != 0), 1).when(c("k") > 0, 0)
    previous = (
        F.when((c("k") == 0) & (r % 107 == 0), r * 4 + 1)
        .when((c("k") > 0) & (r % 109 == 0), (r - 3) * 4)
        .when((c("k") == 2) & (r % 113 == 0), F.lit(-1))
        .when(to.isNotNull(), r * 4 + to)
    )
    elapsed = c("sec") - F.when(to == 1, c("sec1")).otherwise(c("sec0"))
    issues = rows.select(
        "project", "event_id", (c("sec") * 10 + c("k")).alias("position"), F.lit("issue").alias("record_type"), "record_id", "kind", "state", previous.cast("long").alias("previous_event_id"),
        F.when(to == 1, "triaged").when(to == 0, "open").alias("previous_state"), F.when(c("k") == 3, (r + 2) * 4).alias("linked_event_id"), c("sec").cast("double").alias("sec"),
        F.when(c("k") > 0, elapsed + F.when(r % 101 == 5, 1).when(r % 101 == 6, 1e-7).otherwise(0)).cast("double").alias("duration_seconds"),
    )
    releases = f.lifecycle.where("record_type = 'release'")
    state = F.when(c("record_id") % 10 == 0, "done").otherwise("active")
    none = F.lit(None)
    stones = releases.select(
        "project", (c("record_id") * 4).alias("event_id"), (c("created") * 10).alias("position"), F.lit("milestone").alias("record_type"), "record_id", F.lit("milestone_set").alias("kind"), state.alias("state"),
        none.cast("long").alias("previous_event_id"), none.cast("string").alias("previous_state"), none.cast("long").alias("linked_event_id"), c("created").cast("double").alias("sec"), none.cast("double").alias("duration_seconds"),
    )
    return issues.unionByName(stones)


def fault_counts(f: Frames) -> DataFrame:
    """How often each fault is found in each kind of event."""
    return chain_faults(model_events(f)).groupBy("kind", "fault").agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))


def chain_lengths(f: Frames) -> DataFrame:
    """Chains by their number of steps, and the events that lie in or before circles."""
    events = staged(model_events(f).select("event_id", "previous_event_id"), "tracker")
    return roots(events).groupBy("depth", "cyclic").agg(F.count("*").alias("events"), F.countDistinct("root").alias("chains"))


MEASURES = {"jn13_chain_faults": fault_counts, "val04_chain_lengths": chain_lengths}
