"""Claims of reports and exports, checked field against field and table against table.

The claims are measures of the model, written down as a report has them, with some values
changed by a fixed rule: what they are checked against comes from other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.constraints import Rule, Subset, Total, Unique, check, off
from ..functions.observe import ratio
from ..plans.surrogate import Frames
from ..sources.staging import staged
from . import commits, events, people


def report_tables(f: Frames) -> dict[str, DataFrame]:
    """index and blocks by repository, cards and periods by actor, accounts, hours by source, records, and the actors that were selected."""
    c = F.col
    f.keep("heads")  # one row for each repository, read by several measures
    cards = f.human.groupBy("repo", "actor").agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"), F.min("author_sec").alias("first_sec"), F.max("author_sec").alias("last_sec"))
    changed = (c("repo") % 5 == 3) & (c("actor") == "building")
    cards = cards.select("repo", "actor", "commits", "merges", (c("commits") - c("merges") + F.when(changed, 1).otherwise(0)).alias("nonmerges"), "first_sec", F.when(changed, c("first_sec") - 1).otherwise(c("last_sec")).alias("last_sec"))
    cards = staged(cards, "cards")  # one row for each repository and actor, read by five constraints
    index = commits.population(f).select("repo", (c("human_merges") + c("human_nonmerge") + (c("repo") % 7 == 2).cast("int")).alias("population"))
    cochange = commits.test_cochange(f).select("repo", c("population").alias("prod_commits"), "cochanged", "rate")
    rework = commits.rework(f).select("repo", "retouch", "corrective", c("population").alias("rework_population"))
    activity = commits.activity(f).select("repo", c("commits").alias("scope_commits"), "active_days", "per_day")
    blocks = cochange.join(rework, "repo").join(activity, "repo").withColumn("rate", F.when(c("repo") % 6 == 1, F.coalesce(c("rate"), F.lit(0.0)) + 0.5).otherwise(c("rate"))).withColumn("corrective", F.when(c("repo") % 8 == 4, c("retouch") + 1).otherwise(c("corrective")))
    years = f.human.groupBy("repo", "actor", F.year("local_day").alias("year")).agg(F.count("*").alias("n")).where((c("repo") != 9) | (c("year") != 1995))
    accounts = f.table("supplier").select(c("s_nationkey").cast("long").alias("repo"), c("s_suppkey").alias("account"))
    statuses = f.heads.select("repo").join(accounts.groupBy("repo").agg(F.count("*").alias("accounts")), "repo", "left").withColumn("accounts", F.coalesce("accounts", F.lit(0)))
    told = F.when(c("accounts") == 0, "unresolved").when((c("accounts") == 1) | (c("repo") % 4 == 1), "resolved").otherwise("ambiguous")
    hours = events.source_coverage(f).withColumn("missing", c("missing") + (c("repository") == "org/r3").cast("int")).withColumn("status", F.when(c("repository") == "org/r5", F.when(c("status") == "complete", "partial").otherwise("complete")).otherwise(c("status")))
    records = f.lifecycle.select("project", "record_id", "created", F.coalesce("merged", "closed", "released").alias("done"), F.sha1(c("record_id").cast("string")).alias("oid"))
    records = records.withColumn("oid", F.when(c("record_id") % 211 == 0, F.substring("oid", 1, 39)).otherwise(c("oid")))
    records = records.withColumn("copy", F.explode(F.when(c("record_id") % 307 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    selected = f.scoped.groupBy("repo").agg(F.min("actor").alias("actor")).withColumn("actor", F.when(c("repo") % 9 == 8, "nobody").otherwise(c("actor")))
    roles = people.role_profile(f, ("phase",)).withColumn("n", c("n") + ((c("repo") == 6) & (c("category") == "recent")).cast("int"))
    return {"index": index, "cards": cards, "blocks": blocks, "years": years, "accounts": statuses.withColumn("status", told), "hours": hours, "records": records, "selected": selected, "roles": roles}


def report_rules() -> list[Rule | Unique | Subset | Total]:
    """The constraints, by the survey's groups."""
    c = F.col
    span = (F.lit("1992-01-01"), F.lit("2030-01-01"))
    start, end = (F.unix_date(x.cast("date")).cast("long") * 86400 for x in span)
    return [
        Total("actors_sum_to_population", "index", "cards", ("repo",), "population", "commits"),
        Subset("selected_are_actors", "selected", "cards", ("repo", "actor")),
        Unique("cards_are_unique", "cards", ("repo", "actor")),
        Rule("card_parts_add_up", "cards", c("merges") + c("nonmerges") != c("commits")),
        Rule("card_window_in_order", "cards", c("first_sec") > c("last_sec")),
        Total("years_sum_to_card", "cards", "years", ("repo", "actor"), "commits", "n"),
        Rule("account_status_fits", "accounts", ~c("status").eqNullSafe(F.when(c("accounts") == 0, "unresolved").when(c("accounts") == 1, "resolved").otherwise("ambiguous"))),
        Rule("hours_add_up", "hours", c("observed") + c("missing") != c("expected")),
        Rule("hours_status_fits", "hours", (c("missing") == 0) != (c("status") == "complete")),
        Rule("hours_rate_fits", "hours", off(c("rate"), ratio(c("observed"), c("expected"), 12))),
        Unique("record_ids_are_unique", "records", ("project", "record_id")),
        Rule("oid_has_forty_digits", "records", ~c("oid").rlike("^[0-9a-f]{40}$")),
        Rule("record_in_window", "records", ~c("created").between(start, end)),
        Rule("record_ends_after_start", "records", c("done") < c("created")),
        Rule("cochange_parts_fit", "blocks", (c("cochanged") > c("prod_commits")) | (c("prod_commits") > c("scope_commits"))),
        Rule("cochange_rate_fits", "blocks", off(c("rate"), ratio(c("cochanged"), c("prod_commits")))),
        Rule("rework_parts_fit", "blocks", (c("corrective") > c("retouch")) | (c("retouch") > c("rework_population"))),
        Rule("per_day_fits", "blocks", off(c("per_day"), ratio(c("scope_commits"), c("active_days")))),
        Rule("role_share_fits", "roles", (c("denominator") >= rules.FLOOR) & off(c("share"), ratio(c("n"), c("denominator")))),
        Rule("role_share_withheld", "roles", (c("denominator") < rules.FLOOR) & c("share").isNotNull()),
    ]


def claim_violations(f: Frames) -> DataFrame:
    """How many rows break each constraint of the claims."""
    return check(report_tables(f), report_rules())


MEASURES = {"val07_constraints": claim_violations}
