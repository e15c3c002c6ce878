"""Gates, declared comparisons, evidence merges and cross-field checks over the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.observe import gated, ratio
from ..functions.ordering import running_sum
from ..plans.surrogate import Frames
from ..streaming import coverage
from . import commits, paths

#: Days up to which a report looks, actors who consent, and repositories whose history was fetched in part.
AS_OF = "1996-06-30"
CONSENTING = ("building", "automobile", "machinery")
SHALLOW = 4
#: Surfaces that are declared, with the least share where one is.
DECLARED_SURFACES = (("backend", None), ("data", 0.1), ("docs", 0.5), ("frontend", None), ("platform", 0.05))
#: Stored upper bounds of the first nine deciles of a rate.
DECILE_BOUNDS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9)
EVENT_VOCABULARY = ("PushEvent", "IssuesEvent", "PullRequestEvent", "ReleaseEvent")


def as_of(f: Frames) -> DataFrame:
    """Commits, actors and last day of each repository up to the cutoff day, by the UTC clock; later commits do not exist for it."""
    rows = f.scoped.where(F.col("author_sec") < (F.unix_date(F.lit(AS_OF).cast("date")).cast("long") + 1) * 86_400)
    return rows.groupBy("repo").agg(F.count("*").alias("commits"), F.countDistinct("actor").alias("actors"), F.max("local_day").cast("string").alias("last_day"))


def consented(f: Frames) -> DataFrame:
    """Commits of each actor who consents; of others only that there is no consent."""
    ok = F.col("actor").isin(*CONSENTING)
    rows = f.scoped.groupBy("repo", "actor").agg(F.count("*").alias("n"))
    return rows.select("repo", "actor", F.when(ok, F.col("n")).alias("commits"), F.when(~ok, "no_consent").alias("reason"))


def history_gate(f: Frames) -> DataFrame:
    """Span of a repository's history in days, withheld where the history was fetched in part; counts stay."""
    whole = F.col("repo") % SHALLOW != 0
    rows = f.scoped.groupBy("repo").agg(F.count("*").alias("commits"), F.datediff(F.max("local_day"), F.min("local_day")).cast("long").alias("days"))
    return rows.select("repo", "commits", F.when(whole, F.col("days")).alias("span_days"), F.when(~whole, "history_incomplete").alias("reason"))


def cadence_gate(f: Frames) -> DataFrame:
    """Events for each active day of a source, withheld where an hour of its days was not covered."""
    hours = f.events.groupBy("repository", "day", F.floor(F.col("micros") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n"))
    rows = hours.groupBy("repository", "day").agg(F.count("*").alias("hours"), F.sum("n").alias("n")).groupBy("repository").agg(F.sum("n").alias("events"), F.count("*").alias("days"), F.min("hours").alias("least"))
    whole = F.col("least") == 24
    return rows.select("repository", "events", "days", F.when(whole, ratio(F.col("events"), F.col("days"))).alias("events_per_day"), F.when(~whole, "partial_coverage").alias("reason"))


def arrival_gate(f: Frames) -> DataFrame:
    """The gate of the streaming edition over the whole table: rows that came after their day's closing are counted apart."""
    lag = F.make_dt_interval(hours=(F.col("event_id") % 40).cast("int"))
    rows = f.table("events").select(F.concat(F.lit("org/r"), (F.col("user_id") % 8).cast("string")).alias("source"), "event_id", "ts", (F.col("ts") + lag).alias("arrived"))
    return coverage.gate(coverage.covered_days_of(rows))


def presence(f: Frames) -> DataFrame:
    """Each declared surface of a repository: presence, or the share against its floor where one is declared."""
    declared = f.spark.createDataFrame(list(DECLARED_SURFACES), "surface string, floor double")
    rows = paths.surface_profile(f).join(F.broadcast(declared), "surface")  # a handful of surfaces
    share, floor = F.col("share"), F.col("floor")
    seen = F.when(F.col("commits") > 0, "present").otherwise("observed_zero")
    against = F.when(share.isNull(), "not_observed").when(share == 0, "observed_zero").when(share >= floor, "overlap").otherwise("outside_declared_range")
    return rows.select("repo", "surface", "commits", share, seen.alias("presence"), F.when(floor.isNull(), seen).otherwise(against).alias("comparison"))


def founder_timing(f: Frames) -> DataFrame:
    """How many commits of the repository precede each actor's first."""
    place = running_sum(f.scoped.select("repo", "actor", "local_day", "ord"), ["repo"], F.col("local_day"), ["local_day", "ord"], F.lit(1), "place")
    return place.groupBy("repo", "actor").agg((F.min("place") - 1).alias("position"))


def decile_by_bounds(f: Frames) -> DataFrame:
    """The decile of a repository's co-change rate by stored bounds: one more than the bounds below it."""
    below = sum((F.when(F.col("rate") > b, 1).otherwise(0) for b in DECILE_BOUNDS), F.lit(1))
    return commits.test_cochange(f).where("narrate_rate").select("repo", "rate", below.cast("long").alias("decile"))


def actor_measurements(f: Frames) -> DataFrame:
    """Masked actors of a repository: commits, merges and others, and whether the rows add up to the population."""
    rows = f.human.groupBy("repo", F.sha2(F.concat(F.lit("actor:"), F.col("actor")), 256).alias("mask")).agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"), F.count_if(~F.col("is_merge")).alias("nonmerges"))
    whole = rows.groupBy("repo").agg(F.sum("commits").alias("total"), F.count("*").alias("actors"))
    population = commits.population(f).select("repo", (F.col("human_merges") + F.col("human_nonmerge")).alias("population"))
    out = rows.join(whole, "repo").join(population, "repo")
    return out.select("repo", "mask", "commits", "merges", "nonmerges", "actors", (F.col("merges") + F.col("nonmerges") == F.col("commits")).alias("adds_up"), (F.col("total") == F.col("population")).alias("complete"))


def merged_pages(f: Frames) -> DataFrame:
    """Commits of evidence pages by the account that a commit was first seen with; later pages add duplicates, and conflicts where the account differs."""
    seen = f.table("lineitem").select(F.col("l_orderkey").alias("oid"), F.struct(F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("account")).alias("at"))
    by = seen.groupBy("oid").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min("at.account").alias("low"), F.max("at.account").alias("high"))
    return by.groupBy(F.col("first.account").alias("account")).agg(F.count("*").alias("oids"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("low") != F.col("high")).alias("conflicts"))


def account_evidence(f: Frames) -> DataFrame:
    """Evidence commits of each account, and those of them that belong to its actor (the nation of both)."""
    seen = f.table("lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_orderkey").alias("sha")).distinct()
    owned = f.table("supplier").select(F.col("s_suppkey").alias("account"), F.col("s_nationkey").cast("long").alias("own"))
    rows = seen.join(owned, "account").join(f.commits.select("sha", "repo"), "sha")
    kept = F.col("own") == F.col("repo")
    return rows.groupBy("account").agg(F.count("*").alias("evidence"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("foreign"), F.min(F.when(kept, F.col("sha"))).alias("first_kept"))


def named_isolation(f: Frames) -> DataFrame:
    """Customers by how many accounts their commits were seen with; only exactly one may be named."""
    seen = f.table("lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_orderkey").alias("sha"))
    by = seen.join(f.commits.select("sha", "customer"), "sha").groupBy("customer").agg(F.min("account").alias("low"), F.max("account").alias("high"))
    return by.groupBy((F.col("customer") % 100).alias("bucket")).agg(F.count("*").alias("actors"), F.count_if(F.col("low") == F.col("high")).alias("may_be_named"))


def window_violations(f: Frames) -> DataFrame:
    """Records of each project and type whose window ends before it starts."""
    done = F.coalesce("merged", "closed", "released")
    rows = f.lifecycle.where(done.isNotNull())
    return rows.groupBy("project", "record_type").agg(F.count("*").alias("windows"), F.count_if(F.col("created") > done).alias("violations"))


def closed_vocabulary(f: Frames) -> DataFrame:
    """Event types that the list of allowed ones does not hold, with their counts."""
    allowed = f.spark.createDataFrame([(x,) for x in EVENT_VOCABULARY], "event_type string")
    return f.events.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(allowed), "event_type", "left_anti").select("event_type", "n")


def repo_bindings(f: Frames) -> DataFrame:
    """Opaque binding of each repository: SHA-256 of kind and value with a zero byte between them."""
    return f.table("nation").select(F.col("n_nationkey").cast("long").alias("repo"), F.sha2(F.concat(F.lit("repository"), F.char(F.lit(0)), F.lower("n_name")), 256).alias("binding"))


MEASURES = {
    "flt02_as_of": as_of,
    "flt10_consent": consented,
    "flt11_history": history_gate,
    "flt13_cadence": cadence_gate,
    "str_coverage_gate": arrival_gate,
    "cmp03_presence": presence,
    "win06_founder": founder_timing,
    "q_decile_bounds": decile_by_bounds,
    "agg48_measurements": actor_measurements,
    "jn24_pages": merged_pages,
    "jn26_evidence": account_evidence,
    "val16_isolation": named_isolation,
    "val07b_windows": window_violations,
    "val10_vocabulary": closed_vocabulary,
    "fn42_bindings": repo_bindings,
}
