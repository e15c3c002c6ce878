"""Measures of people: partition, attribution, accounts, roles and experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantiles, rules
from ..functions.observe import gated, ratio, reason, rounded
from ..functions.ordering import running_sum, with_previous
from ..plans.surrogate import Frames


def partition(f: Frames) -> DataFrame:
    """Clusters of a repository's authors by address, else by name, with a readable id where it is unique.

    The display name is the most frequent, ties without case and then as text.
    """
    email, name = rules.normal_email(F.col("author_email")), F.trim("author_name")
    key = F.when(email != "", F.concat(F.lit("email:"), email)).when(name != "", F.concat(F.lit("name:"), F.lower(name)))
    rows = f.human.withColumn("key", key).where("key IS NOT NULL")
    counts = rows.groupBy("repo", "key").agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"))
    names = rows.groupBy("repo", "key", "author_name").agg(F.count("*").alias("n"))
    mode = names.groupBy("repo", "key").agg(F.min(F.struct(-F.col("n"), F.lower("author_name"), "author_name")).alias("m")).select("repo", "key", F.col("m.author_name").alias("display_name"))
    slug = rules.slug(F.col("display_name"))
    joined = counts.join(mode, ["repo", "key"]).withColumn("slug", slug)
    same = joined.groupBy("repo", "slug").agg(F.count("*").alias("same"))
    unique = (F.col("same") == 1) & F.col("slug").isNotNull()
    hashed = F.concat(F.lit("actor_"), F.substring(rules.digest("actor", F.concat(F.col("repo").cast("string"), F.lit("|"), F.col("key"))), 1, 32))
    return joined.join(same, ["repo", "slug"]).select("repo", "key", "commits", "merges", (F.col("commits") - F.col("merges")).alias("nonmerge"), "display_name", F.when(unique, F.col("slug")).otherwise(hashed).alias("actor_id"))


def coverage(f: Frames) -> DataFrame:
    """Commits that have an address, and their share, by repository."""
    known = F.trim("author_email") != ""
    out = f.human.groupBy("repo").agg(F.count("*").alias("total"), F.count_if(known).alias("attributed"), F.countDistinct(F.when(known, rules.normal_email(F.col("author_email")))).alias("actors"))
    return out.select("repo", "actors", "attributed", (F.col("total") - F.col("attributed")).alias("unresolved"), ratio(F.col("attributed"), F.col("total")).alias("coverage"))


def evidence(f: Frames) -> tuple[DataFrame, DataFrame]:
    """The commits (repo, sha, actor, slot) and the accounts (repo, slot, account) that they were seen with: those of their repository and slot."""
    supplier = f.table("supplier").select(F.col("s_nationkey").cast("long").alias("repo"), (F.col("s_suppkey") % 5).alias("slot"), F.col("s_suppkey").alias("account"))
    return f.human.select("repo", "sha", F.col("customer").alias("actor"), (F.col("customer") % 5).alias("slot")), supplier


def recorded_accounts(f: Frames) -> DataFrame:
    """sha and account: a row for each account that a commit was seen with."""
    seen, accounts = evidence(f)
    return seen.join(accounts, ["repo", "slot"]).select("sha", "account")


def account_joins(f: Frames) -> DataFrame:
    """Commits with no, one or several accounts, and accounts claimed by several actors, by repository.

    Accounts are counted by repository and slot before commits meet them, and so are actors.
    """
    seen, accounts = evidence(f)
    keys = ["repo", "slot"]
    slots = seen.groupBy(*keys).agg(F.count("*").alias("commits"), F.min("actor").alias("low"), F.max("actor").alias("high")).join(accounts.groupBy(*keys).agg(F.countDistinct("account").alias("n")), keys, "left")
    n, zero = F.coalesce("n", F.lit(0)), F.lit(0)

    def total(value: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), zero)

    commits = F.col("commits")
    return slots.groupBy("repo").agg(total(commits, n == 0).alias("unmatched"), total(commits, n == 1).alias("matched"), total(commits, n > 1).alias("ambiguous"), total(n, F.col("low") != F.col("high")).alias("conflicts"))


def commit_rule_rows(f: Frames) -> DataFrame:
    """Every commit's subject and address as the rules see them."""
    s, e = F.col("subject"), F.col("author_email")
    return f.commits.select(
        "sha",
        rules.is_corrective(s).alias("corrective"),
        rules.subject_class(s).alias("subject_class"),
        rules.is_conventional(s).alias("conventional"),
        rules.has_issue_link(s).alias("issue_link"),
        rules.is_bot_email(e).alias("bot"),
        (F.trim(e) == "").alias("undecidable"),
        rules.digest("email", rules.normal_email(e)).alias("email_sha256"),
        rules.slug(F.col("author_name")).alias("slug"),
    )


#: Dimensions of a role profile that need a commit's paths, and those that don't.
PATH_DIMENSIONS, OWN_DIMENSIONS = ("domain", "work_type"), ("phase", "calendar_year")


def role_profile(f: Frames, dimensions: tuple[str, ...] = PATH_DIMENSIONS + OWN_DIMENSIONS) -> DataFrame:
    """Shares of an actor's commits by domain, kind of work, third of the own span and year; kinds overlap.

    Of other `dimensions` than all, only these rows are made; lines are read only for those that need a commit's paths.
    """
    status = F.col("status")
    mine = f.scoped.select("repo", "actor", "sha", "author_sec", "subject", F.year("local_day").cast("string").alias("year"))
    span = mine.groupBy("repo", "actor").agg(F.count("*").alias("denominator"), F.min("author_sec").alias("first"), F.max("author_sec").alias("last"))
    elapsed, whole = F.col("author_sec") - F.col("first"), F.col("last") - F.col("first")
    phase = F.when(whole <= 0, "recent").when(elapsed < whole / 3, "early").when(elapsed < whole * 2 / 3, "middle").otherwise("recent")

    def label(dimension: str, when, name):
        return F.when(when, F.struct(F.lit(dimension).alias("dimension"), (F.lit(name) if isinstance(name, str) else name).alias("category")))

    always = F.lit(True)
    domains = F.transform(F.coalesce("domains", F.array(F.lit("unclassified"))), lambda x: F.struct(F.lit("domain").alias("dimension"), x.alias("category")))
    labels = {
        "domain": lambda: domains,
        "work_type": lambda: F.array_compact(F.array(*(label("work_type", F.col(c), c) for c in ("create", "modify", "test", "dependency")), label("work_type", rules.is_corrective(F.col("subject")), "corrective"))),
        "phase": lambda: F.array(label("phase", always, phase)),
        "calendar_year": lambda: F.array(label("calendar_year", always, F.col("year"))),
    }
    rows = mine
    if set(dimensions) & set(PATH_DIMENSIONS):
        flags = f.classified("domain", "any_test", "dependency").select("sha", "status", "domain", F.col("any_test").alias("t"), F.col("dependency").alias("d")).groupBy("sha").agg(
            F.collect_set("domain").alias("domains"), F.bool_or(status.isin("A", "C")).alias("create"), F.bool_or(status.isin("M", "D")).alias("modify"), F.bool_or("t").alias("test"), F.bool_or("d").alias("dependency")
        )
        rows = rows.join(flags, "sha", "left")
    rows = rows.join(span, ["repo", "actor"]).select("repo", "actor", "denominator", F.explode(F.concat(*(labels[d]() for d in dimensions))).alias("l")).select("repo", "actor", "denominator", "l.*")
    out = rows.groupBy("repo", "actor", "dimension", "category", "denominator").agg(F.count("*").alias("n"))
    return out.select("*", gated(ratio(F.col("n"), F.col("denominator")), F.col("denominator")).alias("share"), reason(F.col("denominator")).alias("reason"))


def experience(f: Frames) -> DataFrame:
    """Cadence, timing and share measures of each actor in a repository."""
    mine = f.scoped.select("repo", "actor", "sha", "author_sec", "subject")
    deps = f.changes.groupBy("sha").agg(F.bool_or(rules.is_dependency(F.col("path"))).alias("dependency"), F.count_if(F.col("status") == "A").alias("added"))
    start = mine.groupBy("repo").agg(F.min(F.struct("author_sec", "sha")).alias("s"), F.count("*").alias("repo_commits")).select("repo", F.col("s.author_sec").alias("repo_start"), "repo_commits")
    rows = mine.join(deps, "sha", "left").join(F.broadcast(start), "repo")
    early = F.col("author_sec") < F.col("repo_start") + rules.ADOPTION_DAYS * 86400
    back = with_previous(rows, ["repo", "actor"], F.floor(F.col("author_sec") / (86400 * 31)), ["author_sec", "sha"], {"author_sec": "before"})
    gap = (F.col("author_sec") - F.col("before")) / F.lit(86400.0)
    out = back.groupBy("repo", "actor").agg(
        F.count("*").alias("commits"),
        F.max(gap).alias("longest"),
        F.count_if("dependency").alias("dependency_commits"),
        F.min("author_sec").alias("first_sec"),
        F.first("repo_start").alias("repo_start"),
        F.sum(F.when(early, F.coalesce("added", F.lit(0))).otherwise(0)).alias("scaffold"),
    )
    middle = quantiles.quantiles(back, ["repo", "actor"], gap, {"median": quantiles.linear(0.5)}).drop("n")
    out = out.join(middle, ["repo", "actor"], "left")
    whole = out.groupBy("repo").agg(F.sum("scaffold").alias("scaffold_all"))
    n = F.col("commits")
    return out.join(whole, "repo").select(
        "repo",
        "actor",
        "commits",
        gated(rounded(F.col("median")), n).alias("median_gap_days"),
        gated(rounded(F.col("longest")), n).alias("longest_gap_days"),
        gated(ratio(F.col("dependency_commits"), n), n).alias("dependency_update_share"),
        gated(rounded((F.col("first_sec") - F.col("repo_start")) / F.lit(86400.0)), n).alias("days_after_start"),
        gated(ratio(F.col("scaffold"), F.col("scaffold_all")), F.col("scaffold_all")).alias("scaffold_share"),
    )


def size_points(f: Frames) -> DataFrame:
    """The repository's commits at an actor's first, median (nearest rank) and last contribution."""
    rows = f.scoped.select("repo", "actor", "sha", "author_sec")
    day, order, one = F.floor(F.col("author_sec") / 86400), ["author_sec", "sha"], F.lit(1)
    ranked = running_sum(rows, ["repo", "actor"], day, order, one, "rn")
    counts = rows.groupBy("repo", "actor").agg(F.count("*").alias("n"))
    ranked = ranked.join(counts.where(F.col("n") >= rules.FLOOR), ["repo", "actor"])
    labels = F.array_compact(F.array(F.when(F.col("rn") == 1, "first"), F.when(F.col("rn") == F.floor((F.col("n") - 1) / 2) + 1, "median"), F.when(F.col("rn") == F.col("n"), "last")))
    points = ranked.select("repo", "actor", "sha", "author_sec", "n", F.explode(labels).alias("point"))
    seconds = rows.groupBy("repo", "author_sec").agg(F.count("*").alias("same"))  # commits of one second count together
    upto = running_sum(seconds, ["repo"], day, ["author_sec"], F.col("same"), "commits").select("repo", "author_sec", "commits")
    return points.join(upto, ["repo", "author_sec"]).select("repo", "actor", "point", "sha", F.col("n").alias("contributions"), F.col("commits").alias("repository_commits"))


def self_returns(f: Frames) -> DataFrame:
    """How often actors touch a path of their own again after 180 days or more."""
    rows = f.scoped.select("repo", "actor", "sha", "author_sec").join(f.changes.select("sha", "path"), "sha")
    back = with_previous(rows, ["repo", "actor", "path"], F.floor(F.col("author_sec") / (86400 * 366)), ["author_sec", "sha"], {"author_sec": "before"})
    again = back.where("before IS NOT NULL")
    return again.groupBy("repo", "actor").agg(F.count("*").alias("touches"), F.count_if(F.col("author_sec") - F.col("before") >= rules.RETURN_DAYS * 86400).alias("returns"))
