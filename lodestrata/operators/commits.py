"""Measures of commits: activity, co-change, rework, rhythm, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantiles, rules
from ..functions.observe import gated, ratio, reason, rounded
from ..functions.ordering import running_sum, with_previous
from ..plans.surrogate import Frames


def _short(day: str = "local_day") -> Column:
    return F.col(day) >= F.date_sub("head_day", rules.SHORT_WINDOW_DAYS)


def test_cochange(f: Frames) -> DataFrame:
    """How often production changes come with tests, over all time and the last 13 weeks, by repository."""
    rows = f.scoped.join(f.flags, "sha", "left").join(F.broadcast(f.heads), "repo")
    prod, test, docs = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("prod_n", "test_n", "docs_n"))
    out = rows.groupBy("repo").agg(
        F.count_if(prod).alias("population"),
        F.count_if(prod & test).alias("cochanged"),
        F.count_if(~prod & test).alias("test_only"),
        F.count_if(~prod & ~test & docs).alias("docs_only"),
        F.count_if(prod & _short()).alias("population_13w"),
        F.count_if(prod & test & _short()).alias("cochanged_13w"),
    )
    population = F.col("population")
    return out.select(
        "*",
        ratio(F.col("cochanged"), population).alias("rate"),
        ratio(F.col("cochanged_13w"), F.col("population_13w")).alias("rate_13w"),
        (population >= rules.FLOOR).alias("narrate_rate"),
        F.when(population == 0, "no_production_commits").alias("reason"),
    )


def activity(f: Frames) -> DataFrame:
    """Commits, active days and commits for each active day, by repository."""
    days = f.scoped.groupBy("repo", "local_day").agg(F.count("*").alias("n")).join(F.broadcast(f.heads), "repo")
    out = days.groupBy("repo").agg(F.sum("n").alias("commits"), F.count("*").alias("active_days"), F.median("n").alias("per_day_median"), F.count_if(_short()).alias("active_days_13w"))
    return out.select("repo", "commits", "active_days", ratio(F.col("commits"), F.col("active_days")).alias("per_day"), "per_day_median", "active_days_13w")


def core_period(f: Frames) -> DataFrame:
    """The shortest run of months, the earliest of equals, that holds the core share of a repository's commits."""
    months = f.scoped.groupBy("repo", ((F.year("local_day") * 12 + F.month("local_day")) - 1).alias("m")).agg(F.count("*").alias("n"))
    ends = months.groupBy("repo").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.sum("n").alias("total"))
    spine = ends.select("repo", "total", F.explode(F.sequence("a", "b")).alias("m")).join(months, ["repo", "m"], "left")
    up = Window.partitionBy("repo").orderBy("m")  # one row a month
    sums = spine.select("repo", "m", "total", F.sum(F.coalesce("n", F.lit(0))).over(up).alias("upto"), F.coalesce("n", F.lit(0)).alias("n"))
    left = sums.select("repo", F.col("m").alias("first"), (F.col("upto") - F.col("n")).alias("before"), "total")
    right = sums.select("repo", F.col("m").alias("last"), "upto")
    share = (F.col("upto") - F.col("before")) / F.col("total")
    runs = left.join(right, "repo").where((F.col("last") >= F.col("first")) & (share >= rules.CORE_SHARE))
    best = runs.groupBy("repo").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "first", "last", share.alias("share"))).alias("b"))

    def month(m: str) -> Column:
        return F.format_string("%04d-%02d", F.floor(F.col(m) / 12).cast("int"), (F.col(m) % 12 + 1).cast("int"))

    return best.select("repo", month("b.first").alias("start"), month("b.last").alias("end"), rounded(F.col("b.share")).alias("share"))


def retouches(f: Frames) -> DataFrame:
    """repo, sha, recent (whether a production commit touches a path that was touched at most REWORK_DAYS before) and corrective; subjects are read once for each commit and go no further.

    Changes of a path meet by year, and those of a year's last REWORK_DAYS also meet the next year's.
    """
    prod = f.files_touched(where="role = 'prod'")
    rows = f.scoped.select("repo", "sha", "local_day", "ord", rules.is_corrective(F.col("subject")).alias("corrective")).join(prod, "sha")
    year = F.year("local_day")
    years = F.array_distinct(F.array(year, F.year(F.date_add("local_day", rules.REWORK_DAYS))))
    before = F.lag("local_day").over(Window.partitionBy("repo", "file", "year").orderBy("local_day", "ord"))
    back = rows.select("*", F.explode(years).alias("year")).withColumn("before", before).where(F.col("year") == year)
    return back.groupBy("repo", "sha").agg(F.bool_or(F.coalesce(F.datediff("local_day", "before") <= rules.REWORK_DAYS, F.lit(False))).alias("recent"), F.bool_or("corrective").alias("corrective"))


def rework(f: Frames) -> DataFrame:
    """Retouched and corrective production commits, and reverts, by repository."""
    touched = retouches(f).groupBy("repo").agg(F.count("*").alias("population"), F.count_if("recent").alias("retouch"), F.count_if(F.col("recent") & F.col("corrective")).alias("corrective"))
    whole = f.scoped.groupBy("repo").agg(F.count("*").alias("scope_commits"), F.count_if(rules.is_revert(F.col("subject"))).alias("reverts"))
    out = whole.join(touched, "repo", "left")
    return out.select(
        "repo",
        "population",
        "retouch",
        "corrective",
        "reverts",
        "scope_commits",
        ratio(F.col("corrective"), F.col("population")).alias("corrective_rate"),
        ratio(F.col("retouch"), F.col("population")).alias("retouch_rate"),
        ratio(F.col("reverts"), F.col("scope_commits")).alias("revert_rate"),
        (F.col("population") >= rules.FLOOR).alias("narrate_rate"),
    )


#: Source files, and those of them that are somebody else's or made by a tool (fixed values).
SOURCE_FILES = r"\.(py|ts|tsx|js|jsx|go|rs|vue|svelte|astro|swift)$"
NOT_SOURCE = r"node_modules/|vendor/|dist/|build/|\.min\.|generated"


def line_survival(lines: DataFrame, heads: DataFrame, most_files: int = 40, tau_days: float = 180.0) -> DataFrame:
    """Mean decay of line ages in an evenly spaced sample of a repository's source files.

    `lines` has repo, path and author_sec of each surviving line, `heads` repo and head_sec.
    The sample is the feature: every k-th file in name order, `most_files` at most.
    """
    lines = lines.where(F.col("path").rlike(SOURCE_FILES) & ~F.col("path").rlike(NOT_SOURCE))
    files = lines.groupBy("repo", "path").agg(F.count("*").alias("lines"))
    ranked = files.select("repo", "path", F.row_number().over(Window.partitionBy("repo").orderBy("path")).alias("rn"), F.count("*").over(Window.partitionBy("repo")).alias("source_files"))
    step = F.greatest(F.lit(1), F.floor(F.col("source_files") / most_files))
    sample = ranked.where(((F.col("rn") - 1) % step == 0) & (F.floor((F.col("rn") - 1) / step) < most_files))
    aged = lines.join(sample, ["repo", "path"]).join(heads, "repo")
    decay = F.exp(-F.greatest(F.lit(0), F.col("head_sec") - F.col("author_sec")) / F.lit(tau_days * 86400))
    return aged.groupBy("repo").agg(F.countDistinct("path").alias("files_sampled"), F.max("source_files").alias("source_files"), F.count("*").alias("lines_sampled"), rounded(F.avg(decay)).alias("survival_index"))


def survival(f: Frames, most_files: int = 40, tau_days: float = 180.0) -> DataFrame:
    """`line_survival` with each touch of a path as a line."""
    lines = f.changes.join(f.scoped.select("repo", "sha", "author_sec"), "sha")
    return line_survival(lines, f.commits.groupBy("repo").agg(F.max("author_sec").alias("head_sec")), most_files, tau_days)


def rhythm(f: Frames, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Gaps between commits in the closed window of 180 days before a repository's last day."""
    rows = f.scoped.join(F.broadcast(f.heads), "repo")
    inside = F.col("local_day").between(F.date_sub("head_day", rules.RHYTHM_DAYS), F.col("head_day"))
    counts = rows.groupBy(*keys).agg(F.count_if(inside).alias("sample"), F.count_if(~inside).alias("outside"), F.countDistinct(F.when(inside, F.col("local_day"))).alias("active_days"))
    back = with_previous(rows.where(inside), list(keys), F.trunc("local_day", "month"), ["author_sec", "sha"], {"author_sec": "before"})
    gap = (F.col("author_sec") - F.col("before")) / F.lit(86400.0)
    each = back.where("before IS NOT NULL").select(*keys, gap.alias("gap"))
    shares = each.groupBy(*keys).agg(F.avg((F.col("gap") <= 2).cast("int")).alias("burst"), F.avg((F.col("gap") >= 30).cast("int")).alias("long"))
    points = quantiles.quantiles(each, list(keys), F.col("gap"), {"median": quantiles.linear(0.5), "p90": quantiles.linear(0.9)})
    gaps = points.withColumnRenamed("n", "gaps").join(shares, list(keys))
    sample = F.col("sample")
    return counts.join(gaps, list(keys), "left").select(
        *keys,
        "sample",
        "outside",
        "active_days",
        F.coalesce("gaps", F.lit(0)).alias("gaps"),
        gated(rounded(F.col("median")), sample).alias("median_gap_days"),
        gated(rounded(F.col("p90")), sample).alias("p90_gap_days"),
        gated(rounded(F.col("burst")), sample).alias("burst_share_le_2d"),
        gated(rounded(F.col("long")), sample).alias("long_gap_share_ge_30d"),
        reason(sample, empty="no_commits_in_window").alias("reason"),
    )


def coordination(f: Frames) -> DataFrame:
    """Merges, and issue links in subjects, by repository."""
    merge, linked = F.col("is_merge"), rules.has_issue_link(F.col("subject"))
    out = f.human.groupBy("repo").agg(F.count("*").alias("commits"), F.count_if(merge).alias("merges"), F.count_if(~merge).alias("humans"), F.count_if(~merge & linked).alias("linked"))
    return out.select(
        "*",
        gated(ratio(F.col("merges"), F.col("commits")), F.col("commits")).alias("merge_share"),
        gated(ratio(F.col("linked"), F.col("humans")), F.col("humans")).alias("linked_share"),
    )


def context(f: Frames) -> DataFrame:
    """Scale, people, density and conventions of a repository; merges are kept."""
    email = rules.normal_email(F.col("author_email"))
    rows = f.human.withColumn("who", email)
    people = rows.groupBy("repo", "who").agg(F.count("*").alias("n")).groupBy("repo").agg(F.count("*").alias("actors"), F.max("n").alias("top"))
    plain = ~F.col("is_merge")
    out = rows.join(F.broadcast(f.heads), "repo").join(f.flags, "sha", "left").groupBy("repo").agg(
        F.count("*").alias("human_commits"),
        F.count_if("is_merge").alias("merges"),
        F.min("local_day").alias("first_day"),
        F.max("local_day").alias("last_day"),
        F.first("head_day").alias("head_day"),
        F.countDistinct(F.when(F.col("local_day") >= F.date_sub("head_day", rules.RHYTHM_DAYS), F.col("local_day"))).alias("active_days_180d"),
        F.count_if(plain).alias("plain"),
        F.count_if(plain & rules.is_conventional(F.col("subject"))).alias("conventional"),
        F.count_if(plain & rules.has_issue_link(F.col("subject"))).alias("linked"),
        F.count_if(plain & (F.col("n_paths") > 0)).alias("with_paths"),
        F.count_if(plain & (F.col("test_n") > 0)).alias("with_tests"),
        F.count_if(plain & (F.col("docs_n") > 0)).alias("with_docs"),
    )
    out = out.join(people, "repo").withColumn("top_actor_share", ratio(F.col("top"), F.col("human_commits")))
    return out.select(
        "repo",
        "human_commits",
        F.col("actors").alias("resolved_human_actors"),
        "top_actor_share",
        F.when(F.col("top_actor_share") >= rules.SOLO_SHARE, "solo").when(F.col("actors") <= rules.SMALL_TEAM, "small_team").otherwise("community").alias("collaboration_class"),
        ratio(F.col("merges"), F.col("human_commits")).alias("pr_flow_share"),
        F.col("first_day").cast("string").alias("first_commit"),
        F.col("last_day").cast("string").alias("last_commit"),
        F.datediff("last_day", "first_day").cast("long").alias("active_span_days"),
        F.datediff("head_day", "first_day").cast("long").alias("repo_age_days"),
        F.datediff("head_day", "last_day").cast("long").alias("days_since_last"),
        "active_days_180d",
        F.when(F.col("active_days_180d") >= rules.ACTIVE_DAYS_ACTIVE, "active").when(F.col("active_days_180d") >= rules.ACTIVE_DAYS_MAINTAINED, "maintained").otherwise("dormant").alias("lifecycle_stage"),
        ratio(F.col("conventional"), F.col("plain")).alias("conventional_share"),
        ratio(F.col("linked"), F.col("plain")).alias("issue_link_density"),
        ratio(F.col("with_tests"), F.col("with_paths")).alias("test_file_ratio"),
        ratio(F.col("with_docs"), F.col("with_paths")).alias("docs_share"),
    )


def turnover(f: Frames) -> DataFrame:
    """People first and last seen in each year, by repository."""
    seen = f.human.groupBy("repo", rules.normal_email(F.col("author_email")).alias("who")).agg(F.min(F.year("local_day")).alias("first"), F.max(F.year("local_day")).alias("last"))
    joined = seen.groupBy("repo", F.col("first").alias("year")).agg(F.count("*").alias("joined"))
    left = seen.groupBy("repo", F.col("last").alias("year")).agg(F.count("*").alias("last_active"))
    zero = F.lit(0)
    return joined.join(left, ["repo", "year"], "full").select("repo", F.col("year").cast("long").alias("year"), F.coalesce("joined", zero).alias("joined"), F.coalesce("last_active", zero).alias("last_active"))


def release_cadence(f: Frames) -> DataFrame:
    """Tags for each year of a repository's span; null for a span of no days."""
    tags = f.tags.groupBy("repo").agg(F.count("*").alias("tags"))
    span = f.human.groupBy("repo").agg(F.datediff(F.max("local_day"), F.min("local_day")).alias("span_days"))
    tags_n = F.coalesce("tags", F.lit(0))
    return span.join(tags, "repo", "left").select("repo", tags_n.alias("tags"), F.col("span_days").cast("long").alias("span_days"), F.when(F.col("span_days") > 0, rounded(tags_n / (F.col("span_days") / 365.25), 2)).alias("per_year"))


def population(f: Frames) -> DataFrame:
    """Commits of a repository by kind, and the humans' share."""
    bot, merge = F.col("is_bot"), F.col("is_merge")
    out = f.commits.groupBy("repo").agg(F.count("*").alias("commits"), F.count_if(bot).alias("bots"), F.count_if(~bot & merge).alias("human_merges"), F.count_if(~bot & ~merge).alias("human_nonmerge"))
    return out.select("*", ratio(F.col("human_nonmerge"), F.col("commits")).alias("human_nonmerge_share"))


def commit_rows(f: Frames) -> DataFrame:
    """The export row of every commit in the repository scope."""
    zero = F.lit(0)
    counts = {c: F.coalesce(c, zero) for c in ("prod_n", "test_n", "docs_n")}
    return f.scoped.join(f.flags, "sha", "left").select(
        "repo",
        "sha",
        F.col("local_day").cast("string").alias("day"),
        *(v.alias(k) for k, v in counts.items()),
        ((counts["prod_n"] > 0) & (counts["test_n"] > 0)).alias("cochange"),
        rules.subject_class(F.col("subject")).alias("subject_class"),
    )


def engagement(f: Frames) -> DataFrame:
    """Commits, active days and range of each actor in a repository, in the order of their ids."""
    return f.scoped.groupBy("repo", "actor").agg(
        F.count("*").alias("commits"), F.countDistinct("local_day").alias("active_days"), F.min("local_day").cast("string").alias("first_day"), F.max("local_day").cast("string").alias("last_day")
    )


def most_commits(f: Frames, top: int = 3) -> DataFrame:
    """The `top` actors of each repository by commits, ties by id, listed by id: the number is no part of the order."""
    counts = f.scoped.groupBy("repo", "actor").agg(F.count("*").alias("commits"))
    ranked = counts.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("commits"), "actor")))
    return ranked.where(F.col("n") <= top).select("repo", "actor", "commits").orderBy("repo", "actor")


def origin(f: Frames, tenant: str = r"@household\.test$") -> DataFrame:
    """Commits of each origin class by repository, zeros included, with the reason where a class can't be observed.

    There is no upstream lineage, template or parent repository; tenants are known by `tenant`.
    """
    email = rules.normal_email(F.col("author_email"))
    own = F.coalesce("vendor_only", F.lit(False))
    kind = (
        F.when(F.col("is_bot"), "bot")
        .when(own, "generated_or_vendor")
        .when(email.rlike(tenant), F.when(F.col("is_merge"), "tenant_merge_or_sync").otherwise("tenant_unique"))
        .when(email == "", "ambiguous_origin")
        .otherwise("unresolved")
    )
    counts = f.commits.join(f.flags, "sha", "left").groupBy("repo", kind.alias("class")).agg(F.count("*").alias("n"))
    # The classes, and why some can't be observed without lineage.
    classes = (
        ("inherited_upstream", None),
        ("upstream_sync", "no_upstream_lineage"),
        ("tenant_unique", None),
        ("tenant_merge_or_sync", None),
        ("tenant_derivative", "parent_repo_not_provided"),
        ("external_upstream_contribution", "parent_repo_not_provided"),
        ("template_inherited", "template_not_provided"),
        ("generated_or_vendor", None),
        ("ambiguous_origin", None),
        ("unresolved", None),
        ("bot", None),
    )
    every = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(r).cast("string").alias("reason")) for c, r in classes))
    grid = f.heads.select("repo", F.explode(every).alias("c")).select("repo", "c.class", "c.reason")
    return grid.join(counts, ["repo", "class"], "left").select("repo", "class", F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).alias("n"), "reason")


def lineage_counts(f: Frames) -> DataFrame:
    """Incarnations of paths in each repository's linear history, and who modifies what others created.

    A path's incarnation is the number of additions up to a change; a change finds its file
    if an addition came since the last deletion.
    """
    rows = f.scoped.select("repo", "sha", "actor", "local_day", "ord").join(f.changes.select("sha", "path", "status"), "sha")
    keys, order = ["repo", "path"], ["local_day", "ord"]
    born = running_sum(rows, keys, F.year("local_day"), order, (F.col("status") == "A").cast("long"), "incarnation")
    births = born.where("status = 'A'").select("repo", "path", "incarnation", F.col("actor").alias("creator"))
    ends = born.where("status = 'D'").groupBy("repo", "path", "incarnation").agg(F.min(F.struct(*order)).alias("ended"))
    live = born.where("status <> 'A' AND incarnation > 0").join(births, ["repo", "path", "incarnation"]).join(ends, ["repo", "path", "incarnation"], "left")
    alive = F.col("ended").isNull() | (F.struct(*order) <= F.col("ended"))
    modified = F.col("status") == "M"
    touched = live.where(alive).groupBy("repo").agg(F.count_if(modified).alias("modifications"), F.count_if(modified & (F.col("actor") != F.col("creator"))).alias("cross_author"), F.count_if(~modified).alias("deletions"))
    return births.groupBy("repo").agg(F.count("*").alias("creations")).join(touched, "repo", "left").select("repo", "creations", "modifications", "cross_author", "deletions", ratio(F.col("cross_author"), F.col("modifications")).alias("cross_author_share"))
