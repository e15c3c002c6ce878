"""Comparisons: declared requirements, references, groups, classifiers, and differences of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantiles, rules
from ..functions.observe import gated, ratio, rounded
from ..plans.surrogate import Frames
from . import commits, paths

# Fixed values of the declared requirements that the registered queries compare with.
REQUIREMENTS = (("active_days", "min", 200.0), ("rate", "min", 0.4), ("corrective_rate", "max", 0.1), ("median_gap_days", "max", 1.0), ("reverts", "max", 200.0), ("undeclared", "min", None))
TEAM_REQUIREMENTS = (("backend", 0.3), ("data", 0.1), ("frontend", 0.25), ("docs", 0.5), ("platform", 0.1))
SEGMENTS = ("AUTOMOBILE", "BUILDING")
ROLE_LABELS = ("0", "1")


def numeric_compare(value: Column, target: Column, bound: Column) -> Column:
    """overlap, outside_declared_range, observed_zero, not_observed or not_declared."""
    return (
        F.when(target.isNull(), "not_declared")
        .when(value.isNull(), "not_observed")
        .when((bound == "min") & (value == 0), "observed_zero")
        .when(F.when(bound == "min", value >= target).otherwise((value <= target) | (value == 0)), "overlap")
        .otherwise("outside_declared_range")
    )


def repo_metrics(f: Frames) -> DataFrame:
    """Long form: repo, metric, value of the measures that requirements name."""
    parts = [
        commits.activity(f).select("repo", F.lit("active_days").alias("metric"), F.col("active_days").cast("double").alias("value")),
        commits.test_cochange(f).select("repo", F.lit("rate").alias("metric"), F.when(F.col("narrate_rate"), F.col("rate")).alias("value")),
        commits.rework(f).select("repo", F.explode(F.array(F.struct(F.lit("corrective_rate").alias("metric"), F.col("corrective_rate").alias("value")), F.struct(F.lit("reverts").alias("metric"), F.col("reverts").cast("double").alias("value")))).alias("m")).select("repo", "m.*"),
        commits.rhythm(f).select("repo", F.lit("median_gap_days").alias("metric"), F.col("median_gap_days").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alignment(f: Frames) -> DataFrame:
    """Each declared requirement against each repository's measures."""
    declared = f.spark.createDataFrame(list(REQUIREMENTS), "metric string, bound string, target double")
    grid = f.heads.select("repo").crossJoin(F.broadcast(declared))  # a handful of requirements
    out = grid.join(repo_metrics(f), ["repo", "metric"], "left")
    return out.select("repo", "metric", "bound", "target", "value", numeric_compare(F.col("value"), F.col("target"), F.col("bound")).alias("comparison"))


def _actor_shares(f: Frames) -> DataFrame:
    rows = paths.touched(f)
    n = rows.groupBy("repo", "actor").agg(F.countDistinct("sha").alias("n"))
    by = rows.groupBy("repo", "actor", "surface").agg(F.countDistinct("sha").alias("commits"))
    return n.join(by, ["repo", "actor"]).select("repo", "actor", "surface", "commits", "n", gated(ratio(F.col("commits"), F.col("n")), F.col("n")).alias("share"))


def complementarity(f: Frames) -> DataFrame:
    """For each requirement of a team: members who meet it, have any of it, and could be observed; no member is named."""
    declared = f.spark.createDataFrame(list(TEAM_REQUIREMENTS), "surface string, floor double")
    members = paths.touched(f).select("repo", "actor").distinct()
    grid = members.crossJoin(F.broadcast(declared)).join(_actor_shares(f), ["repo", "actor", "surface"], "left")
    verdict = F.when(F.coalesce("commits", F.lit(0)) == 0, "observed_zero").otherwise(numeric_compare(F.col("share"), F.col("floor"), F.lit("min")))
    out = grid.withColumn("v", verdict).groupBy("repo", "surface").agg(
        F.count("*").alias("team_size"),
        F.count_if(F.col("v") != "not_observed").alias("actors_observed"),
        F.count_if(F.col("v") == "overlap").alias("meeting_declared"),
        F.count_if(F.col("v").isin("overlap", "outside_declared_range")).alias("with_any"),
    )
    state = F.when(F.col("actors_observed") == 0, "not_observed").when(F.col("meeting_declared") > 0, "covered").otherwise("below_declared")
    return out.select("*", F.when(F.col("team_size") >= 3, state).otherwise("insufficient_team_size").alias("state"))


def relationship(f: Frames) -> DataFrame:
    """An actor's median gap against the repository's: same direction within a factor of two."""
    a = commits.rhythm(f, ("repo", "actor")).select("repo", "actor", F.col("gaps").alias("actor_n"), F.col("median_gap_days").alias("actor_value"))
    p = commits.rhythm(f).select("repo", F.col("gaps").alias("project_n"), F.col("median_gap_days").alias("project_value"))
    x, y = F.col("actor_value"), F.col("project_value")
    both = a.join(p, "repo").withColumn("n", F.least("actor_n", "project_n"))
    quotient = x / F.nullif(y, F.lit(0.0))
    direction = F.when((x == 0) & (y == 0), "similar_direction").when((x == 0) | (y == 0), "different_direction").when(quotient.between(rules.SIMILAR_LOW, rules.SIMILAR_HIGH), "similar_direction").otherwise("different_direction")
    kind = F.when(x.isNull() | y.isNull(), "not_comparable").when(F.col("n") < rules.FLOOR, "not_proven").otherwise(direction)
    confidence = F.when(x.isNull() | y.isNull(), "not_proven").when(F.col("n") < 5, "insufficient_data").when(F.col("n") < rules.FLOOR, "weak_signal").otherwise("directional_candidate")
    return both.select("repo", "actor", "n", kind.alias("kind"), confidence.alias("confidence"))


def tendency(f: Frames) -> DataFrame:
    """The one surface with the largest share, or that the top is tied, by repository."""
    rows = paths.surface_profile(f).where("share > 0").select("repo", "surface", "share")
    top = rows.groupBy("repo").agg(F.max("share").alias("share"))
    out = rows.join(top, ["repo", "share"]).groupBy("repo", "share").agg(F.count("*").alias("n"), F.min("surface").alias("surface"))
    return out.select("repo", "share", F.when(F.col("n") == 1, F.col("surface")).otherwise("tied_top_share").alias("surface"), rules.share_strength(F.col("share")).alias("strength"))


def distribution(f: Frames) -> DataFrame:
    """The ten points of the repositories' co-change rates, by linear interpolation."""
    rates = commits.test_cochange(f).where("narrate_rate")
    points = [F.lit(k / 9) for k in range(10)]
    out = rates.agg(F.count("*").alias("n"), F.percentile("rate", F.array(*points)).alias("p"))
    return out.select("n", F.posexplode("p").alias("point", "x")).select("n", F.col("point").cast("long").alias("point"), rounded(F.col("x")).alias("bound"))


#: Values that a stratum needs for points of its own.
STRATUM_FLOOR = 30


def strata(f: Frames) -> DataFrame:
    """Quartiles (by the exclusive method, from four values on) and ten linear points of the balances in each stratum of two dimensions, and of all.

    A stratum with fewer than STRATUM_FLOOR values has its number and the reason only.
    """
    rows = f.table("customer").select(F.col("c_acctbal").alias("v"), F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("stratum")), F.struct(F.lit("segment").alias("dimension"), F.col("c_mktsegment").alias("stratum")), F.struct(F.lit("nation").alias("dimension"), F.col("c_nationkey").cast("string").alias("stratum"))).alias("s"))
    points = {"q1": quantiles.exclusive(0.25), "median": quantiles.linear(0.5), "q3": quantiles.exclusive(0.75), **{f"p{k}": quantiles.linear(k / 9) for k in range(10)}}
    out = quantiles.quantiles(rows.select(F.explode("s").alias("s"), "v").select("s.*", "v"), ["dimension", "stratum"], F.col("v"), points)
    issued = (F.col("n") >= STRATUM_FLOOR) | (F.col("dimension") == "all")
    shown = [F.when(issued & (F.col("n") >= 4), rounded(F.col(p))).alias(p) for p in points]
    return out.select("dimension", "stratum", "n", *shown, F.when(~issued, "context_stratum_too_small").alias("reason"))


def reference_deciles(f: Frames) -> DataFrame:
    """Each repository's decile among all: ten times the share at or below it, cut down, 1 to 10.

    Equal rates are counted once with their number, and ranked over the distinct rates.
    """
    rates = commits.test_cochange(f).where("narrate_rate").select("repo", "rate")
    counts = rates.groupBy("rate").agg(F.count("*").alias("c"))
    # rates have four decimals, so there are ten thousand distinct ones at most
    upto = counts.select("rate", F.sum("c").over(Window.orderBy("rate")).alias("below"), F.sum("c").over(Window.partitionBy()).alias("n"))
    out = rates.join(F.broadcast(upto), "rate")
    decile = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("below") / F.col("n") * 10)))
    return out.select("repo", "rate", F.when(F.col("n") >= 20, decile.cast("long")).alias("decile"), F.when(F.col("n") < 20, "reference_too_small").alias("reason"))


def _groups(f: Frames) -> DataFrame:
    return f.table("customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("v")).where(F.col("g").isin(*SEGMENTS))


def group_comparison(f: Frames) -> DataFrame:
    """Cliff's delta, medians and ranges of two groups, and what they say.

    Delta is counted over the distinct values in order, not over pairs: for each value the
    group's members times the other group's members below and above. The running count is
    kept over buckets of values, so that no task sorts all of them.
    """
    rows = _groups(f)
    a, b = SEGMENTS
    counts = rows.groupBy("v").agg(F.count_if(F.col("g") == a).alias("a"), F.count_if(F.col("g") == b).alias("b")).withColumn("k", F.floor("v"))
    inside = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("k").agg(F.sum("b").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = F.col("before") + F.coalesce(F.sum("b").over(inside), F.lit(0))
    ranked = counts.join(buckets.select("k", "before"), "k").select("a", "b", below.alias("lower"))
    total = rows.groupBy().agg(
        *(F.count_if(F.col("g") == g).alias(f"n_{x}") for g, x in zip(SEGMENTS, "ab")),
        *(F.median(F.when(F.col("g") == g, F.col("v"))).alias(f"median_{x}") for g, x in zip(SEGMENTS, "ab")),
        *(F.min(F.when(F.col("g") == g, F.col("v"))).alias(f"min_{x}") for g, x in zip(SEGMENTS, "ab")),
        *(F.max(F.when(F.col("g") == g, F.col("v"))).alias(f"max_{x}") for g, x in zip(SEGMENTS, "ab")),
    )
    wins = ranked.agg(F.sum(F.col("a") * F.col("lower")).alias("greater"), F.sum(F.col("a") * F.col("b")).alias("equal"))
    one = total.crossJoin(F.broadcast(wins))
    pairs = F.col("n_a") * F.col("n_b")
    less = pairs - F.col("greater") - F.col("equal")
    delta = (F.col("greater") - less) / pairs
    gap = F.col("median_a") - F.col("median_b")
    contained = ((F.col("min_a") >= F.col("min_b")) & (F.col("max_a") <= F.col("max_b"))) | ((F.col("min_b") >= F.col("min_a")) & (F.col("max_b") <= F.col("max_a")))
    verdict = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), "inconclusive_small_n").when(gap <= -0.10, "kill_reverse_direction").when((gap >= 0.10) & ~contained & (F.abs(delta) >= 0.33), "separated").otherwise("fail_tier2")
    return one.select("n_a", "n_b", rounded(F.col("median_a")).alias("median_a"), rounded(F.col("median_b")).alias("median_b"), rounded(gap).alias("gap"), contained.alias("contained"), rounded(delta).alias("cliffs_delta"), verdict.alias("verdict"))


def role_validation(f: Frames) -> DataFrame:
    """Precision, recall and F1 of a simple predictor for each class, over the zero-filled confusion matrix."""
    rows = f.table("documents").join(f.table("labels"), "doc_id").select(F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") > 1500, "1").otherwise("0").alias("pred"))
    cells = rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    labels = F.explode(F.array(*map(F.lit, ROLE_LABELS)))
    label = F.col("label")
    per = cells.select(labels.alias("label"), "truth", "pred", "n").groupBy("label").agg(
        F.sum(F.when((F.col("truth") == label) & (F.col("pred") == label), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("truth") != label) & (F.col("pred") == label), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("truth") == label) & (F.col("pred") != label), F.col("n")).otherwise(0)).alias("fn"),
    )
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return per.select("label", "tp", "fp", "fn", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f1).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def report_difference(f: Frames) -> DataFrame:
    """What differs between two reports in long form: values added, removed or changed.

    The reports are the repository measures and those of the repositories with an even
    number, one of whose measures is withheld.
    """
    left = repo_metrics(f)
    right = left.where("repo % 2 = 0").select("repo", "metric", F.when(F.col("metric") != "reverts", F.col("value")).alias("value"))
    both = left.withColumnRenamed("value", "l").withColumn("in_l", F.lit(True)).join(right.withColumnRenamed("value", "r").withColumn("in_r", F.lit(True)), ["repo", "metric"], "full")
    kind = F.when(F.col("in_r").isNull(), "removed").when(F.col("in_l").isNull(), "added").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return both.select("metric", kind.alias("kind")).where("kind IS NOT NULL").groupBy("metric", "kind").agg(F.count("*").alias("n"))
