"""Measures over the parent graph: reachability, fixes after releases, differences of commit sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.ordering import with_previous
from ..plans.surrogate import Frames
from ..sources.staging import staged
from . import topology


def parents(f: Frames) -> DataFrame:
    """(sha, n, parent): the same customer's order before, so that each customer has a line of commits."""
    rows = with_previous(f.commits.select("customer", "sha", "local_day"), ["customer"], F.trunc("local_day", "month"), ["local_day", "sha"], {"sha": "parent"})
    return rows.select("sha", F.lit(0).alias("n"), "parent").where("parent IS NOT NULL")


def descendants(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, sha) of every commit that each target reaches by edges (sha, parent), itself included.

    The frontier moves on by one join a round; pairs seen before don't come again, so that
    merges don't multiply paths, and a cycle ends. Every round is staged.
    """
    seen = staged(targets.select(F.col("sha").alias("target"), "sha").distinct(), "seen")
    frontier = seen
    while frontier.limit(1).count():
        step = frontier.withColumnRenamed("sha", "parent").join(edges, "parent").select("target", "sha").distinct()
        frontier = staged(step.join(seen, ["target", "sha"], "left_anti"), "frontier")
        seen = seen.union(frontier)
    return seen


def reachability(f: Frames) -> DataFrame:
    """How many commits each release reaches: one range of each chain, and no pairs."""
    edges = staged(parents(f), "edges")
    where = topology.place(f.commits, edges)
    reached = topology.descendants(f.tags, where, topology.crossings(where, edges))
    ends = where.groupBy("chain").agg(F.max("depth").alias("bottom"))
    return reached.join(ends, "chain").groupBy(F.col("target").alias("sha")).agg(F.sum(F.col("bottom") + F.col("level") + 1).alias("descendants"))


def after_releases(placed: DataFrame, reached: DataFrame) -> DataFrame:
    """The commits (chain, block, depth) with each release (chain, block, level) that reaches them and has their block."""
    return placed.join(reached, ["chain", "block"]).where(F.col("depth") >= -F.col("level"))


def post_release_fixes(f: Frames) -> DataFrame:
    """Corrective commits within 30 days of a release that they descend from, by repository.

    Releases and fixes meet by chain and by blocks of 30 days, after the releases were
    followed: pairs of one repository and time are not made. How far a release is followed
    is the latest corrected time of the fixes in its two blocks.
    """
    width = rules.RELEASE_DAYS * 86400
    block = F.floor(F.col("tag_sec") / width)
    tags = f.tags.select("repo", F.col("sha").alias("target"), "tag_sec", F.explode(F.array(block, block + 1)).alias("block"))
    fixes = f.scoped.where(rules.is_corrective(F.col("subject"))).select("repo", "sha", "author_sec", F.floor(F.col("author_sec") / width).alias("block"))
    edges = staged(parents(f), "edges")
    where = topology.place(f.commits, edges)
    cross = topology.crossings(where, edges)
    times = topology.corrected_times(f.commits, where, cross)
    placed = staged(fixes.join(times, "sha").join(where.select("sha", "chain", "depth"), "sha"), "placed")
    latest = placed.groupBy("repo", "block").agg(F.max("corrected").alias("until"))
    targets = tags.join(latest, ["repo", "block"]).groupBy(F.col("target").alias("sha")).agg(F.max("until").alias("until"))
    reached = topology.descendants(targets, where, cross, times).join(tags.select("target", "tag_sec", "block"), "target")
    close = (F.col("author_sec") >= F.col("tag_sec")) & (F.col("author_sec") <= F.col("tag_sec") + width)
    found = after_releases(placed, reached).where(close)
    hits = found.select("repo", "sha").distinct().groupBy("repo").agg(F.count("*").alias("fixes"))
    return f.heads.select("repo").join(hits, "repo", "left").select("repo", F.coalesce("fixes", F.lit(0)).alias("fixes"))


def oid_difference(f: Frames) -> DataFrame:
    """Commits that one source has and the other lacks, and ids that occur more than once in the other."""
    own = f.table("orders").select(F.col("o_orderkey").alias("sha"))
    other = f.table("lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("sha")).where("sha % 50 <> 0")
    missing = own.join(other, "sha", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("kind"), "n")
    extra = other.join(own.where("sha % 40 <> 0"), "sha", "left_anti").distinct().agg(F.count("*").alias("n")).select(F.lit("extra").alias("kind"), "n")
    twice = other.groupBy("sha").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("kind"), "n")
    return missing.union(extra).union(twice)
