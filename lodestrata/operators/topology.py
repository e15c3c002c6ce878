"""Order, reachability and sizes over the commit graph, told by chains of first parents.

What a commit reaches is one range of each chain, so that sets of ancestors or descendants
are held as (target, chain, depth) and never as pairs of commits. The graph has no cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ordering import running_max, running_sum
from ..plans.surrogate import Frames
from ..sources.staging import Buckets, staged, staged_count
from .lineage import BLOCK, FEW_ROWS, chains, spread

#: Seconds of corrected time that are numbered together.
SPAN = 30 * 86_400
#: Rounds in which late clocks are carried on along single edges, before chains are built for those that go further.
EDGE_ROUNDS = 8
_LEAST = -(1 << 62)


def place(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """sha, chain, depth, top and up of every commit, by its first parent where that is one of `commits`."""
    known = parents.where("n = 0").join(commits.select(F.col("sha").alias("parent")), "parent", "left_semi").select("sha", "parent")
    return staged(chains(staged(commits.select("sha").join(known, "sha", "left"), "first")), "place")


def crossings(where: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges (sha, parent) between two chains, with `chain`, `depth` and `up_chain`, `up_depth` of their ends."""
    ends = where.select(F.col("sha").alias("parent"), F.col("chain").alias("up_chain"), F.col("depth").alias("up_depth"))
    n = where.count()
    edges = spread(spread(parents.select("sha", "parent"), n, "sha").join(where.select("sha", "chain", "depth"), "sha"), n, "parent").join(ends, "parent")
    return staged(edges.where("chain <> up_chain").distinct(), "crossings")


def corrected_times(commits: DataFrame, where: DataFrame, cross: DataFrame) -> DataFrame:
    """sha and corrected: the commit's own time, or a second after its parents' corrected time if that is later.

    Corrected times rise along every edge, whatever the clocks told. A late clock is carried
    down its whole chain at once, so that the rounds are as many as the chains that it passes on to.
    """

    def settled(df: DataFrame) -> DataFrame:
        rows = running_max(df, ["chain"], F.floor(F.col("depth") / BLOCK), ["depth"], F.col("value") - F.col("depth"), "over")
        return rows.select("sha", "chain", "depth", (F.col("over") + F.col("depth")).alias("corrected"), F.col("moved"))

    start = where.select("sha", "chain", "depth").join(commits.select("sha", F.col("author_sec").alias("value")), "sha").withColumn("moved", F.lit(True))
    here = staged(settled(start), "corrected")
    while not cross.isEmpty():
        lifts = cross.select("sha", "parent").join(here.select(F.col("sha").alias("parent"), "corrected"), "parent").groupBy("sha").agg((F.max("corrected") + 1).alias("least"))
        moved = F.coalesce(F.col("least") > F.col("corrected"), F.lit(False))
        raised = here.drop("moved").join(lifts, "sha", "left").select("sha", "chain", "depth", F.greatest("corrected", "least").alias("value"), moved.alias("moved"))
        here, left = staged_count(settled(raised), "corrected", F.col("moved"))
        if not left:
            break
    return here.select("sha", "corrected")


def lifted(timed: DataFrame, rounds: int = EDGE_ROUNDS) -> tuple[DataFrame, int, int]:
    """(rows, most, left): sha and corrected of commits that are late, by how much at most, and how many the last round moved.

    `timed` are the edges (sha, parent) with their ends' times `own` and `above`. A round takes
    only the edges below commits that the round before moved, so that clocks that are late by
    a few commits cost one pass over the edges and some small joins. If none is left, the
    values are final.
    """

    def late(rows: DataFrame, time: str) -> tuple[DataFrame, int, int]:
        seen = Observation()
        moved = rows.where(F.col(time) >= F.col("own")).groupBy("sha").agg((F.max(time) + 1).alias("corrected"), F.max("own").alias("own"))
        front = staged(moved.observe(seen, F.count("*").alias("n"), F.max(F.col("corrected") - F.col("own")).alias("most")), "lifted").drop("own")
        return front, seen.get["n"], seen.get["most"] or 0

    front, left, most = late(timed, "above")
    every = front
    for _ in range(rounds):
        if not left:
            break
        moved = front.select(F.col("sha").alias("parent"), "corrected")
        below = timed.select("sha", "parent", "own").join(F.broadcast(moved) if left <= FEW_ROWS else moved, "parent")
        front, left, more = late(below, "corrected")
        every, most = every.union(front), max(most, more)
    return every.groupBy("sha").agg(F.max("corrected").alias("corrected")), most, left


def settled_times(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """sha and corrected, as `corrected_times`, with chains only of commits that late clocks come to.

    What goes further than some edges is carried on by chains of those edges that a clock
    late by `reach` could pass. No clock may come out later than that, else `reach` grows.
    """
    own, above = (commits.select(F.col("sha").alias(c), F.col("author_sec").alias(t)) for c, t in (("sha", "own"), ("parent", "above")))
    timed = staged(parents.select("sha", "n", "parent").join(own, "sha").join(above, "parent"), "timed")
    late, most, left = lifted(timed)
    corrected = F.coalesce("corrected", "author_sec")
    reach = 0
    while left:
        reach = max(2 * most, 4 * reach)
        near = staged(timed.where(F.col("own") - F.col("above") <= reach).select("sha", "n", "parent"), "near")
        ends = near.select("sha").union(near.select("parent")).distinct()
        some = staged(ends.join(commits, "sha").join(late, "sha", "left").select("sha", F.col("author_sec").alias("own"), corrected.alias("author_sec")), "some")
        where = place(some, near)
        times = corrected_times(some, where, crossings(where, near))
        seen = Observation()
        rows = some.select("sha", "own").join(times, "sha").observe(seen, F.max(F.col("corrected") - F.col("own")).alias("most"))
        late = staged(rows, "late").drop("own")
        most = seen.get["most"]
        left = most > reach
    return commits.join(late, "sha", "left").select("sha", corrected.alias("corrected"))


def topological(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """repo, sha, corrected and sequence (from 0): an order in which every commit follows all its parents; ties by sha."""
    commits = staged(commits.select("repo", "sha", "author_sec"), "commits")
    rows = commits.select("repo", "sha").join(settled_times(commits, parents), "sha")
    rows = running_sum(rows, ["repo"], F.floor(F.col("corrected") / SPAN), ["corrected", "sha"], F.lit(1).cast("long"), "n")
    return rows.select("repo", "sha", "corrected", (F.col("n") - 1).alias("sequence"))


def reach(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """target, chain and level: of each chain, how far a target reaches.

    `starts` has target, until (one for each target), chain and level; `steps` chain, level,
    to_chain, to_level and stamp. A target that reaches a level of a chain reaches those
    below, takes the steps there whose stamp is at most `until`, and holds the highest level
    of each chain. Only levels that are new go on to the next round, and only they are
    written: what is held lies in buckets and is not moved again.
    """
    keys = ["target", "chain"]
    first = starts.groupBy(*keys).agg(F.max("until").alias("until"), F.max("level").alias("level")).withColumn("under", F.lit(_LEAST))
    if steps.isEmpty():
        return first.select(*keys, "level")
    held, ways = Buckets(starts.sparkSession, "reach", keys), Buckets(starts.sparkSession, "steps", ["chain"])
    ways.add(steps.withColumnRenamed("level", "at"))
    front, left = held.add(first)
    while left:
        moved = front.withColumnRenamed("level", "high")
        met = ways.rows().join(F.broadcast(moved) if left <= FEW_ROWS else ways.dealt(moved), "chain").where((F.col("at") <= F.col("high")) & (F.col("at") > F.col("under")) & (F.col("stamp") <= F.col("until")))
        gained = held.dealt(met.select("target", F.col("to_chain").alias("chain"), "until", F.col("to_level").alias("level"))).groupBy(*keys).agg(F.max("until").alias("until"), F.max("level").alias("level"))
        known = gained.hint("shuffle_hash").join(held.rows().select(*keys, F.col("level").alias("had")), keys, "left")
        new = known.groupBy(*keys).agg(F.max("until").alias("until"), F.max("level").alias("level"), F.coalesce(F.max("had"), F.lit(_LEAST)).alias("under"))
        front, left = held.add(new.where(F.col("level") > F.col("under")))
    return held.rows().groupBy(*keys).agg(F.max("level").alias("level"))


def ancestors(targets: DataFrame, where: DataFrame, cross: DataFrame) -> DataFrame:
    """target, chain and level: each target reaches the commits of a chain down to depth `level`, and itself."""
    starts = targets.select(F.col("sha").alias("target"), "sha").distinct().join(where, "sha").select("target", F.lit(0).cast("long").alias("until"), "chain", F.col("depth").alias("level"))
    return reach(starts, cross.select("chain", F.col("depth").alias("level"), F.col("up_chain").alias("to_chain"), F.col("up_depth").alias("to_level"), F.lit(0).alias("stamp")))


def descendants(targets: DataFrame, where: DataFrame, cross: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """target, chain and level: each target is reached by the commits of a chain from depth `-level` on, itself included.

    With `times` (corrected), targets have `until`, and what lies behind it is not entered:
    corrected times rise along edges, so that no way to an earlier commit is lost.
    """
    until = F.lit(0).cast("long") if times is None else F.col("until")
    starts = targets.select(F.col("sha").alias("target"), "sha", until.alias("until")).distinct().join(where, "sha").select("target", "until", "chain", (-F.col("depth")).alias("level"))
    steps = cross.withColumn("corrected", F.lit(0)) if times is None else cross.join(times, "sha")
    return reach(starts, steps.select(F.col("up_chain").alias("chain"), (-F.col("up_depth")).alias("level"), F.col("chain").alias("to_chain"), (-F.col("depth")).alias("to_level"), F.col("corrected").alias("stamp")))


def tree_sums(where: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """sha and the sums of `names` (long) over the commit and its first parents; `values` has sha and them, lacking ones count 0.

    Running sums within chains, and of each chain what its commit above has: the chains
    above each other are followed by pointer doubling.
    """
    rows = where.select("sha", "chain", "depth").join(values, "sha", "left")
    for name in names:
        rows = running_sum(rows.withColumnRenamed(name, "_own"), ["chain"], F.floor(F.col("depth") / BLOCK), ["depth"], F.coalesce("_own", F.lit(0)), name).drop("_own")
    rows = staged(rows, "sums")
    above = where.where("up IS NOT NULL").select("chain", F.col("up").alias("sha")).distinct()
    carried = above.join(rows.select("sha", F.col("chain").alias("next"), *names), "sha").select("chain", "next", *names)
    here, left = staged_count(carried, "carried", F.lit(True))
    while left:
        further = here.select(F.col("chain").alias("next"), F.col("next").alias("far"), *(F.col(n).alias(f"more_{n}") for n in names))
        step = here.join(further, "next", "left").select("chain", F.col("far").alias("next"), *((F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in names))
        here, left = staged_count(step, "carried", F.col("next").isNotNull())
    base = here.select("chain", *(F.col(n).alias(f"base_{n}") for n in names))
    return rows.join(base, "chain", "left").select("sha", *((F.col(n) + F.coalesce(f"base_{n}", F.lit(0))).alias(n) for n in names))


def sizes(commits: DataFrame, parents: DataFrame, changes: DataFrame, targets: DataFrame) -> DataFrame:
    """sha, commits, files and lines of each target: the commits that it reaches, and the files and lines of its tree.

    `changes` are those against the first parent, with status, added and deleted; lines of
    binary files (null) count 0.
    """
    where = place(commits, parents).withColumn("depth", F.col("depth") - F.col("top"))  # depths within the chain, so that a level tells the commits
    held = ancestors(targets, where, crossings(where, parents))
    reached = held.groupBy(F.col("target").alias("sha")).agg(F.sum(F.col("level") + 1).alias("commits"))
    one = F.when(F.col("status").isin("A", "C"), 1).when(F.col("status") == "D", -1).otherwise(0)
    values = changes.groupBy("sha").agg(F.sum(one).cast("long").alias("files"), F.sum(F.coalesce("added", F.lit(0)) - F.coalesce("deleted", F.lit(0))).cast("long").alias("lines"))
    values = staged(values, "values")
    return targets.select("sha").distinct().join(reached, "sha").join(tree_sums(where, values, ["files", "lines"]), "sha")


def topological_order(f: Frames) -> DataFrame:
    """The commits in a topological order of the graph, for each repository."""
    return topological(f.commits, f.graph_parents)


def release_sizes(f: Frames) -> DataFrame:
    """Commits, files and lines of the repository at each release, along the graph."""
    f.commits = staged(f.commits.select("repo", "customer", "sha", "local_day", "is_merge", "author_sec", "actor"), "commits")
    return sizes(f.commits, staged(f.graph_parents, "parents"), f.changes, f.tags).select("sha", "commits", "files", "lines")


MEASURES = {"src07_topological": topological_order, "src10_sizes": release_sizes}
