"""Lineage of files over the commit graph: which creation a change touches, through renames, copies and merges.

A commit starts from the files of its first parent. A and C create, D ends, R carries a
file to its new path, M leaves it; a merge's A takes over the file that its other parents
have, if they agree on one. Every change of a path is a node that points to the change it
found there, and pointer doubling leads each to its creation. All loops take a number of
rounds that grows with the logarithm of the history, each one a few staged joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.observe import ratio
from ..functions.ordering import as_of, with_previous
from ..plans.surrogate import Frames
from ..sources.staging import Buckets, dealt, settled, staged, staged_count

#: Generations of a chain that are sorted together.
BLOCK = 1024
#: Up to so many open rows of a round are broadcast; more are joined by a shuffle.
FEW_ROWS = 1 << 17


def first_parents(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """sha and the parent that its files come from, null for a start; `parents` has sha, n (from 0) and parent.

    A commit whose parents are all unknown (a history that was cut) goes on from the commit before it.
    """
    known = parents.join(commits.select(F.col("sha").alias("parent"), F.lit(True).alias("known")), "parent", "left")
    told = known.groupBy("sha").agg(F.max(F.when(F.col("n") == 0, F.struct("known", "parent"))).alias("first"), F.bool_or(F.coalesce("known", F.lit(False))).alias("some"))
    rows = with_previous(commits.select("repo", "sha", "local_day", "ord"), ["repo"], F.trunc("local_day", "month"), ["local_day", "ord"], {"sha": "before"}).join(told, "sha", "left")
    return rows.select("sha", F.when(F.col("first.known"), F.col("first.parent")).when(~F.col("some"), F.col("before")).alias("parent"))


def follow(nodes: DataFrame) -> DataFrame:
    """id, root and last of each node of (id, next, mark): the end of its pointers, and the last marked node on the way, the end included.

    Every round doubles the way of those that are not yet at their end; pointers must not run in a circle.
    """
    start = nodes.select("id", F.coalesce("next", "id").alias("root"), F.when(F.col("mark"), F.col("id")).alias("last"), F.col("next").isNull().alias("ended"))
    here, left = staged_count(start, "pointers", ~F.col("ended"))
    done = here.where("ended")
    while left:
        here = here.where("NOT ended")
        to = here.union(done).select(F.col("id").alias("root"), F.col("root").alias("far"), F.col("last").alias("later"), F.col("ended").alias("over"))
        step = _few(here, left, "root").join(to, "root").select("id", F.col("far").alias("root"), F.coalesce("later", "last").alias("last"), F.col("over").alias("ended"))
        here, left = staged_count(step, "pointers", ~F.col("ended"))
        done = done.union(here.where("ended"))
    return done.drop("ended")


def _few(df: DataFrame, rows: int, key: str) -> DataFrame:
    return F.broadcast(df.drop("ended")) if rows <= FEW_ROWS else spread(df.drop("ended"), rows, key)


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """`df` dealt out by `key`, if it is one of many rows: what a task of a join sorts stays small."""
    return df if rows <= FEW_ROWS else dealt(df, rows, key)


def chains(first: DataFrame) -> DataFrame:
    """sha, chain (its uppermost commit), depth (commits before it), up (the commit above the chain) and top (the depth of its uppermost commit).

    A chain goes on with the child that has most descendants, so that the way from any
    commit to its root changes chains a logarithmic number of times. Commits that have come to
    their root leave the rounds, and only what they are given below them is kept for the sum.
    """
    open_ = F.col("far").isNotNull()
    reach, left = staged_count(first.select("sha", F.col("parent").alias("far"), F.col("parent").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size")), "reach", open_)
    done, gains = reach.where(~open_).select("sha", "depth"), first.select("sha", F.lit(0).cast("long").alias("gain")).limit(0)
    while left:
        reach = reach.where(open_)
        gain = staged(reach.groupBy(F.col("far").alias("sha")).agg(F.sum("size").alias("gain")), "gain")
        gains = gains.union(gain)
        to = reach.select(F.col("sha").alias("far"), F.col("far").alias("next"), F.col("depth").alias("more")).union(done.select("sha", F.lit(None).cast(reach.schema["far"].dataType), "depth"))
        step = spread(_few(reach, left, "far").join(to, "far"), left, "sha").join(gain, "sha", "left")
        step = step.select("sha", F.col("next").alias("far"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        reach, left = staged_count(step, "reach", open_)
        done = done.union(reach.where(~open_).select("sha", "depth"))
    sizes = gains.groupBy("sha").agg(F.sum("gain").alias("size"))
    rows, n = staged_count(spread(first, first.count(), "sha").join(done, "sha").join(sizes, "sha", "left").withColumn("size", F.coalesce("size", F.lit(0))), "sized", F.lit(True))
    heavy = spread(rows.where("parent IS NOT NULL"), n, "parent").groupBy("parent").agg(F.max_by("sha", F.struct("size", "sha")).alias("sha")).withColumnRenamed("parent", "above")
    rows = staged(spread(rows.drop("size"), n, "sha").join(heavy, "sha", "left"), "rows")
    heads = follow(rows.select(F.col("sha").alias("id"), F.col("above").alias("next"), F.lit(False).alias("mark"))).select(F.col("id").alias("sha"), F.col("root").alias("chain"))
    ups = rows.where("above IS NULL").select(F.col("sha").alias("chain"), F.col("parent").alias("up"), F.col("depth").alias("top"))
    return spread(spread(rows.select("sha", "depth"), n, "sha").join(heads, "sha"), n, "chain").join(ups, "chain")


def found_before(reads: DataFrame, writes: DataFrame, place: DataFrame) -> DataFrame:
    """id and `write` of the reads that find one: the last write of their path at or above their place in the graph.

    Reads have id, path, chain, depth and pos; writes write, path, chain, depth and pos.
    A read that finds nothing in its chain goes on at the commit above it. Of writes that
    share a place the smallest comes last, so that their rows may come in any order: a
    rename to its own path ends its file, as in the SQL.

    Writes are dealt out once, and a round moves only the reads that are open: the writes of
    a path in a chain are one sorted row. Chains of over BLOCK generations, whose rows would
    be large, are looked through in blocks (`as_of`).
    """

    def at(df: DataFrame, tie: Column = F.lit(1 << 62)) -> DataFrame:
        return df.withColumn("order", F.struct("depth", "pos", tie.alias("tie")))

    ends = place.groupBy("chain").agg(F.first("up").alias("up"), (F.max(F.col("depth") - F.col("top")) >= BLOCK).alias("deep"))
    ends, n_deep = staged_count(ends, "ends", F.col("deep"))
    deep = ends.where("deep").select("chain")
    ups = staged(ends.where("up IS NOT NULL").select("chain", "up").join(place.select(F.col("sha").alias("up"), F.col("chain").alias("next"), F.col("depth").alias("last")), "up").select("chain", "next", "last"), "ups")

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.join(_few(deep, n_deep, "chain"), "chain", how)

    made, open_ = at(writes, -F.col("write")).select("chain", "path", "order", "write"), at(reads).select("id", "path", "chain", "order")
    if n_deep:
        made, open_ = staged(made, "writes"), staged(open_, "reads")
    buckets = Buckets(place.sparkSession, "held", ["chain", "path"])
    rows = buckets.dealt(part(made, "left_anti") if n_deep else made)
    _, n_held = buckets.add(rows.groupBy("chain", "path").agg(F.sort_array(F.collect_list(F.struct("order", "write"))).alias("made")), dealt=True)
    long = staged(part(made, "left_semi"), "long") if n_deep else None
    done = None
    while True:
        near = part(open_, "left_anti") if n_deep else open_
        if n_held:
            met = buckets.dealt(near).join(buckets.rows(), ["chain", "path"], "left")
            before = F.filter("made", lambda m: m["order"] < F.col("order"))
            looked = met.select("id", "path", "chain", F.get(before, F.size(before) - 1)["write"].alias("write"))
        else:
            looked = near.select("id", "path", "chain", F.lit(None).cast("long").alias("write"))
        if n_deep:
            looked = looked.unionByName(as_of(part(open_, "left_semi"), long, ["chain", "path"], "order", F.floor(F.col("order.depth") / BLOCK), "write").select("id", "path", "chain", "write"))
        looked, left = staged_count(looked, "looked", F.col("write").isNull())
        hits = looked.where("write IS NOT NULL").select("id", "write")
        done = hits if done is None else done.union(hits)
        if not left:
            return done
        on = spread(looked.where("write IS NULL").select("id", "path", "chain"), left, "chain").join(ups, "chain")
        open_ = at(on.select("id", "path", F.col("next").alias("chain"), F.col("last").alias("depth"), F.lit(1 << 62).alias("pos"))).select("id", "path", "chain", "order")
        if n_deep:
            open_ = staged(open_, "reads")


def lineage(commits: DataFrame, parents: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes with id, `touches` (the change that they found or took over, null if none) and `creation`.

    `commits` has repo, sha, local_day, ord and is_merge; `parents` sha, n and parent;
    `changes` sha, pos (their order within the commit), path, old_path and status. The
    creation of an A or C is its own id or, in a merge, that of the file it takes over; that
    of M, R and D is null where there was no file.
    """
    place = settled(lambda: chains(staged(first_parents(commits, parents), "first")), "chains")
    rows = changes.where("status <> 'R' OR old_path IS NOT NULL").join(commits.select("sha", "is_merge"), "sha").join(place.select("sha", "chain", "depth"), "sha")
    rows = staged(rows.withColumn("id", F.monotonically_increasing_id()), "changes")
    status = F.col("status")
    added, joins = status.isin("A", "C"), (status == "A") & F.col("is_merge")
    odd = F.col("pos") * 2 + 1
    moved_away = rows.where(status == "R").select((-F.col("id") - 1).alias("write"), F.col("old_path").alias("path"), "chain", "depth", odd.alias("pos"))
    writes = rows.select(F.col("id").alias("write"), "path", "chain", "depth", odd.alias("pos")).unionByName(moved_away)

    # what a change of a file finds, and for a merge's addition what each other parent has
    own = rows.where(~added).select("id", F.when(status == "R", F.col("old_path")).otherwise(F.col("path")).alias("path"), "chain", "depth", (F.col("pos") * 2).alias("pos"))
    others = parents.where("n > 0").join(place.select(F.col("sha").alias("parent"), "chain", "depth"), "parent").select("sha", "chain", "depth")
    sides = rows.where(joins).select("id", "path", "sha").join(others, "sha").select("id", "path", "chain", "depth", F.lit(1 << 62).alias("pos"))
    found = staged(found_before(own.unionByName(sides), writes, place), "found")

    single = found.groupBy("id").agg(F.min("write").alias("one"), F.max("write").alias("most"))
    nodes = rows.select("id", "status", joins.alias("mark")).join(single, "id", "left")
    several = F.col("mark") & (F.col("one") != F.col("most"))
    kind = F.when(several, "open").when(F.col("status").isin("A", "C"), "new").otherwise("none")
    nodes = nodes.select("id", F.when((F.col("status") != "D") & ~F.coalesce(several, F.lit(False)), F.col("one")).alias("next"), F.when(F.col("status") == "D", F.col("one")).alias("ended"), "mark", kind.alias("kind"))
    no_file = moved_away.select(F.col("write").alias("id"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("long").alias("ended"), F.lit(False).alias("mark"), F.lit("none").alias("kind"))
    nodes = staged(nodes.unionByName(no_file), "nodes")
    while True:
        ends = follow(nodes).join(nodes.select(F.col("id").alias("root"), "kind"), "root")
        creation = F.when(F.col("kind") == "new", F.col("root")).when(F.col("kind") == "none", F.col("last"))
        resolved, waiting = staged_count(ends.select("id", creation.alias("creation"), (F.col("kind") == "open").alias("waits")), "resolved", F.col("waits"))
        if not waiting:
            break
        open_ = nodes.where("kind = 'open'").select("id")
        # merges with several other parents that have the path: decided as soon as all of those are told
        told = open_.join(found, "id").join(resolved.select(F.col("id").alias("write"), "creation", "waits"), "write").groupBy("id").agg(
            F.bool_or("waits").alias("waits"), F.min("creation").alias("low"), F.max("creation").alias("high"), F.min(F.when(F.col("creation").isNotNull(), F.col("write"))).alias("one")
        )
        told = told.where("NOT waits").select("id", F.when(F.col("low") == F.col("high"), F.col("one")).alias("to"), F.lit(True).alias("told"))
        nodes = staged(nodes.join(told, "id", "left").select("id", F.when(F.col("told"), F.col("to")).otherwise(F.col("next")).alias("next"), "ended", "mark", F.when(F.col("told"), "new").otherwise(F.col("kind")).alias("kind")), "nodes")
    was = nodes.where("ended IS NOT NULL").select(F.col("id").alias("by"), F.col("ended").alias("id")).join(resolved.where("creation IS NOT NULL"), "id").select(F.col("by").alias("id"), F.col("creation").alias("was"))
    led = nodes.where("id >= 0").select("id", F.coalesce("next", "ended").alias("touches")).join(resolved.select("id", "creation"), "id")
    out = rows.join(led, "id").join(was, "id", "left")
    return out.select("id", "sha", "pos", "path", "old_path", "status", "touches", F.when(F.col("status") == "D", F.col("was")).otherwise(F.col("creation")).alias("creation"))


def touches(f: Frames) -> DataFrame:
    """The lineage of the history's changes, with the commit of each and that of its creation (`made_*`; no author in a merge)."""
    who = f.commits.select("sha", "repo", "actor", "author_sec", "is_merge", "is_bot", F.struct("local_day", "ord").alias("at"))
    commits, parents, changes = f.commits, f.graph_parents, f.graph_changes
    rows = settled(lambda: lineage(commits, parents, changes).drop("path", "old_path").join(who, "sha"), "lineage")
    made = rows.where(F.col("id") == F.col("creation")).select("creation", F.when(~F.col("is_merge"), F.col("actor")).alias("made_by"), (F.col("is_bot") & ~F.col("is_merge")).alias("made_by_bot"), F.col("author_sec").alias("made_sec"))
    return rows.join(made, "creation", "left")


def _own_touches(rows: DataFrame) -> DataFrame:
    """id and sec_before of each change that creators made to their own files: the time of their touch before, along the file's lineage."""
    own = (F.col("actor") == F.col("made_by")) & ~F.col("is_merge")
    flagged = own & ((F.col("id") == F.col("creation")) | (F.col("status").isin("M", "R") & ~F.col("is_bot")))
    marks = staged(rows.select("id", F.col("touches"), F.coalesce(flagged, F.lit(False)).alias("flag"), "author_sec"), "marks")
    stops = follow(marks.select("id", F.when(~F.col("flag"), F.col("touches")).alias("next"), F.lit(False).alias("mark")))
    times = marks.where("flag").select(F.col("id").alias("root"), F.col("author_sec").alias("sec_before"))
    return marks.where("flag AND touches IS NOT NULL").select("id", "touches").join(stops.select(F.col("id").alias("touches"), "root"), "touches").join(times, "root", "left").select("id", "sec_before")


def file_experience(f: Frames) -> DataFrame:
    """Work on others' files, adopted creations and returns to own files, for each actor of a repository.

    * cross_author: of the commits that modify or rename files of known people, those with one of somebody else;
    * adopted: of the creations that lived ADOPTION_DAYS within the history, those that somebody else touched after that time;
    * returns: of the touches of own files, those RETURN_DAYS or more after the own touch before.
    """
    rows = settled(lambda: touches(f), "touches")
    day = 86_400
    human = ~F.col("is_merge") & ~F.col("is_bot")
    edits = rows.where(human & F.col("status").isin("M", "R") & F.col("made_by").isNotNull())
    commits = edits.where(~F.col("made_by_bot")).groupBy("repo", "actor", "sha").agg(F.bool_or(F.col("made_by") != F.col("actor")).alias("other"))
    cross = commits.groupBy("repo", "actor").agg(F.count("*").alias("edit_commits"), F.count_if("other").alias("cross_author"))

    end = f.commits.groupBy("repo").agg(F.max("author_sec").alias("end_sec"))
    born = rows.where(human & (F.col("id") == F.col("creation"))).select("repo", "actor", "creation", F.col("author_sec").alias("born_sec"))
    deaths = rows.where("status = 'D' AND creation IS NOT NULL").groupBy("creation").agg(F.min_by("author_sec", F.struct("at", "pos")).alias("ended_sec"))
    taken = edits.where((F.col("actor") != F.col("made_by")) & (F.col("author_sec") - F.col("made_sec") >= rules.ADOPTION_DAYS * day)).select("creation", F.lit(True).alias("taken")).distinct()
    lived = born.join(end, "repo").join(deaths, "creation", "left").join(taken, "creation", "left")
    lived = lived.where(F.least("end_sec", "ended_sec") - F.col("born_sec") >= rules.ADOPTION_DAYS * day)
    adopted = lived.groupBy("repo", "actor").agg(F.count("*").alias("creations"), F.count_if("taken").alias("adopted"))

    kept = edits.where(F.col("actor") == F.col("made_by")).join(_own_touches(rows), "id", "left")
    late = F.col("author_sec") - F.col("sec_before") >= rules.RETURN_DAYS * day
    returns = kept.groupBy("repo", "actor").agg(F.count("*").alias("own_touches"), F.count_if(late).alias("returns"))
    actors = f.scoped.select("repo", "actor").distinct()
    names = ("edit_commits", "cross_author", "creations", "adopted", "own_touches", "returns")
    out = actors.join(cross, ["repo", "actor"], "left").join(adopted, ["repo", "actor"], "left").join(returns, ["repo", "actor"], "left").select("repo", "actor", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))

    def share(n: str, d: str) -> Column:
        return ratio(F.col(n), F.col(d))

    return out.select("*", share("cross_author", "edit_commits").alias("cross_author_share"), share("adopted", "creations").alias("adopted_share"), share("returns", "own_touches").alias("return_share"))


MEASURES = {"jn23_graph_lineage": file_experience}
