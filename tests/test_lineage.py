"""Lineage over a commit graph against one that walks it commit by commit."""

import datetime as dt
import random
from pathlib import Path

from lodestrata.operators import lineage
from lodestrata.plans.surrogate import Frames
from lodestrata.sources import staging

SCHEMAS = {
    "commits": "repo long, sha long, actor string, local_day date, ord long, author_sec long, is_merge boolean, is_bot boolean",
    "parents": "sha long, n int, parent long",
    "changes": "sha long, pos long, path string, old_path string, status string",
}


class Graph(Frames):
    """Frames over rows (sha, day, actor, parents, [(status, path, old path)]), in order."""

    def __init__(self, spark, rows):
        start, self.spark = dt.date(2020, 1, 1), spark
        made = {
            "commits": [(1, s, a, start + dt.timedelta(d), s, 1_577_836_800 + d * 86400, len(ps) > 1, a == "bot") for s, d, a, ps, _ in rows],
            "parents": [(s, n, p) for s, _, _, ps, _ in rows for n, p in enumerate(ps)],
            "changes": [(s, k, path, old, status) for s, _, _, _, cs in rows for k, (status, path, old) in enumerate(cs)],
        }
        for name, value in made.items():
            self.__dict__[name if name == "commits" else f"graph_{name}"] = spark.createDataFrame(value, SCHEMAS[name]).repartition(2)
        self.__dict__["scoped"] = self.commits.where("not is_bot and not is_merge")


def walked(rows):
    """(sha, pos) of the creation that each change touches, by whole file tables carried along first parents."""
    trees, out, before = {}, {}, None
    for sha, _, _, parents, changes in rows:
        tree = dict(trees.get(parents[0], {})) if parents else {}
        if parents and not any(p in trees for p in parents):
            tree = dict(trees.get(before, {}))
        for pos, (status, path, old) in enumerate(changes):
            if status in "MDR":
                held = tree.get(old if status == "R" else path)
                out[sha, pos] = held
                if status in "DR":
                    tree.pop(old if status == "R" else path, None)
                if status == "R":
                    tree.pop(path, None)
                    if held:
                        tree[path] = held
            else:
                seen = {trees[p].get(path) for p in parents[1:] if p in trees} - {None} if status == "A" else set()
                tree[path] = out[sha, pos] = seen.pop() if len(seen) == 1 else (sha, pos)
        trees[sha], before = tree, sha
    return out


def drawn(seed, commits=160):
    rng, rows = random.Random(seed), []
    names = ["a", "b", "c", "d"]
    for sha in range(1, commits + 1):
        known = [r[0] for r in rows]
        tips = known[-12:]
        parents = rng.sample(tips, min(len(tips), rng.choice([1, 1, 1, 1, 2, 3, 4]))) if known and rng.random() > 0.03 else []
        if rng.random() < 0.03:
            parents = [10_000 + sha]
        changes = []
        for path in sorted(rng.sample(names, rng.randint(0, 3))):
            status = rng.choice("AMMMDRCA")
            changes.append((status, path, rng.choice([n for n in names if n != path]) if status in "RC" else None))
        rows.append((sha, sha, rng.choice(["x", "y", "bot"]), parents, changes))
    return rows


def test_any_graph(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BLOCK", 4)
    rows = drawn(1)
    f = Graph(spark, rows)
    got = lineage.lineage(f.commits, f.graph_parents, f.graph_changes).collect()
    where = {r.id: (r.sha, r.pos) for r in got}
    assert {(r.sha, r.pos): where.get(r.creation) for r in got} == walked(rows)


def test_chains_are_few_on_any_way(spark):
    rows = [(n, n, "x", [n // 2] if n > 1 else [], []) for n in range(1, 128)]  # a binary tree
    f = Graph(spark, rows)
    place = {r.sha: r for r in lineage.chains(lineage.first_parents(f.commits, f.graph_parents)).collect()}
    assert len(place) == 127 and all(place[n].depth == n.bit_length() - 1 for n in place)

    def chains_above(n):
        return 1 + (chains_above(place[n].up) if place[n].up else 0)

    assert max(map(chains_above, place)) <= 7 and len({r.chain for r in place.values()}) == 64


def test_renames_keep_and_copies_begin(spark):
    rows = [
        (1, 0, "alice", [], [("A", "src/original.py", None)]),
        (2, 30, "bob", [1], [("R", "src/renamed.py", "src/original.py")]),
        (3, 32, "bob", [2], [("C", "src/copy.py", "src/renamed.py")]),
        (4, 33, "bob", [3], [("D", "src/renamed.py", None)]),
        (5, 40, "alice", [4], [("A", "src/renamed.py", None)]),
        (6, 75, "bob", [5], [("D", "src/renamed.py", None)]),
        (7, 300, "bob", [6], [("M", "src/copy.py", None), ("M", "src/missing.py", None)]),
    ]
    got = {r.actor: r for r in lineage.file_experience(Graph(spark, rows)).collect()}
    assert (got["alice"].creations, got["alice"].adopted, got["alice"].adopted_share) == (2, 1, 0.5)
    assert (got["bob"].edit_commits, got["bob"].cross_author) == (2, 1)  # the rename of alice's file, and the own copy
    assert (got["bob"].own_touches, got["bob"].returns, got["alice"].own_touches) == (1, 1, 0)


def test_commits_at_their_root_leave_the_rounds(spark, monkeypatch):
    """64 roots and a line of 8: after the first round of each loop only the line goes on, so that roots never meet in one task by a null."""
    counts, plain = [], lineage.staged_count

    def counted(df, name, condition):
        out = plain(df, name, condition)
        counts.append((name, out[0].count()))
        return out

    monkeypatch.setattr(lineage, "staged_count", counted)
    first = spark.createDataFrame([(s, s - 1 if 1 < s <= 8 else None) for s in range(1, 73)], "sha long, parent long")
    got = {r.sha: (r.chain, r.depth, r.up) for r in lineage.chains(first).collect()}
    assert got == {s: (1, s - 1, None) if s <= 8 else (s, 0, None) for s in range(1, 73)}
    for loop in ("reach", "pointers"):
        rounds = [n for name, n in counts if name == loop]
        assert rounds[0] == 72 and len(rounds) > 1 and max(rounds[1:]) <= 7


def test_many_commits_are_dealt_out_by_number(spark, monkeypatch):
    """Tasks get their rows by the number of rows, not by what adaptive execution joins to one; the chains are the same."""
    first = spark.createDataFrame([(s, None if s == 1 else s - 1 if s % 50 else s // 2) for s in range(1, 600)], "sha long, parent long")
    want = sorted(map(tuple, lineage.chains(first).collect()), key=str)
    monkeypatch.setattr(lineage, "FEW_ROWS", 50)
    monkeypatch.setattr(staging, "TASK_ROWS", 40, raising=False)
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lineage.chains(first)
        assert len(want) == 599 and sorted(map(tuple, got.collect()), key=str) == want
        assert got.rdd.getNumPartitions() >= 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)


def test_writes_at_one_place_come_in_one_order(spark):
    """A rename to its own path writes it twice at one place; whichever row comes first, its end is found, as in the SQL."""
    place = spark.createDataFrame([(1, 1, 0, None, 0), (2, 1, 1, None, 0)], "sha long, chain long, depth long, up long, top long")
    reads = spark.createDataFrame([(9, "p", 1, 1, 0)], "id long, path string, chain long, depth long, pos long")
    own, away = (5, "p", 1, 0, 1), (-6, "p", 1, 0, 1)
    for rows in ([own, away], [away, own]):
        writes = spark.createDataFrame(rows, "write long, path string, chain long, depth long, pos long").coalesce(1)
        assert [r.write for r in lineage.found_before(reads, writes, place).collect()] == [-6]


def test_writes_are_dealt_out_once(spark, monkeypatch):
    """Rounds move the reads that are open, and not all writes again: as_of, which shuffles both, is left for chains of over BLOCK generations."""
    sides = []

    def seen(left, right, *rest):
        sides.append(right)
        return plain(left, right, *rest)

    plain = lineage.as_of
    monkeypatch.setattr(lineage, "as_of", seen)
    rows = drawn(2, 90)
    f = Graph(spark, rows)
    got = lineage.lineage(f.commits, f.graph_parents, f.graph_changes).collect()
    where = {r.id: (r.sha, r.pos) for r in got}
    assert {(r.sha, r.pos): where.get(r.creation) for r in got} == walked(rows) and not sides


def test_tables_on_the_way_are_deleted(spark, monkeypatch):
    """Of the staged tables, those that the result reads are left."""
    places, plain = [], staging._place

    def placed(session, name):
        places.append(plain(session, name))
        return places[-1]

    monkeypatch.setattr(staging, "_place", placed)
    rows = [(1, 0, "alice", [], [("A", "a", None)]), (2, 30, "bob", [1], [("M", "a", None)]), (3, 40, "bob", [2], [("R", "b", "a")])]
    out = lineage.file_experience(Graph(spark, rows))
    left = [p for p in map(Path, (p.removeprefix("file:") for p in places)) if p.exists()]
    assert len(places) > 20 and {p.stem for p in left} == {"touches", "marks", "pointers"}
    assert {(r.actor, r.edit_commits, r.cross_author) for r in out.collect()} == {("alice", 0, 0), ("bob", 2, 2)}
