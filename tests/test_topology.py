"""Order, reachability and sizes over a graph, against walks from commit to commit."""

import random
from pathlib import Path

import pytest

from lodestrata.operators import topology
from lodestrata.sources import staging

COMMITS, PARENTS = "repo long, sha long, author_sec long", "sha long, n int, parent long"
CHANGES = "sha long, path string, status string, added long, deleted long"


def drawn(seed, n=220):
    """Parents by commit, clocks that jump both ways, and changes against the first parent of whole trees."""
    rng, graph, trees, clocks, changes = random.Random(seed), {}, {}, {}, []
    for sha in range(1, n + 1):
        tips = list(graph)[-15:]
        ps = rng.sample(tips, min(len(tips), 2 if rng.random() < 0.3 else 1)) if tips and rng.random() > 0.02 else []
        graph[sha], clocks[sha] = ps, sha * 1000 + rng.choice([0, 0, 0, 5_000_000, -900_000])
        first = dict(trees[ps[0]]) if ps else {}
        tree = dict(first)
        for p in ps[1:]:
            tree.update(trees[p])
        for name in rng.sample("abcdefgh", 2):
            if name in tree and rng.random() < 0.3:
                del tree[name]
            else:
                tree[name] = tree.get(name, 0) + rng.randrange(1, 9)
        for name in first.keys() | tree.keys():
            old, new = first.get(name), tree.get(name)
            if old != new:
                changes.append((sha, name, "A" if old is None else "D" if new is None else "M", new or 0, old or 0))
        trees[sha] = tree
    return graph, clocks, changes, trees


def frames(spark, graph, clocks, changes):
    commits = spark.createDataFrame([(1, s, clocks[s]) for s in graph], COMMITS).repartition(3)
    parents = spark.createDataFrame([(s, k, p) for s, ps in graph.items() for k, p in enumerate(ps)], PARENTS).repartition(2)
    return commits, parents, spark.createDataFrame(changes, CHANGES)


def above(graph, sha):
    seen, open_ = {sha}, [sha]
    while open_:
        for p in graph[open_.pop()]:
            if p not in seen:
                seen.add(p)
                open_.append(p)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_order_and_sizes(spark, seed):
    graph, clocks, changes, trees = drawn(seed)
    commits, parents, changes = frames(spark, graph, clocks, changes)
    rows = {r.sha: r for r in topology.topological(commits, parents).collect()}
    assert sorted(r.sequence for r in rows.values()) == list(range(len(graph)))
    want = {}
    for sha, ps in graph.items():
        want[sha] = max([clocks[sha], *(want[p] + 1 for p in ps)])
        assert all(rows[p].sequence < rows[sha].sequence for p in ps)
    assert {s: r.corrected for s, r in rows.items()} == want

    targets = commits.where("sha % 7 = 0")
    got = {r.sha: (r.commits, r.files, r.lines) for r in topology.sizes(commits, parents, changes, targets).collect()}
    assert got == {s: (len(above(graph, s)), len(trees[s]), sum(trees[s].values())) for s in graph if s % 7 == 0}


def test_descendants_by_ranges_and_by_time(spark):
    graph, clocks, changes, _ = drawn(3)
    commits, parents, _ = frames(spark, graph, clocks, changes)
    where = topology.place(commits, parents)
    cross = topology.crossings(where, parents)
    times = topology.corrected_times(commits, where, cross)
    placed = {r.sha: (r.chain, r.depth) for r in where.collect()}
    at = {r.sha: r.corrected for r in times.collect()}

    def members(rows):
        held = {(r.target, r.chain): -r.level for r in rows}
        return {(t, s) for t in {t for t, _ in held} for s, (c, d) in placed.items() if (t, c) in held and d >= held[t, c]}

    want = {(t, s) for s in graph for t in above(graph, s) if t % 10 == 0}
    targets = commits.where("sha % 10 = 0")
    assert members(topology.descendants(targets, where, cross).collect()) == want
    limit = 150_000
    bounded = members(topology.descendants(targets.selectExpr("sha", f"{limit}L AS until"), where, cross, times).collect())
    assert {p for p in want if at[p[1]] <= limit} <= bounded <= want


def test_lines_without_merges_and_unknown_parents(spark):
    commits = spark.createDataFrame([(1, s, 50) for s in range(1, 6)] + [(2, 9, 1)], COMMITS)
    parents = spark.createDataFrame([(s, 0, s - 1) for s in range(1, 6)], PARENTS)  # commit 0 was cut off
    got = topology.topological(commits, parents).orderBy("repo", "sequence").collect()
    assert [(r.repo, r.sha, r.corrected) for r in got] == [(1, 1, 50), (1, 2, 51), (1, 3, 52), (1, 4, 53), (1, 5, 54), (2, 9, 1)]
    assert topology.topological(commits.where("sha > 99"), parents).count() == 0


def test_clocks_late_by_a_few_commits_need_no_chains(spark, monkeypatch):
    """Runs of five late clocks in a line of commits with side branches: carried along edges, and the same as a walk."""
    monkeypatch.setattr(topology, "place", lambda *_: pytest.fail("built chains"))
    graph = {s: [p for p in (s - 1, s - 7) if p > 0 and (p == s - 1 or s % 3 == 0)] for s in range(1, 200)}
    clocks = {s: s * 1000 + (4_500 if s % 20 == 0 else 0) for s in graph}
    commits, parents, _ = frames(spark, graph, clocks, [(1, "a", "A", 1, 0)])
    want = {}
    for s, ps in graph.items():
        want[s] = max([clocks[s], *(want[p] + 1 for p in ps)])
    assert any(want[s] != clocks[s] for s in graph)
    assert {r.sha: r.corrected for r in topology.topological(commits, parents).collect()} == want


def test_rounds_of_reach_write_what_is_new(spark, tmp_path, monkeypatch):
    """Twelve chains one behind the other, the third of which is reached once more and higher: a round doesn't write the rows of the rounds before."""
    starts = spark.createDataFrame([(t, 0, 0, 10) for t in range(20)], "target long, until long, chain long, level long")
    steps = spark.createDataFrame([(c, 5, c + 1, 5 + (c == 9), 0) for c in range(12)] + [(5, 5, 3, 9, 0), (1, 7, 40, 1, 0), (2, 5, 41, 1, 1)], "chain long, level long, to_chain long, to_level long, stamp long")
    monkeypatch.setattr(staging, "_own", [str(tmp_path)])
    folder = Path((spark.conf.get("spark.checkpoint.dir", None) or str(tmp_path)).removeprefix("file://"))
    before = set(folder.glob("staged-*/reach.parquet"))
    got = {(r.target, r.chain): r.level for r in topology.reach(starts, steps).collect()}
    levels = {0: 10, 3: 9, 10: 6} | {c: 5 for c in (1, 2, 4, 5, 6, 7, 8, 9, 11, 12)}
    assert got == {(t, c): level for t in range(20) for c, level in levels.items()}
    written = sum(spark.read.parquet(str(p)).count() for p in set(folder.glob("staged-*/reach.parquet")) - before)
    assert written == len(got) + 20  # chain 3 twice
