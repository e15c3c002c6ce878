"""The git source in slices, against what git itself tells."""

import math
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import commits, topology
from lodestrata.sources import git_history


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder = tmp_path_factory.mktemp("history")

    def git(*args, n=0):
        env = {"GIT_AUTHOR_DATE": f"{1_700_000_000 + n * 86_400} +0000", "GIT_COMMITTER_DATE": f"{1_700_000_000 + n * 86_400} +0000", "HOME": str(folder), "PATH": "/usr/bin:/bin"}
        return subprocess.run(["git", "-C", str(folder), "-c", "user.name=Ann", "-c", "user.email=ann@x.test", *args], check=True, capture_output=True, env=env, text=True).stdout

    git("init", "-q", "-b", "main")
    for n in range(9):
        if n == 4:
            git("checkout", "-qb", "side", "HEAD~1")
        if n == 6:
            git("checkout", "-q", "main")
        (folder / f"f{n % 4 if n < 4 else n}.py").write_text("".join(f"{k} {n}\n" for k in range(n + 2)))
        (folder / f"größe {n}.md").write_text("x\n")
        git("add", ".")
        git("commit", "-qm", f"change {n}\n\nbody of {n}", n=n)
    git("merge", "-q", "--no-ff", "-m", "join", "side", n=10)
    (folder / "f0.py").write_text("0 0\nnew line\n\tindented\n")
    git("commit", "-qam", "edit", n=100)
    git("tag", "plain")
    return str(folder), git


@pytest.fixture
def read(spark, repository):
    git_history.register(spark)

    def load(table, **options):
        return spark.read.format("git_history").options(path=repository[0], table=table, **options).load()

    return load


@pytest.mark.parametrize("table", ["commits", "files", "numstat", "changes", "blame"])
def test_slices_make_the_whole(read, table):
    whole, cut = read(table), read(table, slice=2)
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() > 4
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect())) and whole.count() > 5


def test_order_and_sizes_at_a_revision(spark, repository, read):
    folder, git = repository
    got = [r.sha for r in read("order").orderBy("sequence").collect()]
    assert got == git("rev-list", "--reverse", "--topo-order", "HEAD").split()
    rows = read("commits").withColumn("author_sec", F.unix_timestamp(F.to_timestamp("author_iso")))
    parents = rows.select("sha", F.posexplode("parents").alias("n", "parent"))
    told = {r.sha: r.sequence for r in topology.topological(rows, parents).collect()}
    assert all(told[r.parent] < told[r.sha] for r in parents.collect()) and len(told) == 11

    # against the first parent, as trees are
    log = git("log", "--first-parent", "-m", "--numstat", "--no-renames", "--format=%x1e%H")
    stats = [(block.split()[0], *line.split("\t")) for block in log.split("\x1e")[1:] for line in block.splitlines()[1:] if line]
    lines = spark.createDataFrame([(s, p.strip('"'), int(a), int(d)) for s, a, d, p in stats], "sha string, path string, added long, deleted long")
    kinds = read("changes").select("sha", "status").withColumns({"added": F.lit(0).cast("long"), "deleted": F.lit(0).cast("long")})
    changes = kinds.unionByName(lines.select("sha", F.lit("M").alias("status"), "added", "deleted"))
    size = topology.sizes(rows, parents, changes, rows.where(F.col("subject") == "edit")).first()
    tree = git("ls-tree", "-r", "--name-only", "HEAD").splitlines()
    counted = sum(int(x.rsplit(":", 1)[1]) for x in git("grep", "-I", "--count", "-e", "^", "HEAD").splitlines())
    assert (size.commits, size.files, size.lines) == (11, len(tree), counted)


def test_blame_and_what_survives(spark, repository, read):
    folder, git = repository
    rows = read("blame", match=r"\.py$").collect()
    sources = [x for x in git("ls-tree", "-r", "--name-only", "HEAD").splitlines() if x.endswith(".py")]
    assert {r.path for r in rows} == set(sources)
    want = [(x.split()[0].lstrip("^"), k) for k, x in enumerate(git("blame", "-l", "HEAD", "--", "f0.py").splitlines(), 1)]
    assert sorted((r.line, r.sha[:39]) for r in rows if r.path == "f0.py") == sorted((k, s[:39]) for s, k in want)
    head = 1_700_000_000 + 100 * 86_400
    got = commits.line_survival(read("blame", slice=3), spark.createDataFrame([(folder, head)], "repo string, head_sec long")).first()
    decay = sum(math.exp(-(head - r.author_sec) / (180 * 86_400)) for r in rows) / len(rows)
    assert (got.files_sampled, got.lines_sampled) == (len(sources), len(rows)) and got.survival_index == pytest.approx(decay, abs=6e-5)


def test_failures_are_told(read):
    with pytest.raises(Exception, match="rev-parse"):
        read("commits", revision="no-such-thing").collect()
    assert {r.ord for r in read("commits", revision="HEAD~1").collect()} == set(range(10))
