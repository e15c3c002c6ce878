"""Measures on literal histories."""

import datetime as dt

import pytest

from lodestrata.functions.ordering import running_sum, with_previous
from lodestrata.operators import commits, graph, paths, people
from lodestrata.plans.surrogate import Frames
from pyspark.sql import functions as F


class Literal(Frames):
    """Frames over rows (sha, day, subject, paths) of one repository."""

    def __init__(self, spark, rows):
        self.spark = spark
        day = dt.date.fromisoformat
        seconds = lambda d: (day(d) - dt.date(1970, 1, 1)).days * 86400
        self.__dict__["commits"] = spark.createDataFrame(
            [(1, i, i, "a", 1, "A", "a@x.test", day(d), seconds(d), s, False, False) for i, (d, s, _) in enumerate(rows)],
            "repo long, sha long, ord long, actor string, customer long, author_name string, author_email string, local_day date, author_sec long, subject string, is_merge boolean, is_bot boolean",
        )
        self.__dict__["changes"] = spark.createDataFrame([(i, p, "M", 1, 0) for i, (_, _, ps) in enumerate(rows) for p in ps], "sha long, path string, status string, added long, deleted long")


@pytest.mark.parametrize(
    ("second", "day", "want"),
    [("feat: polish", "2026-01-10", (1, 0)), ("fix: crash", "2026-01-10", (1, 1)), ("fix: crash", "2026-01-24", (0, 0)), ("fix: crash", "2026-01-23", (1, 1))],
)
def test_rework_window(spark, second, day, want):
    f = Literal(spark, [("2026-01-02", "feat: start", ["app.py"]), (day, second, ["app.py"])])
    row = commits.rework(f).first()
    assert (row.retouch, row.corrective) == want and row.population == 2 and row.corrective_rate == want[1] / 2


def test_same_day_touch_is_a_retouch(spark):
    f = Literal(spark, [("2026-01-02", "a", ["x.py"]), ("2026-01-02", "b", ["x.py"])])
    assert commits.rework(f).first().retouch == 1


def test_cochange_counts(spark):
    f = Literal(spark, [("2026-01-01", "a", ["src/a.py", "tests/a.py"]), ("2026-01-02", "b", ["src/a.py"]), ("2026-01-03", "c", ["tests/a.py"]), ("2026-01-04", "d", ["README.md"]), ("2026-01-05", "e", [])])
    row = commits.test_cochange(f).first()
    assert (row.population, row.cochanged, row.test_only, row.docs_only, row.rate, row.narrate_rate) == (2, 1, 1, 1, 0.5, False)


def test_no_production_is_no_zero(spark):
    row = commits.test_cochange(Literal(spark, [("2026-01-01", "a", ["README.md"])])).first()
    assert row.rate is None and row.reason == "no_production_commits"


def test_core_period_prefers_short_and_early(spark):
    days = [f"2025-{m:02d}-{d:02d}" for m in (9, 10, 11, 12) for d in range(1, 22)] + [f"2026-03-{d:02d}" for d in range(1, 14)]
    row = commits.core_period(Literal(spark, [(d, "x", []) for d in days])).first()
    assert (row.start, row.end) == ("2025-09", "2025-12") and 0.80 <= row.share <= 0.88


@pytest.mark.parametrize(("n", "stage"), [(2, "dormant"), (3, "maintained"), (12, "active")])
def test_lifecycle_bands(spark, n, stage):
    f = Literal(spark, [(f"2026-01-{d + 1:02d}", "x", ["a.py"]) for d in range(n)])
    assert commits.context(f).first().lifecycle_stage == stage


def test_rhythm_withholds_small_samples(spark):
    row = commits.rhythm(Literal(spark, [("2026-01-01", "a", []), ("2026-01-03", "b", [])])).first()
    assert row.sample == 2 and row.gaps == 1 and row.median_gap_days is None and row.reason == "insufficient_population"


def test_surface_pairs(spark):
    f = Literal(spark, [("2026-01-01", "a", ["api/a.py", "ui/a.tsx", "x.sql"])])
    assert {r.pair for r in paths.surface_pairs(f).collect()} == {"backend+data", "backend+frontend", "data+frontend"}


def test_descendants_of_a_diamond(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 9)], "sha long, parent long")
    got = graph.descendants(edges, spark.createDataFrame([(1,), (3,)], "sha long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (3, 3), (3, 4)]


def test_descendants_end_on_a_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (1, 2)], "sha long, parent long")
    assert graph.descendants(edges, spark.createDataFrame([(1,)], "sha long")).count() == 2


def test_ordering_over_buckets(spark):
    rows = spark.createDataFrame([("k", x) for x in (1, 2, 11, 35, 36)], "k string, x long")
    bucket = F.floor(F.col("x") / 10)
    got = with_previous(rows, ["k"], bucket, ["x"], {"x": "before"}).orderBy("x").collect()
    assert [r.before for r in got] == [None, 1, 2, 11, 35]
    sums = running_sum(rows, ["k"], bucket, ["x"], F.col("x"), "s").orderBy("x").collect()
    assert [r.s for r in sums] == [1, 3, 14, 49, 85]


def test_every_path_of_a_history_is_classified(spark):
    f = Literal(spark, [("2026-01-01", "a", ["no/such/part.py", "tests/b.py"]), ("2026-01-02", "b", ["odd name"])])
    assert {r.path for r in f.kinds.collect()} == {"no/such/part.py", "tests/b.py", "odd name"}
    assert f.classified("role").count() == 3


def test_releases_meet_fixes_by_chain(spark, sf_dir, monkeypatch):
    # fifty more releases of other histories in the repository and the days of each make no pairs with its fixes
    met, plain = [], graph.after_releases
    monkeypatch.setattr(graph, "after_releases", lambda placed, reached: met.append(plain(placed, reached).count()) or plain(placed, reached))
    f = Frames(spark, sf_dir)
    alone = {r.repo: r.fixes for r in graph.post_release_fixes(f).collect()}
    more = spark.range(1, 51).select((F.col("id") * 97_000_000).alias("shift"))
    other = f.commits.where("sha % 97 = 0").crossJoin(more).withColumn("sha", F.col("sha") + F.col("shift")).withColumn("customer", F.col("customer") + F.col("shift")).withColumn("subject", F.lit("tidy up")).drop("shift")
    wide = Frames(spark, sf_dir)
    wide.__dict__["commits"] = f.commits.unionByName(other)
    assert {r.repo: r.fixes for r in graph.post_release_fixes(wide).collect()} == alone
    assert met[0] == met[1]


def test_changes_are_classified_before_they_are_counted(spark, sf_dir, monkeypatch):
    # the language rule sees distinct paths; what reaches the count is a row for each group, not two for each change
    plan = paths.timeline(Frames(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    generate = plan.index("Generate explode")
    assert "Aggregate [repo" in plan[generate:] and "family" in plan[generate:]
    plan = paths.verification(Frames(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "bool_or" not in plan and "max((role" not in plan and "bit_or(mask" in plan


def test_subjects_end_before_the_paths_of_their_commits(spark, sf_dir):
    # what is sorted by path holds a flag of each subject, and the grouping by commit needs no sort
    plan = commits.retouches(Frames(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    last = plan[: plan.index("Window")]
    assert "subject" not in last and "corrective" in last


def test_retouches_meet_over_the_end_of_a_year(spark):
    days = ["2024-12-10", "2024-12-11", "2025-01-01", "2025-01-22", "2025-12-20", "2026-01-10", "2026-02-01", "2028-02-01"]
    f = Literal(spark, [(d, "feat: more", ["app.py"]) for d in days])
    assert [r.recent for r in commits.retouches(f).orderBy("sha").collect()] == [False, True, True, True, False, True, False, False]


def test_paths_go_by_number(spark, sf_dir):
    # neither the flags of commits nor retouches shuffle or sort lines by the text of a path, and lines are read once
    for frame in (Frames(spark, sf_dir).flags, commits.retouches(Frames(spark, sf_dir))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(path" not in plan and "path#" not in plan
        assert plan.count("ReadSchema: struct<l_orderkey") == 1


def test_flags_of_paths_that_parts_share(spark, sf_dir):
    f = Frames(spark, sf_dir)
    given = Frames(spark, sf_dir).keep("changes")
    assert f.files.groupBy("file").count().where("count > 1").limit(1).count() == (f.paths.groupBy("path").count().where("count > 1 AND path IS NOT NULL").limit(1).count())
    assert sorted(f.flags.collect()) == sorted(given.flags.collect())
    assert sorted(commits.retouches(f).collect()) == sorted(commits.retouches(given).collect())


def test_roles_by_phase_read_no_lines(spark, sf_dir):
    f = Frames(spark, sf_dir)
    one = people.role_profile(f, ("phase",))
    assert "lineitem" not in one._jdf.queryExecution().optimizedPlan().toString() and "l_orderkey" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(one.collect(), key=str) == sorted(people.role_profile(f).where("dimension = 'phase'").collect(), key=str)
