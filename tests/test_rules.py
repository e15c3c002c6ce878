"""Literal cases of the classification rules."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import dates, observe, pseudonyms, rules, trailers


def each(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_roles(spark):
    paths = ["tests/a.py", "src/test_x.py", "src/_test.py", "src/x_test.py", "a_test.go", "A.SPEC.TS", "x_spec.rb", "docs/a.py", "README.md", ".github/workflows/ci.yml", "src\\app.py", "LICENSE"]
    assert each(spark, rules.path_role, paths) == ["test", "test", "test", "prod", "test", "test", "test", "docs", "docs", "prod", "prod", "docs"]


def test_surfaces(spark):
    paths = ["tests/ui/a.tsx", ".github/workflows/ci.yml", "docker/a.py", "db/migrations/1.sql", "ui/a.tsx", "api/a.py", "pyproject.toml", "vendor/x.bin", "a.min.js", "notes"]
    assert each(spark, rules.surface, paths) == ["test", "ci_cd", "platform", "data", "frontend", "backend", "config", "generated_vendor", "generated_vendor", "other"]


def test_domains(spark):
    paths = ["requirements-dev.txt", "src/a_test.py", "docs/x.py", "README", "infra/x.bin", "main.tf", "src/x.bin", "a.py", "x.bin", "build.gradle.kts"]
    assert each(spark, rules.domain, paths) == ["deps", "test", "docs", "docs", "infra", "infra", "core", "core", "unclassified", "deps"]


def test_families_and_modules(spark):
    assert each(spark, rules.language_family, ["a.HPP", "b.yml", "c", "d.tsx"]) == ["c_cpp", "configuration", "other", "typescript"]
    assert each(spark, rules.top_module, ["a/b", "a", "./x/y", ""]) == ["a", None, "x", None]


def test_subjects(spark):
    subjects = ["fix: a", "Fix(b)", "fixes #3", "prefix", "bugfix x", 'Revert "a"', "This reverts commit 1", "fixture"]
    assert each(spark, rules.is_corrective, subjects) == [True, True, True, False, True, True, True, False]
    assert each(spark, rules.subject_class, subjects[5:]) == ["revert", "revert", "other"]
    assert each(spark, rules.is_conventional, ["feat(x)!: a", "feat:a", "docs: b"]) == [True, False, True]
    assert each(spark, rules.has_issue_link, ["see #12", "closed #x", "close x"]) == [True, True, False]


def test_addresses(spark):
    assert each(spark, rules.is_bot_email, ["x[bot]@y", " Action@GitHub.com ", "me@x"]) == [True, True, False]
    want = hashlib.sha256(b"email\0a@b").hexdigest()
    assert each(spark, lambda x: rules.digest("email", rules.normal_email(x)), [" A@b "]) == [want]
    assert each(spark, rules.slug, ["Ann  B.", "--", "a_b"]) == ["ann-b", None, "a_b"]


def test_remotes(spark):
    urls = ["https://u:p@Host.example:8443/a/b.git?x#y", "git@host.example:a/b.git", "/local", "file:///a", "ssh://git@host.example/a/../b", "host.example/a", "https://host.example"]
    assert each(spark, rules.remote_identity, urls) == ["host.example:8443/a/b", "host.example/a/b", None, None, None, "host.example/a", "host.example"]


def test_buckets(spark):
    assert each(spark, rules.count_bucket, [0, 4, 19, 99, 499, 1999, 2000], "long") == ["0", "1-4", "5-19", "20-99", "100-499", "500-1999", "2000+"]
    assert each(spark, rules.ratio_bucket, [0.0, 0.55, 1.0], "double") == ["00-10%", "50-60%", "90-100%"]
    assert each(spark, rules.share_strength, [0.39, 0.4, 0.6], "double") == ["weak", "moderate", "strong"]


def test_rounding(spark):
    assert each(spark, observe.rounded, [1 / 32], "double") == [0.0313]
    assert each(spark, observe.half_even, [1 / 32], "double") == [0.0312]


def test_dates(spark):
    got = each(spark, lambda x: dates.utc_instant(x).cast("string"), ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00+518:00", "2024-01-01T00:00:00-0130", "x"])
    assert got == ["2024-01-01 00:00:00", "2023-12-31 22:00:00", "2023-12-10 10:00:00", "2024-01-01 01:30:00", None]
    assert each(spark, dates.zone_rule, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+02:00"]) == ["utc_zulu", "utc_offset", "normalized"]


TRAILED = "subject\n\nbody\n\nCo-authored-by: Ann <Ann@X.test>\nAI-Assisted-By: tool\n continued\n# comment\n"


@pytest.mark.parametrize(
    ("message", "want"),
    [
        (TRAILED, [("co-authored-by", "Ann <Ann@X.test>"), ("ai-assisted-by", "tool continued")]),
        ("Key: value", []),
        ("s\n\nprose\nKey: value", []),
        ("s\n\n continued: x", []),
        ("", []),
        (None, []),
    ],
)
def test_trailers(spark, message, want):
    got = each(spark, trailers.trailers, [message])[0]
    assert [(p.key, p.value) for p in got] == want


def test_coauthors(spark):
    known = F.array(F.lit("ann@x.test"))
    plain = "s\n\nCo-authored-by: B <b@x.test>"
    assert each(spark, lambda x: trailers.declared_assist(x, known), [TRAILED, plain, "s\n\nCo-authored-by: A <ann@x.test>"]) == [True, False, True]
    assert each(spark, lambda x: trailers.human_coauthor(x, known), [TRAILED, plain]) == [False, True]


def test_pseudonyms(spark):
    key = pseudonyms.scope_key(b"secret", "a")
    one, two, none = each(spark, lambda x: pseudonyms.pseudonym(x, key), ["x", "y", None])
    assert one != two and none is None and one.startswith("actor_") and len(one) == 32
    assert pseudonyms.scope_key(b"secret", "b") != key


def test_shares_round_as_in_sql_where_the_digits_tie(spark):
    ties = [(n, d) for d in (16, 800, 1600, 2000, 4000) for n in range(d + 1) if 20_000 * n % d == 0 and 20_000 * n // d % 2]
    got = {(r.n, r.d): r.x for r in spark.createDataFrame(ties, "n long, d long").select("n", "d", observe.ratio(F.col("n"), F.col("d")).alias("x")).collect()}
    con = duckdb.connect()
    want = {(n, d): con.execute(f"SELECT round(CAST({n} AS DOUBLE) / {d}, 4)").fetchone()[0] for n, d in ties}
    assert got == want and got[57, 800] == 0.0712
