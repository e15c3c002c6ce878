"""Readers and writers."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import declarations, exports, git_history, manifests, sinks


@pytest.fixture
def repository(tmp_path):
    def git(*args, day="2024-01-01"):
        env = {"GIT_AUTHOR_DATE": f"{day}T12:00:00+0200", "GIT_COMMITTER_DATE": f"{day}T12:00:00+0200", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin"}
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=ann@x.test", *args], check=True, capture_output=True, env=env)

    git("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    git("add", ".")
    git("commit", "-qm", "feat: start")
    (tmp_path / "b.py").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "fix: more", day="2024-01-05")
    git("tag", "-a", "v1", "-m", "v1")
    return str(tmp_path)


def test_git_history(spark, repository):
    git_history.register(spark)

    def read(table):
        return spark.read.format("git_history").option("path", repository).option("table", table).load().collect()

    commits = read("commits")
    assert [(r.ord, r.subject, r.local_day, len(r.parents)) for r in commits] == [(0, "fix: more", "2024-01-05", 1), (1, "feat: start", "2024-01-01", 0)]
    assert {(r.path, r.added) for r in read("numstat")} == {("a.py", 2), ("b.py", 1)}
    assert {(r.status, r.path) for r in read("changes")} == {("A", "a.py"), ("A", "b.py")}
    assert [(r.name, r.annotated, r.target) for r in read("tags")] == [("v1", True, commits[0].sha)]


def event(i, at="2024-01-15T01:00:00Z", **more):
    return json.dumps({"event_id": str(i), "event_type": "PushEvent", "occurred_at": at, "repository": "o/r"} | more)


def test_events(spark, tmp_path):
    (tmp_path / "e.ndjson").write_text("\n".join([event(1), event(1, "2024-01-15T00:00:00Z"), event(2, "2024-01-15T03:00:00+02:00"), event(3, "2024-02-01T00:00:00Z")]))
    window = ("2024-01-15 00:00:00", "2024-01-16 00:00:00")
    got = exports.read_events(spark, str(tmp_path / "e.ndjson"), *window, strict=False).orderBy("event_id").collect()
    assert [(r.event_id, str(r.occurred_at), r.zone_rule) for r in got] == [("1", "2024-01-15 00:00:00", "utc_zulu"), ("2", "2024-01-15 01:00:00", "normalized")]
    with pytest.raises(exports.ExportError):
        exports.read_events(spark, str(tmp_path / "e.ndjson"), *window)


@pytest.mark.parametrize("line", [event(1, extra="x"), event(1, event_type="OtherEvent"), "{", event(1, "yesterday")])
def test_events_with_a_closed_schema(spark, tmp_path, line):
    (tmp_path / "e.ndjson").write_text(line)
    with pytest.raises(exports.ExportError):
        exports.read_events(spark, str(tmp_path / "e.ndjson"))


def test_forge_export(spark, tmp_path):
    body = {"schema_version": "1", "provider": "p", "events": [{"event_id": "a", "kind": "pull_request_review", "timestamp": "2024-01-01T00:00:00Z", "actor_canonical_id": "x", "pr_number": 3}]}
    (tmp_path / "f.json").write_text(json.dumps(body))
    row = exports.read_forge(spark, str(tmp_path / "f.json")).first()
    assert (row.pos, row.pr_number, str(row.ts)) == (0, 3, "2024-01-01 00:00:00")
    body["events"] *= 2
    (tmp_path / "f.json").write_text(json.dumps(body))
    with pytest.raises(exports.ExportError):
        exports.read_forge(spark, str(tmp_path / "f.json"))


def test_lifecycle(spark, tmp_path):
    header = ",".join(exports.LIFECYCLE_COLUMNS)
    rows = ["f,issue,1,p,2024-01-01T00:00:00Z,,,,2024-01-02T00:00:00Z,,closed,,", "f,pull_request,2,p,2024-01-01T00:00:00Z,,,2024-01-01T07:00:00Z,,,merged,,", "f,release,3,p,2024-01-03T00:00:00Z,,,,,2024-01-03T00:00:00Z,released,,"]
    (tmp_path / "l.csv").write_text("\n".join([header, *rows]))
    row = exports.lifecycle_summary(exports.read_lifecycle(spark, str(tmp_path / "l.csv"))).first()
    assert (row.issue_to_close_hours, row.pr_to_merge_hours, row.releases, row.active_days) == (24.0, 7.0, 1, 3)
    (tmp_path / "l.csv").write_text("\n".join([header.replace("notes", "note"), *rows]))
    with pytest.raises(exports.ExportError):
        exports.read_lifecycle(spark, str(tmp_path / "l.csv"))


def test_manifests(spark):
    files = [
        ("package.json", '{"dependencies": {"left": "1"}, "devDependencies": {"right": "2"}}'),
        ("a/requirements.txt", "# c\nFoo_Bar==1\nbaz>=2 # x\n-r other\n"),
        ("pyproject.toml", '[project]\ndependencies = ["Alpha>=1"]\n'),
        ("Cargo.toml", '[dependencies]\nserde = "1"\n'),
        ("go.mod", "module x\nrequire (\n\texample.org/a/b v1.2.0\n)\n"),
        ("bad/package.json", "{"),
        ("src/a.py", "x"),
    ]
    got = manifests.declared(spark.createDataFrame(files, "path string, body string"))
    assert {(r.ecosystem, r.name) for r in got.collect()} == {("npm", "left"), ("npm", "right"), ("pypi", "foo-bar"), ("pypi", "baz"), ("pypi", "alpha"), ("crates", "serde"), ("go", "example.org/a/b")}


def test_mailmap(spark, tmp_path):
    (tmp_path / "m").write_text("Ann <ann@x> <old@x>\nBob <bob@x> Bobby <old@x>\n# no\nCy <cy@x>\nDee <dee@x> <old2@x>\nEve <eve@x> <old2@x>\n")
    mailmap = declarations.read_mailmap(spark, str(tmp_path / "m"))
    people = spark.createDataFrame([("Any", "OLD@x"), ("bobby", "old@x"), ("C", "cy@x"), ("D", "old2@x"), ("Z", "z@x")], "author_name string, author_email string")
    got = {r.author_name: (r.canonical_name, r.canonical_email) for r in declarations.canonical_authors(people, mailmap).collect()}
    assert got == {"Any": ("Ann", "ann@x"), "bobby": ("Bob", "bob@x"), "C": ("Cy", "cy@x"), "D": ("Eve", "eve@x"), "Z": ("Z", "z@x")}


def test_declarations(spark):
    got = declarations.identities(spark, '[[actors]]\ncanonical_id = "a"\nemails = ["A@x"]\n')
    assert [(r.canonical_id, r.email, r.consent) for r in got.collect()] == [("a", "a@x", False)]
    with pytest.raises(declarations.DeclarationError):
        declarations.identities(spark, '[[actors]]\ncanonical_id = "a"\nemails = ["x"]\n[[actors]]\ncanonical_id = "b"\nemails = ["x"]\n')
    needs = declarations.requirements(spark, '[rhythm]\nmin_active_days = 20\nmax_gap = 14.0\n[surfaces]\nneeded = ["backend"]\n').collect()
    assert {(r.name, r.bound, r.target) for r in needs} == {("active_days", "min", 20.0), ("gap", "max", 14.0), ("backend", "presence", None)}


def test_collection(spark, tmp_path):
    cards = spark.createDataFrame([("a", 1), ("b", 2)], "actor string, n int")
    sinks.write_collection(cards, str(tmp_path / "c"))
    assert sinks.verify_collection(spark, str(tmp_path / "c")).count() == 0
    changed = spark.read.parquet(str(tmp_path / "c/cards")).withColumn("value", F.concat("value", F.when(F.col("key") == "a", " ").otherwise("")))
    changed.write.parquet(str(tmp_path / "d/cards"))
    spark.read.parquet(str(tmp_path / "c/manifest")).write.parquet(str(tmp_path / "d/manifest"))
    assert {r.key for r in sinks.verify_collection(spark, str(tmp_path / "d")).collect()} == {"a"}
