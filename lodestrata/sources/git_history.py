"""A data source over git repositories: `spark.read.format("git_history")`.

Options: `path` (folders, separated by commas); `table`: commits, files, numstat, changes,
order, tags or blame; `revision` (HEAD unless told); `slice`, the commits or files of a
partition; for blame `match`, a regular expression of the paths to read. The revision is
resolved once, and a partition is a slice of its log or of its files, read as a stream of
records, so that no task holds a history. Land it as Parquet before measuring.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from tempfile import TemporaryFile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "repo string, sha string, ord int, author_email string, author_name string, parents array<string>, local_day string, author_iso string, subject string, message string",
    "files": "repo string, sha string, path string",
    "numstat": "repo string, sha string, path string, added long, deleted long",
    "changes": "repo string, sha string, status string, path string, old_path string",
    "order": "repo string, sha string, sequence long",
    "tags": "repo string, name string, target string, tagged_iso string, annotated boolean",
    "blame": "repo string, path string, line long, sha string, author_sec long",
}
#: Commits or files of a partition.
SLICES = {"commits": 20_000, "files": 20_000, "numstat": 5_000, "changes": 5_000, "blame": 200}
_CHUNK = 1 << 16


class GitFailure(RuntimeError):
    """git ended with an error; its message is that of git."""


def _records(repo: str, *args: str, end: bytes = b"\n") -> Iterator[bytes]:
    """What git writes, cut at `end`; one chunk and one record are held at a time."""
    with TemporaryFile() as errors, subprocess.Popen(["git", "-C", repo, "-c", "core.quotePath=off", *args], stdout=subprocess.PIPE, stderr=errors) as process:
        rest = b""
        while chunk := process.stdout.read(_CHUNK):
            *whole, rest = (rest + chunk).split(end)
            yield from whole
        if rest:
            yield rest
        if process.wait():
            errors.seek(0)
            raise GitFailure(f"git {args[0]} in {repo}: {errors.read().decode(errors='replace').strip()}")


def _lines(repo: str, *args: str) -> Iterator[str]:
    return (x.decode(errors="replace") for x in _records(repo, *args))


@dataclass
class Slice(InputPartition):
    """A part of a repository at a resolved revision: `count` commits or files after the first `skip`."""

    repo: str
    revision: str
    skip: int
    count: int
    match: str | None = None

    @property
    def log(self) -> list[str]:
        return ["log", f"--skip={self.skip}", f"--max-count={self.count}"]


def _commits(s: Slice) -> Iterator[tuple]:
    rows = _records(s.repo, *s.log, "-z", "--format=%H%x1f%ae%x1f%an%x1f%P%x1f%ad%x1f%aI%x1f%s%x1f%B", "--date=short", s.revision, end=b"\0")
    for n, row in enumerate((x for x in rows if x), s.skip):
        sha, email, name, parents, day, iso, subject, body = row.decode(errors="replace").split("\x1f", 7)
        yield s.repo, sha, n, email, name, parents.split(), day, iso, subject, body


def _per_commit(s: Slice, *args: str) -> Iterator[tuple[str, str]]:
    """(sha, line) of each line that git tells of a commit."""
    sha = ""
    for line in _lines(s.repo, *s.log, "--format=%x1e%H", *args, s.revision):
        if line.startswith("\x1e"):
            sha = line[1:]
        elif line:
            yield sha, line


def _files(s: Slice) -> Iterator[tuple]:
    return ((s.repo, sha, path) for sha, path in _per_commit(s, "--name-only"))


def _numstat(s: Slice) -> Iterator[tuple]:
    for sha, line in _per_commit(s, "--numstat", "--no-renames"):
        added, deleted, path = line.split("\t", 2)
        if added != "-":  # binary files have no lines
            yield s.repo, sha, path, int(added), int(deleted)


def _changes(s: Slice) -> Iterator[tuple]:
    for sha, line in _per_commit(s, "--name-status", "-M50%", "-C50%", "--diff-merges=first-parent"):
        status, *paths = line.split("\t")
        yield s.repo, sha, status[0], paths[-1], paths[0] if len(paths) > 1 else None


def _order(s: Slice) -> Iterator[tuple]:
    return ((s.repo, sha, n) for n, sha in enumerate(_lines(s.repo, "rev-list", "--reverse", "--topo-order", s.revision)))


def _tags(s: Slice) -> Iterator[tuple]:
    for line in _lines(s.repo, "for-each-ref", "refs/tags", "--format=%(refname:short)%1f%(objecttype)%1f%(objectname)%1f%(*objectname)%1f%(creatordate:iso-strict)"):
        name, kind, own, peeled, iso = line.split("\x1f")
        yield s.repo, name, peeled or own, iso, kind == "tag"


def _tree(repo: str, revision: str, match: str | None) -> Iterator[str]:
    """The paths of the files (no submodules) at a revision that `match` finds something in."""
    wanted = re.compile(match or "")
    for entry in _records(repo, "ls-tree", "-r", "-z", revision, end=b"\0"):
        kind, _, path = entry.partition(b"\t")
        name = path.decode(errors="surrogateescape")
        if kind.split()[1:2] == [b"blob"] and wanted.search(name):
            yield name


def _blame(s: Slice) -> Iterator[tuple]:
    for path in islice(_tree(s.repo, s.revision, s.match), s.skip, s.skip + s.count):
        shown = path.encode(errors="surrogateescape").decode(errors="replace")
        sha, number, sec = "", 0, 0
        for line in _records(s.repo, "blame", "--line-porcelain", s.revision, "--", path):
            if line.startswith(b"\t"):  # the text ends a line's record
                yield s.repo, shown, number, sha, sec
                sha = ""
            elif not sha:
                first, _, final, *_ = line.split(b" ")
                sha, number = first.decode(), int(final)
            elif line.startswith(b"author-time "):
                sec = int(line.split(b" ")[1])


_READERS = {"commits": _commits, "files": _files, "numstat": _numstat, "changes": _changes, "order": _order, "tags": _tags, "blame": _blame}


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, revision: str, size: int | None, match: str | None):
        self.paths, self.table, self.revision, self.size, self.match = paths, table, revision, size, match

    def partitions(self) -> list[InputPartition]:
        return [s for repo in self.paths for s in self._slices(repo)]

    def _slices(self, repo: str) -> list[Slice]:
        if self.table == "tags":
            return [Slice(repo, "", 0, 0)]
        revision = next(_lines(repo, "rev-parse", "--verify", f"{self.revision}^{{commit}}"))
        if self.table == "order":
            return [Slice(repo, revision, 0, 0)]
        size = self.size or SLICES[self.table]
        total = sum(1 for _ in _tree(repo, revision, self.match)) if self.table == "blame" else int(next(_lines(repo, "rev-list", "--count", revision)))
        return [Slice(repo, revision, n, size, self.match) for n in range(0, total, size)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _READERS[self.table](partition)


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        size = int(self.options.get("slice", 0))
        if size < 0:
            raise ValueError("slice is the number of commits or files of a partition")
        paths = [p.strip() for p in self.options["path"].split(",")]
        return _Reader(paths, self.options.get("table", "commits"), self.options.get("revision", "HEAD"), size or None, self.options.get("match"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitHistory)
