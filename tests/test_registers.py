"""Digests of sets and registers of files."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from lodestrata.functions.digests import LEVELS, files_of, register_difference, set_digest
from lodestrata.operators.registers import register_counts
from lodestrata.plans.registry import ORACLES
from lodestrata.plans.surrogate import Frames


def plain(members):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    nodes = [(digest(m), digest(m)) for m in set(members)]
    for digits in LEVELS:
        blocks = {}
        for place, d in sorted(nodes):
            blocks.setdefault(place[:digits], []).append(d)
        nodes = [(place, digest(",".join(ds))) for place, ds in blocks.items()]
    return nodes[0][1]


def test_set_digest(spark):
    sets = {"a": [f"tag {n}" for n in range(5000)], "b": ["x"], "c": ["x", "y", "x"], "d": ["y", "x"]}
    rows = [(k, m) for k, ms in sets.items() for m in ms] + [("b", None), ("e", None)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k string, m string").repartition(parts)
        got = {r.k: (r.members, r.digest) for r in set_digest(df, ["k"], F.col("m")).collect()}
        assert got == {k: (len(set(ms)), plain(ms)) for k, ms in sets.items()} and got["c"] == got["d"]


def test_register_of_files(spark, tmp_path):
    for name, body in {"same": b"1", "changed": b"2", "extra": b"3"}.items():
        (tmp_path / name).write_bytes(body)
    listed = [(n, hashlib.sha256(b).hexdigest(), len(b)) for n, b in {"same": b"1", "changed": b"4", "missing": b"5"}.items()]
    registered = spark.createDataFrame([*listed, listed[0]], "path string, digest string, bytes long")
    present = files_of(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {(r.path, r.kind) for r in register_difference(registered, present).collect()} == {("changed", "changed"), ("missing", "missing"), ("extra", "extra")}
    twice = spark.createDataFrame([listed[0], ("same", "other", 1)], "path string, digest string, bytes long")
    assert [(r.path, r.kind) for r in register_difference(twice, present.where("path = 'same'")).collect()] == [("same", "changed")]


def test_pages_that_share_an_address(spark, tmp_path):
    # 2 is kept, 3 missing, 4 changed, 5 has a copy: all of them at one address, as are 24 and 25 at none
    pages = [(n, "http://a.test/", f"<p>{n}</p>") for n in (2, 3, 4, 5, 23)] + [(6, "http://b.test/", "x"), (24, None, None), (25, None, "y")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.kind: (r.n, r.first_path) for r in register_counts(Frames(spark, str(tmp_path))).collect()}
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {k: (n, p) for k, n, p in duckdb.execute(ORACLES["src30_register"]).fetchall()}
    assert got["missing"] == (2, "http://a.test/") and got["changed"] == (2, "http://a.test/") and got["extra"] == (2, "http://a.test/.bak")
