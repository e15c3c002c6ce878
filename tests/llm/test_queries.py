"""The registered queries at their contracts' columns: against DuckDB where there is SQL, else against plain code."""

import hashlib
import math
import zlib

import duckdb
import public_tokenizers
import pytest
from test_secrets import plain as plain_spans
from tokenizers import Tokenizer

from lodestrata.llm import queries, secrets


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == names

    def shown(row):
        return tuple(round(x, 12) if isinstance(x, float) else x for x in row)

    assert sorted(shown(r) for r in got.select(*names).collect()) == sorted(shown(r[k] for k in order) for r in want.fetchall())


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_secret_query(spark, sf_dir):
    want = texts(spark, sf_dir)
    rows = queries.op1_secret_scan(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        base = plain_spans(want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert set(base.split(",")) <= set(r.spans.split(","))


def test_a_ledger_is_read_again(spark, docs_of, tmp_path):
    rows = [(1, "token=abcdef01"), (2, "nothing"), (3, "token=abcdef01")]
    path = f"{tmp_path}/ledger"
    first = secrets.scan_with_ledger(docs_of(rows), path).collect()
    scanned = spark.read.parquet(path).count()
    again = secrets.scan_with_ledger(docs_of([*rows, (4, "secret: zyxwvu")]), path).collect()
    assert scanned == 2 and spark.read.parquet(path).count() == 3
    spans = {r.doc_id: r.spans for r in again}
    assert all(spans[r.doc_id] == r.spans for r in first) and len(spans[4]) == 1
    other = (*secrets.RULES, secrets.Rule("phrase", "nothing", 5))
    assert {r.doc_id: len(r.spans) for r in secrets.scan_with_ledger(docs_of(rows), path, other).collect()} == {1: 1, 2: 1, 3: 1}
    assert spark.read.parquet(path).count() == 5


def test_packing_query(spark, sf_dir):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(spark, sf_dir).items()}
    rows, places, seen = queries.op4_packing(spark, sf_dir).collect(), {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, whole in ((seen[i], len(ids[i])) for i in ids):
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == whole
    for pieces in places.values():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at <= 2048
    padding = sum(2048 - n for n in (sum(x for _, x in p) for p in places.values()) if n & (n - 1))
    assert padding <= 0.02 * sum(map(len, ids.values())) + 2048


def test_bpe_query(spark, sf_dir):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = texts(spark, sf_dir)
    for r in queries.op10_bpe(spark, sf_dir).collect():
        ids = tokenizer.encode(want[r.doc_id], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op2_quality", "op9_language"])
def test_held_out_rows_and_scores(spark, sf_dir, name):
    want = texts(spark, sf_dir)
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and math.isfinite(r.score)
