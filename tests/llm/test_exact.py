import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestrata.llm import exact


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 6))
def test_filters_keep_everything(values, bits):
    fps = np.array(sorted(values), np.uint64)
    blocks = (fps >> np.uint64(64 - bits)).astype(int) if bits else np.zeros(len(fps), int)
    for b in set(blocks.tolist()):
        own = fps[blocks == b]
        counts = np.arange(1, len(own) + 1)
        got, n = exact.filter_entries(b, bits, *exact.filter_block(own, counts, bits))
        assert got.tolist() == own.tolist() and n.tolist() == counts.tolist()


def test_repeated_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_ENTRIES", 20)
    values = [(x * 0x9E3779B97F4A7C15 % 2**64) - 2**63 for x in [*range(200), *range(0, 200, 3), *range(0, 200, 7), 5, 5]]
    rows = spark.createDataFrame([(v,) for v in values], "fp long").repartition(5)
    want = {v: n for v, n in Counter(values).items() if n > 1}
    assert {r.fp: r.n for r in exact.repeated_fingerprints(rows, len(values)).collect()} == want


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in exact.SPACES)
        groups[norm].append((-len(t or ""), i is None, i or 0))
    out = Counter()
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in exact.SPACES)
        out[i, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out, {k: min(v) for k, v in groups.items()}


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb\n "), (5, None), (6, ""), (7, " \r\x0b\x0c"), (8, "a b"), (None, "ab"), (9, "x" * 50_000), (10, "x" * 50_000), (2, "ab"), (11, "é"), (12, "c")]


@pytest.mark.parametrize("bound", [1 << 18, 0])
def test_rows(docs_of, monkeypatch, bound):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", bound)
    got = exact.exact_copies(docs_of(ROWS)).collect()
    want, keepers = plain(ROWS)
    assert Counter((r.doc_id, r.group_size, r.text_sha256) for r in got) == want
    assert sorted((r.keep_id for r in got if r.kept), key=str) == sorted((None if none else i for _, none, i in keepers.values()), key=str)
    assert {r.keep_id for r in got if r.doc_id == 2} == {4} and {r.keep_id for r in got if r.doc_id == 6} == {7}


def test_no_rows(docs_of):
    assert exact.exact_copies(docs_of([])).count() == 0
