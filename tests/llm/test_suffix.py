from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import suffix

LENGTH, GRAM = 24, 6


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((len(r), sum(mark), runs, bytes(x for x, m in zip(r, mark) if not m)))
    return out


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=30))
def test_orders(strings):
    for order in (suffix.deep_shallow_order(strings, 0, 2), suffix.deep_shallow_order(strings, 0, 0), suffix.deep_shallow_order(strings)):
        assert sorted(order) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)


piece = st.one_of(st.sampled_from(["abcabcbacbbacabcab", "bbbbbbbbbbbb", "cabbacbbcaabcbacbacbacbbabacabcab"]), st.text("abc", max_size=20), st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 30)).map(lambda t: t[0] * t[1]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(piece, max_size=5).map("".join), min_size=1, max_size=6, unique=True))
def test_matching(texts):
    groups, marks = defaultdict(set), [bytearray(len(t)) for t in texts]
    for k, t in enumerate(texts):
        raw = t.encode()
        if len(raw) < LENGTH:
            continue
        places, hashes, spans = suffix.anchors(np.frombuffer(raw, np.uint8), LENGTH, GRAM)
        for a, b in spans:
            marks[k][a:b] = b"\1" * (b - a)
        for p, h in zip(places.tolist(), hashes.tolist()):
            groups[h].add((k, p, raw[max(0, p - LENGTH + GRAM) : p][::-1], raw[p : p + LENGTH]))
    for rows in groups.values():
        for k, a, b in suffix.match_group(rows, LENGTH, GRAM):
            marks[k][a:b] = b"\1" * (b - a)
    assert [sum(m) for m in marks] == [n for _, n, _, _ in plain(texts, LENGTH)]


RNG = np.random.default_rng(2)
PASSAGE = "".join(RNG.choice(list("abcdefgh "), 90))
TEXTS = ["", None, "é" * 5, PASSAGE, "x" + PASSAGE + "y", PASSAGE[10:60] + "z", "ab" * 40, "ab" * 40 + "c", "q" * 23, "q" * 24, "q" * 25, "ß" + PASSAGE[:30] + "ü" * 20, "".join(RNG.choice(list("abcdefgh "), 200))]


@pytest.mark.parametrize("crowd", [1 << 17, 1])
@pytest.mark.parametrize("bound", [1 << 17, 0])
def test_rows(docs_of, monkeypatch, crowd, bound):
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", bound)
    texts = [*TEXTS, PASSAGE, TEXTS[4]]
    rows = [*enumerate(texts), (None, TEXTS[-1]), (3, PASSAGE)]
    got = suffix.without_repeats(docs_of(rows), LENGTH, GRAM, crowd).collect()
    want = Counter(zip((i for i, _ in rows), plain([t for _, t in rows], LENGTH)))
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == want


def test_no_rows(docs_of):
    assert suffix.without_repeats(docs_of([])).count() == 0


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(documents).collect()}
    assert got == dict(zip((r.doc_id for r in rows), plain([r.text for r in rows], suffix.LENGTH)))
