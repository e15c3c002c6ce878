from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab's \n\t \x1c<|endoftext|>")), max_size=30), max_size=4))
def test_units_give_the_librarys_ids(texts):
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in packing.load(PATH).encode_batch(texts)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60))
def test_windows(sizes):
    packer = packing.Packer(32)
    docs = [np.arange(n, dtype=np.uint32) for n in sizes]
    pieces = [p for d, ids in enumerate(docs) for p in packer.add(d, ids)] + list(packer.close())
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, number, offset in pieces:
        assert total == sizes[doc] and len(ids)
        by_doc[doc].append((start, ids.tolist()))
        by_window[number].append((offset, len(ids)))
    assert [[x for _, ids in sorted(by_doc[d]) for x in ids] for d in range(len(docs))] == [d.tolist() for d in docs]
    for own in by_window.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 32 and (at == 32 or at & (at - 1) == 0)


def test_level_minimises_the_sum_of_squares():
    packer, rng = packing.Packer(16), np.random.default_rng(1)
    for size in rng.integers(1, 16, 200).tolist():
        counts = packer.levels.copy()

        def after(level):
            new = counts.copy()
            new[level] -= level > 0
            new[level + size] += level + size < 16
            return int((new[1:16] ** 2).sum())

        level = packer.level_for(size)
        assert after(level) == min(after(h) for h in range(17 - size) if h == 0 or counts[h])
        list(packer.add(0, np.zeros(size, np.uint32)))
        assert packer.levels[16] == 0 and all(len(packer.open[h]) == packer.levels[h] for h in range(1, 16))


def test_rows(docs_of):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "word " * 5000), (4, "x" * 9000), (1, "a b"), (5, "  two  spaces \n\n end ")]
    got = packing.pack(docs_of(rows), PATH).collect()
    want = sorted(len(e.ids) + 1 for e in library().encode_batch([t or "" for _, t in rows], add_special_tokens=False))
    assert sum(r.length for r in got) == sum(want)
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(want)
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(docs_of([]), PATH).count() == 0
