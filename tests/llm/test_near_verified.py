import numpy as np

from lodestrata.llm import simhash


def kept(docs_of, rows):
    return {r.doc_id for r in simhash.one_of_each_group(docs_of(rows)).collect()}


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_only_pairs_at_the_threshold_go(docs_of):
    rng = np.random.default_rng(3)
    rows, pairs = [], []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        other = list(base)
        for at in rng.choice(80, 8 + k % 4, replace=False).tolist():  # 0.74 to 0.83
            other[5 * at + 2] = f"new{k}x{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs.append((2 * k + 1, jaccard(rows[-2][1], rows[-1][1])))
    got = kept(docs_of, rows)
    assert any(s < 0.8 for _, s in pairs) and any(s >= 0.8 for _, s in pairs)
    assert not [p for p in pairs if p[1] < 0.8 and p[0] not in got]
    assert not [2 * k for k in range(60) if 2 * k not in got]
    found = [p for p in pairs if p[1] >= 0.8]
    assert sum(i not in got for i, _ in found) >= 0.9 * len(found)


def test_filler_does_not_make_texts_alike(docs_of):
    """The repeated shingle would decide every bit if shingles counted with their repeats."""
    rng = np.random.default_rng(5)
    rows = [(i, "ha " * 300 + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 120))) for i in range(4)]
    assert kept(docs_of, rows) == {0, 1, 2, 3}
