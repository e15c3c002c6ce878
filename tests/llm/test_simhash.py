import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lodestrata.llm import simhash


def plain_print(text, words):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if (a ^ b).bit_count() <= most:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {p: find(p) for p in root}


TEXTS = ["", None, "One", "one two", "A b C d", "a b c d", "é Ü x y z", "a b c d e", "w " * 20_000, "a b c\td\x0be\n"]


def test_fingerprints(docs_of):
    got = {r.doc_id: r.w0 for r in simhash.fingerprints(docs_of(list(enumerate(TEXTS))), 3).collect()}
    assert {i: w % 2**64 for i, w in got.items()} == {i: plain_print(t, 3) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("bucket", [64, 3, 1])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    seeds = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = set()
    for s in seeds.tolist():
        walk = s
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                walk ^= 1 << b
            prints.add(walk)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "w0 long"))
    pairs = [(r.a % 2**64, r.b % 2**64) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    roots = {r.node % 2**64: r.root for r in simhash.components(found).collect()}
    want = plain_components(prints)
    for a, b in combinations(prints, 2):
        assert (want[a] == want[b]) == (a in roots and b in roots and roots[a] == roots[b])


def test_components_of_documents(docs_of):
    rows = [*enumerate(TEXTS), (20, "A b C d"), (None, "a b c d"), (4, "A b C d")]
    got = [(r.doc_id, r.w0 % 2**64, r.component_id) for r in simhash.near_components(docs_of(rows)).collect()]
    want = plain_components({plain_print(t, 3) for _, t in rows})
    least = {}
    for i, t in rows:
        if i is not None:
            c = want[plain_print(t, 3)]
            least[c] = min(i, least.get(c, i))
    assert sorted(got, key=str) == sorted(((i, plain_print(t, 3), least[want[plain_print(t, 3)]]) for i, t in rows), key=str)
    assert simhash.near_components(docs_of([])).count() == 0


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_groups(docs_of, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    rows, family = [], {}
    for k in range(12):
        base = words(rng, 300)
        for c in range(4):
            copy = list(base)
            for at in rng.integers(0, 300, 2 * c).tolist():  # six words of 300 at most: a similarity of 0.8 or more
                copy[at] = "changed"
            family[len(rows)] = k
            rows.append((len(rows), " ".join(copy)))
    for _ in range(30):
        family[len(rows)] = -len(rows)
        rows.append((len(rows), " ".join(words(rng, 200))))
    rows += [(None, None), (900, ""), (901, rows[0][1]), (0, rows[0][1])]
    kept = simhash.one_of_each_group(docs_of(rows)).collect()
    ids = [r.doc_id for r in kept]
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "spans", "h", "key"}
    assert sorted(i for i in ids if family.get(i, 0) < 0) == sorted(i for i in family if family[i] < 0)
    assert [i for i in ids if i in (None, 900, 901)] == [900]
    assert sum(1 for i in ids if family.get(i, -1) >= 0) <= 13 and {family[i] for i in ids if family.get(i, -1) >= 0} == set(range(12))
    assert simhash.one_of_each_group(docs_of([])).count() == 0
