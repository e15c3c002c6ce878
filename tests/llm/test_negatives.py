import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import negatives, queries


def plain(rows):
    """The contract by all products, in Python integers."""
    sound = {}
    for i, v, k in rows:
        if i is None or not v or k is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound[i] = ((k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) for x in v])
    out = []
    for a, (kind, v) in sound.items():
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for j, (m, w) in sound.items() if j != a and len(w) == len(v)]
        scored.sort()
        for p, i, _ in [s for s in scored if s[2] == kind][:5]:
            fit = [s for s in scored if s[2] != kind and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(fit)]
    return sorted(out)


def found(spark, tmp_path, rows, kind="float"):
    full = [(*r, 1, 2, "x") for r in rows]
    spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, label int, rank int, slab int, found string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in queries.op12_hard_negatives(spark, str(tmp_path)).collect())


def drawn(seed, n, dims=16, groups=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) / np.sqrt(dims)
    vectors = np.float32(centres[rng.integers(groups, size=n)] + 0.5 * rng.normal(size=(n, dims)) / np.sqrt(dims))
    return [(i * 5, v.tolist(), int(k)) for i, v, k in zip(range(n), vectors, rng.integers(10, size=n))]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SHARD", 300), ("BLOCK", 8), ("STRIDE", 32), ("MEMBERS", 10)):
        monkeypatch.setattr(negatives, name, value)


def test_clusters_and_shards(spark, tmp_path, small):
    rows = drawn(1, 1500)
    want = plain(rows)
    assert found(spark, tmp_path, rows) == want and len(want) > 2000


def test_ties_and_copies(spark, tmp_path, small):
    rows = [(i, [0.5, 0.25, 0.0] if i % 3 else [0.25, 0.25, 0.25], i % 4) for i in range(700)] + [(1000 + i, [0.0, 0.0, 0.0], i % 10) for i in range(200)]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_odd_rows(spark, tmp_path):
    v = [0.5, 0.5]
    rows = [(0, v, 1), (1, v, 1), (2, [0.4, 0.4], 2), (3, None, 2), (4, v, None), (5, [0.5, None], 2), (6, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (9, [], 2), (100, [], 1), (10, [0.3], 2), (None, v, 1), (200, [-0.5, -0.5], 3), (11, [0.5, 0.5], 3), (12, [0.35, 0.35], 4)]
    assert found(spark, tmp_path / "odd", rows) == plain(rows)
    assert found(spark, tmp_path / "none", []) == []
    assert found(spark, tmp_path / "one", [(0, v, 1)]) == []


def test_large_components(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i * 20, (rng.normal(size=4) * 10 ** (i % 5 + 1)).tolist(), i % 3) for i in range(150)]
    assert found(spark, tmp_path / "some", rows, "double") == plain(rows)
    rows = [(i * 20, (rng.normal(size=4) * 3e5).tolist(), i % 3) for i in range(60)]
    assert found(spark, tmp_path / "large", rows, "double") == plain(rows)  # beyond the exact doubles
    assert found(spark, tmp_path / "beyond", [(0, [1e300, 1.0], 1), (1, [1e300, 1.0], 1), (2, [7e299, 0.0], 2), (3, [1e308, 0.0], 2)], "double") is not None


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(0, [0.5], 1), (0, [0.5], 1), (1, [0.5], 1), (2, [0.3], 2), (2, [0.3], 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") == 0, F.col("label")).collect()] == [(0, 1, 1, 2, 128 * 128, 128 * 76)]


def test_walks_end_early():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    items = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(400, 16)) for c in centres]))
    shared = negatives.SharedList(items[:3], items)
    looked = []
    found = shared.walk(np.arange(3), [-np.inf] * 3, [np.inf] * 3, 5, lambda who, at: looked.append(len(at)) or np.ones((len(who), len(at)), bool))
    assert sum(looked) < len(items) / 4
    scores = items[:3] @ items.T
    assert [[s for s, _ in hits] for hits in found] == [sorted(row.astype(int).tolist(), reverse=True)[:5] for row in scores]


def test_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, sf_dir).collect()) == plain(rows)
