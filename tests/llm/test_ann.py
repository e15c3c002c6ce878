import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ann


def plain(rows, every, k):
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in sound.items():
        if q % every == 0:
            near = sorted((-round(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), 12), i) for i, b in sound.items() if i != q and len(b) == len(a))
            out += [(q, n + 1, i) for n, (_, i) in enumerate(near[:k])]
    return sorted(out)


def clustered(n, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, (centres[i % 6] + 0.3 * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 100)
    monkeypatch.setattr(ann, "BLOCK", 4)
    monkeypatch.setattr(ann, "LEAF", 8)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(3)


def found(df, every, k=5, factor=1.0):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % every == 0, k, factor).collect())


def test_factor_one_is_exact(spark, small):
    rows = [(i, np.float32(v).tolist()) for i, v in clustered(400)]
    assert found(frame(spark, rows), 10) == plain(rows, 10, 5)


def test_a_larger_factor_keeps_most(spark, small):
    rows = clustered(400)
    want, got = set(plain(rows, 10, 5)), found(frame(spark, rows), 10, factor=1.5)
    assert len({(q, v) for q, _, v in got} & {(q, v) for q, _, v in want}) >= 0.9 * len(want)


def test_odd_rows(spark, small):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(300)] + [(500, None), (510, [0.0, 0.0, 0.0]), (520, [1.0, None, 1.0]), (530, [float("nan"), 1.0, 1.0]), (540, [float("inf"), 1.0, 1.0]), (550, []), (560, [1.0, 0.0]), (570, [2.0, 4.0, 0.0]), (None, same), (580, [0.0, 0.0, 1.0])]
    assert found(frame(spark, rows), 10) == plain(rows, 10, 5)
    assert found(frame(spark, [(0, same), (0, same), (1, [0.5, 0.5, 0.5])]), 10) == [(0, 1, 1)]
    assert found(frame(spark, [(1, same)]), 10) == [] and found(frame(spark, []), 10) == []


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 50) == plain(rows, 50, 5)
