import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ann


def exact(rows, every, k):
    """(query, rank, id, score) by all pairs, the cosine summed in order in double precision."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)

    def dots(a):
        s = np.zeros(len(v))
        for d in range(v.shape[1]):
            s = s + a[d] * v[:, d]
        return s

    norms = np.sqrt(np.array([dots(a)[n] for n, a in enumerate(v)]))
    out = []
    for n in np.flatnonzero(ids % every == 0):
        score = dots(v[n]) / (norms[n] * norms)
        order = [m for m in np.lexsort((ids, -score)) if m != n][:k]
        out += [(int(ids[n]), r + 1, int(ids[m]), float(score[m])) for r, m in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("noise", [1e-8, 1e-7, 1e-6, 1e-5, 1e-4])
def test_hundreds_of_near_copies(spark, monkeypatch, noise):
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "BLOCK", 8)
    monkeypatch.setattr(ann, "LEAF", 16)
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(i, np.float32(base + noise * rng.normal(size=16) if i < 600 else rng.normal(size=16)).tolist()) for i in range(800)]
    rows += [(1000 + i, np.float32(base * (i + 1)).tolist()) for i in range(60)]
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == exact(rows, 20, 5)
