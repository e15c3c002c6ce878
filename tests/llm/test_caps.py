import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import caps, queries


def plain(rows, least=0.93):
    """(n_links, component, kept) by all pairs."""
    sound = {i: (k, np.array(v, float) / np.max(np.abs(v))) for i, v, k in rows if v is not None and k is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {i} for i, _, _ in rows}
    for i, (k, a) in sound.items():
        for j, (m, b) in sound.items():
            if i < j and k == m and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links[i].add(j)
                links[j].add(i)
    low = {i: i for i in links}
    while True:
        new = {i: min(low[j] for j in near) for i, near in links.items()}
        if new == low:
            return {i: (len(near) - 1, low[i], low[i] == i) for i, near in links.items()}
        low = new


def found(spark, tmp_path, rows):
    full = [(*r, 1, 2.0, "x") for r in rows]
    spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, n long, u double, f string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_near_vectors(spark, str(tmp_path)).collect()
    assert len({r.vec_id for r in got}) == len(got)
    return {r.vec_id: tuple(r[1:]) for r in got}


def groups(seed, count, size, spread, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count, dims)) / np.sqrt(dims)
    return [(c * size + k, (centres[c] + spread * rng.normal(size=dims) / np.sqrt(dims)).tolist(), c % 3) for c in range(count) for k in range(size)]


@pytest.mark.parametrize("spread", [0.05, 0.18])
def test_groups(spark, tmp_path, spread, monkeypatch):
    monkeypatch.setattr(caps, "CHUNK", 40)
    rows = groups(3, 6, 70, spread) + [(9000 + i, v, k) for i, v, k in groups(4, 60, 1, 0)]
    got, want = found(spark, tmp_path, rows), plain(rows)
    assert got.keys() == want.keys()
    if spread == 0.05:
        assert got == want
    else:  # many pairs right at the threshold: nothing but links, and nearly all of them
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_odd_rows(spark, tmp_path):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same, 1) for i in range(50)] + [(100, same, 2), (101, [2.0, 4.0, 0.0], 2), (102, same, None), (103, None, 1), (104, [0.0, 0.0, 0.0], 1), (105, [1.0, None, 0.0], 1), (106, [float("nan"), 1.0, 1.0], 1), (107, [float("inf"), 1.0, 1.0], 1)]
    rows += [(108, [], 1), (109, [1.0, 2.0], 1), (110, [3.0], 1), (111, [5.0], 1), (112, [-5.0], 1), (113, [1e200, 2e200, 0.0], 1), (114, [1.0, 2.0, 0.4], 1), (115, None, None)]
    assert found(spark, tmp_path / "odd", rows) == plain(rows)
    assert found(spark, tmp_path / "none", []) == {}
    assert found(spark, tmp_path / "one", [(7, same, 1)]) == {7: (0, 7, True)}


def test_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in caps.near_copies(df, F.col("label")).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_pairs_at_the_threshold_share_a_filter():
    for dims, entries in ((64, 40), (64, 120), (16, 64)):
        made = caps.filters(dims, entries, 0.93)
        rng = np.random.default_rng(9)
        a = rng.normal(size=(600, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=a.shape)
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(made.decode(a), made.decode(b))]
        assert np.mean(shared) >= 0.98


def test_decoding_lists_all_filters():
    made = caps.filters(12, 32, 0.93)
    units = caps._units(np.random.default_rng(2).normal(size=(40, 12)))
    for row, got in zip(units, made.decode(units)):
        every = []
        for turn in range(caps.ROTATIONS):
            turned = row @ made.spins[turn]
            every += [np.concatenate([x, y]) @ turned for x in made.books[turn][0] for y in made.books[turn][1]]
        level = min(made.level, sorted(every)[-caps.LEAST_FILTERS])
        assert got.tolist() == np.nonzero(np.array(every) >= level - 1e-12)[0].tolist()


def test_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {r.vec_id: tuple(r[1:]) for r in queries.op13_near_vectors(spark, sf_dir).collect()} == plain(rows)
