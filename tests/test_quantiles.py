"""Quantiles by counted ranges against the standard library."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import quantiles


def linear(values, p):
    at = (len(values) - 1) * p
    low, high = math.floor(at), math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize(("cuts", "levels"), [(4, 1), (3, 3), (4096, 1)])
def test_all_methods(spark, monkeypatch, cuts, levels):
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    monkeypatch.setattr(quantiles, "LEVELS", levels)
    rng = random.Random(7)
    groups = {"one": [3.5], "two": [2.0, -1.0], "same": [4.25] * 50, "ties": [rng.randrange(4) / 2 for _ in range(301)], "tail": [10 ** rng.uniform(-9, 12) for _ in range(200)], "signs": [rng.uniform(-1e6, 1e6) for _ in range(100)], "near": [1e9 + rng.randrange(50) * 1e-6 for _ in range(80)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    wanted = {"median": quantiles.linear(0.5), "p90": quantiles.linear(0.9), "low": quantiles.linear(0.0), "high": quantiles.linear(1.0), "q1": quantiles.exclusive(0.25), "q3": quantiles.exclusive(0.75), "upper": quantiles.upper_middle(), "nearest": quantiles.at_or_below(0.5)}
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in quantiles.quantiles(df, ["k"], F.col("v"), wanted).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        v, r = sorted(values), got[k]
        want = {"median": statistics.median(v), "p90": linear(v, 0.9), "low": v[0], "high": v[-1], "upper": v[len(v) // 2], "nearest": v[(len(v) - 1) // 2]}
        if len(v) > 1:
            q = statistics.quantiles(v, n=4)
            want |= {"q1": q[0], "q3": q[2]}
        assert r.n == len(v)
        for name, x in want.items():
            assert r[name] == pytest.approx(x, rel=1e-12, abs=1e-12), (k, name)


def test_no_keys_and_no_rows(spark):
    df = spark.range(1, 102).selectExpr("id * 1.0 as v")
    assert [tuple(r) for r in quantiles.quantiles(df, [], F.col("v"), {"m": quantiles.linear(0.5)}).collect()] == [(101, 51.0)]
    assert quantiles.quantiles(df.where("v < 0"), [], F.col("v"), {"m": quantiles.linear(0.5)}).collect() == []
