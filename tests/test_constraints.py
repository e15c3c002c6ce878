"""Constraints on small tables with planted violations, and on those of the model."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.constraints import Rule, Subset, Total, Unique, check, off, violations, watched
from lodestrata.operators import claims
from lodestrata.plans.surrogate import Frames

PARTS = [("a", 1, 2), ("a", 2, 3), ("b", 1, 4), ("c", 1, None), (None, 1, 1)]
WHOLES = [("a", 5), ("b", 5), ("c", 0), ("d", 0), ("e", 1)]


@pytest.fixture
def rules(spark):
    return [
        Rule("small", "parts", F.col("n") > 3),
        Rule("known", "parts", F.col("k").isNull()),
        Unique("one_each", "parts", ("k",)),
        Subset("parts_have_whole", "parts", "wholes", ("k",)),
        Total("sums", "wholes", "parts", ("k",), "total", "n"),
    ]


@pytest.fixture
def tables(spark):
    return {"parts": spark.createDataFrame(PARTS, "k string, i int, n int"), "wholes": spark.createDataFrame(WHOLES, "k string, total long")}


def test_counts_and_rows(tables, rules):
    got = {r.constraint: r.violations for r in check(tables, rules).collect()}
    assert got == {"small": 1, "known": 1, "one_each": 1, "parts_have_whole": 1, "sums": 2}
    assert {r.k for r in violations(tables, rules[4]).collect()} == {"b", "e"}
    assert [(r.k, r.too_many) for r in violations(tables, rules[2]).collect()] == [("a", 1)]
    assert [r.n for r in violations(tables, rules[0]).collect()] == [4]


def test_plain_rules_are_counted_while_writing(tables, rules, tmp_path):
    df, seen = watched(tables["parts"], rules[:2])
    df.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"rows": 5, "small": 1, "known": 1}


def test_off(spark):
    rows = [(1.0, 1.0), (1.0, 1.1), (None, 1.0), (1.0, None), (None, None), (0.3, 0.1 + 0.2)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r[0] for r in df.select(off(F.col("a"), F.col("b"))).collect()] == [False, True, True, True, False, False]


def test_claims_without_planted_values_hold(spark, sf_dir):
    """The planted values are found, and nothing else."""
    got = {r.constraint: r.violations for r in claims.claim_violations(Frames(spark, sf_dir)).collect()}
    assert len(got) == len(claims.report_rules())
    for name in ("cards_are_unique", "hours_rate_fits", "record_in_window", "cochange_parts_fit", "per_day_fits", "role_share_withheld"):
        assert got[name] == 0
    for name in ("actors_sum_to_population", "selected_are_actors", "card_parts_add_up", "oid_has_forty_digits", "record_ids_are_unique", "cochange_rate_fits"):
        assert got[name] > 0
