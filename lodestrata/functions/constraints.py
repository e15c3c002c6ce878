"""Constraints over tables, compiled into one aggregation for each table; joins only where two tables meet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule if `broken` is true; null is no violation."""

    name: str
    table: str
    broken: Column


@dataclass(frozen=True)
class Unique:
    """Rows that repeat a key break it, the first of each excepted."""

    name: str
    table: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Subset:
    """Rows of `table` without a row of `within` that has the same keys break it."""

    name: str
    table: str
    within: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Total:
    """Rows of `table` whose `whole` isn't the sum of `part` over the rows of `parts` with the same keys break it; no row sums to zero."""

    name: str
    table: str
    parts: str
    keys: tuple[str, ...]
    whole: str
    part: str


def _counts(rules: list[Rule]) -> list[Column]:
    return [F.count("*").alias("rows"), *(F.count_if(F.coalesce(r.broken, F.lit(False))).alias(r.name) for r in rules)]


def violations(tables: dict[str, DataFrame], rule: Rule | Unique | Subset | Total) -> DataFrame:
    """The rows that break one constraint (of a repeated key: the key and how many rows are too many)."""
    df = tables[rule.table]
    if isinstance(rule, Rule):
        return df.where(F.coalesce(rule.broken, F.lit(False)))
    keys = list(rule.keys)
    if isinstance(rule, Unique):
        return df.groupBy(*keys).agg((F.count("*") - 1).alias("too_many")).where("too_many > 0")
    if isinstance(rule, Subset):
        return df.join(tables[rule.within].select(*keys).distinct(), keys, "left_anti")
    sums = tables[rule.parts].groupBy(*keys).agg(F.sum(rule.part).alias("_sum"))
    return df.join(sums, keys, "left").where(~F.col(rule.whole).eqNullSafe(F.coalesce("_sum", F.lit(0)))).drop("_sum")


def check(tables: dict[str, DataFrame], rules: list[Rule | Unique | Subset | Total]) -> DataFrame:
    """constraint, table and violations, a row for each constraint: all plain rules of a table are counted in one pass over it."""
    out = []
    for name, df in tables.items():
        if own := [r for r in rules if isinstance(r, Rule) and r.table == name]:
            one = df.agg(*_counts(own)).drop("rows")
            out.append(one.unpivot([], [r.name for r in own], "constraint", "violations").withColumn("table", F.lit(name)))
    for rule in rules:
        if not isinstance(rule, Rule):
            n = F.coalesce(F.sum("too_many"), F.lit(0)) if isinstance(rule, Unique) else F.count("*")
            out.append(violations(tables, rule).agg(n.alias("violations")).select(F.lit(rule.name).alias("constraint"), "violations", F.lit(rule.table).alias("table")))
    return reduce(DataFrame.unionByName, out)


def watched(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Observation]:
    """`df`, and an observation of its plain rules that is filled while the frame is written: rows and violations by rule, without a pass of their own."""
    seen = Observation()
    return df.observe(seen, *_counts(rules)), seen


def off(value: Column, expected: Column, within: float = 1e-12) -> Column:
    """Whether two numbers differ by more than rounding; one of them null is a difference."""
    return F.when(value.isNull() | expected.isNull(), value.isNull() != expected.isNull()).otherwise(F.abs(value - expected) > within)
