"""Exact quantiles of many groups at once, by counted ranges of values.

A group's values are counted by ranges; only the range that holds a wanted rank is looked
at again, in finer ranges, and at last by its distinct values. So no task holds a group's
values, and neither sorting nor a map of a group is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Ranges that a range is cut into, finer towards its low end, as gaps and counts lie; and how often.
CUTS, LEVELS = 4096, 1

# How a quantile is taken from the sorted values v[0] ... v[n - 1]: ranks and the weight of the second.


def linear(p: float):
    """Between the two values at (n - 1) * p."""
    at = (F.col("n") - 1) * F.lit(p)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def exclusive(p: float):
    """Between the two values at (n + 1) * p, counted from one; a single value stands for itself."""
    at = (F.col("n") + 1) * F.lit(p)
    low = F.greatest(F.lit(1), F.least(F.floor(at), F.col("n") - 1))
    return F.greatest(low - 1, F.lit(0)), F.least(low, F.col("n") - 1), at - low


def at_or_below(p: float):
    """The value at the rank (n - 1) * p, cut down."""
    low = F.floor((F.col("n") - 1) * F.lit(p))
    return low, low, F.lit(0.0)


def upper_middle():
    """The value at n // 2."""
    low = F.floor(F.col("n") / 2)
    return low, low, F.lit(0.0)


def _holds(low: Column, high: Column) -> Column:
    """The wanted ranks from `low` up to `high`, that one left out."""
    return F.filter("ranks", lambda r: (low <= r) & (r < high))


def order_statistics(cells: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, v) of `ranks` (from 0) in the sorted values; `cells` has (keys, v, c) for each distinct value, `groups` (keys, lo, hi, ranks)."""
    rows = cells.withColumn("g", F.lit(0).cast("long"))
    ranges = groups.select(*keys, F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("before"), "lo", "hi", "ranks")
    for _ in range(LEVELS):
        place = F.log1p(F.col("v") - F.col("lo")) / F.log1p(F.col("hi") - F.col("lo"))
        cut = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(place * CUTS), F.lit(CUTS - 1))).otherwise(0)
        rows = rows.join(ranges, [*keys, "g"]).withColumn("within", F.col("g")).withColumn("g", F.col("g") * CUTS + cut)
        counts = rows.groupBy(*keys, "within", "g").agg(F.sum("c").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("before").alias("start"), F.first("ranks").alias("ranks"))
        before = F.col("start") + F.coalesce(F.sum("size").over(Window.partitionBy(*keys, "within").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before).withColumn("ranks", _holds(F.col("before"), F.col("before") + F.col("size")))
        ranges = counts.where(F.size("ranks") > 0).select(*keys, "g", "before", "lo", "hi", "ranks")
        rows = rows.select(*keys, "g", "v", "c")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.join(ranges, [*keys, "g"]).withColumn("upto", upto)
    return last.select(*keys, "v", F.explode(_holds(F.col("upto") - F.col("c"), F.col("upto"))).alias("rank"))


def quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """keys, n (values that aren't null) and each wanted quantile of `value`, a finite number, for each group that has one; keys must not be null."""
    own = keys or ["_all"]
    rows = df.select(*keys, value.cast("double").alias("v")) if keys else df.select(F.lit(0).alias("_all"), value.cast("double").alias("v"))
    cells = staged(rows.where("v IS NOT NULL").groupBy(*own, "v").agg(F.count("*").alias("c")), "cells")
    ranks = F.array_distinct(F.array(*(r.cast("long") for low, high, _ in wanted.values() for r in (low, high))))
    whole = cells.groupBy(*own).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("ranks", ranks)
    found = order_statistics(cells, whole, own)
    # a few ranks for each group, and its count comes with them
    tables = found.join(whole.select(*own, "n"), own).groupBy(*own, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def of(low: Column, high: Column, weight: Column) -> Column:
        x, y = F.col("at")[low.cast("long")], F.col("at")[high.cast("long")]
        return F.when(x == y, x).otherwise((1 - weight) * x + weight * y)

    return tables.select(*keys, "n", *(of(*w).alias(name) for name, w in wanted.items()))
