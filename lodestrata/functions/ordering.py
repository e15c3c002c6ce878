"""The previous row of an order, without one task for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], bucket: Column, order: list[str], values: dict[str, str]) -> DataFrame:
    """df with columns `values[c]`: column c of the row before, by `order` within `keys`.

    `bucket` is a non-decreasing function of the order (a month, a day). Rows are compared
    within (keys, bucket); the first of a bucket takes the last of the bucket before, which
    comes from a table of one row for each bucket. So a key with a large part of all rows
    is spread over its buckets.
    """
    names = list(values)
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_last"))
    before = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    numbered = rows.select("*", F.row_number().over(inside).alias("_n"), F.lag(F.struct(*names)).over(inside).alias("_own"))
    joined = numbered.join(before, [*keys, "_bucket"])
    previous = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_own"))
    out = joined.select(*df.columns, previous.alias("_previous"))
    return out.select(*df.columns, *(F.col("_previous")[c].alias(new) for c, new in values.items()))


def running_max(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the largest `value` of the rows up to and with this one; buckets as in with_previous."""
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = rows.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_top"))
    before = tops.select(*keys, "_bucket", F.max("_top").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    joined = rows.withColumn("_inside", F.max("_value").over(inside)).join(before, [*keys, "_bucket"])
    return joined.select(*df.columns, F.greatest("_inside", "_before").alias(name))


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the rows up to and with this one; buckets as in with_previous."""
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    joined = rows.withColumn("_inside", F.sum("_value").over(inside)).join(before, [*keys, "_bucket"])
    return joined.select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, bucket: Column, value: str) -> DataFrame:
    """`left` with `value` of the last row of `right` at or before its `order` within `keys`; null if there is none.

    Both sides have `order`; buckets as in with_previous: the last value of each bucket is
    carried over to the next ones, so that a key is never sorted as a whole.
    """
    rest = [c for c in left.columns if c not in (*keys, order)]
    both = right.select(*keys, order, F.lit(0).alias("_side"), F.col(value).alias("_value"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest))
    both = both.unionByName(left.select(*keys, order, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), *rest)).withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = both.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col(order))).alias("_last"))
    before = lasts.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    found = both.withColumn("_own", F.last("_value", ignorenulls=True).over(inside)).where("_side = 1").join(before, [*keys, "_bucket"])
    return found.select(*left.columns, F.coalesce("_own", "_carried").alias(value))
