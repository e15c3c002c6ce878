"""Digests of sets: the same however the rows are dealt, and without a task that holds a whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits by which members are grouped, from the finest blocks to the whole set.
LEVELS = (6, 3, 0)


def set_digest(df: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """keys, members (distinct ones) and digest of the set of `member` texts of each key; null members are left out.

    A tree of sorted blocks: members are grouped by the first digits of their own digests, a
    block's digest is that of its members' in order, and so on to the root.
    """
    rows = df.select(*keys, F.sha2(member.cast("string"), 256).alias("d")).where("d IS NOT NULL").distinct()
    rows = rows.withColumn("place", F.col("d")).withColumn("n", F.lit(1).cast("long"))
    for digits in LEVELS:
        block = F.substring("place", 1, digits) if digits else F.lit("")
        parts = F.array_sort(F.collect_list(F.struct("place", "d")))  # 16 or fewer bits of places, but for the finest blocks
        rows = rows.groupBy(*keys, block.alias("block")).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["d"]), ","), 256).alias("d"), F.sum("n").alias("n"))
        rows = rows.withColumnRenamed("block", "place")
    return rows.select(*keys, F.col("n").alias("members"), F.col("d").alias("digest"))


def register_difference(registered: DataFrame, present: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys and kind (missing, extra, changed) of each file (keys, digest, bytes) that a register and what is there differ in.

    A file that one side has more than once counts as changed unless all its digests agree.
    Where a path isn't unique, `keys` has what tells its files apart. Null keys equal each other.
    """

    def one(df: DataFrame, side: str) -> DataFrame:
        same = (F.min("digest") == F.max("digest")) & (F.min("bytes") == F.max("bytes"))
        named = df.select(*(F.col(k).alias(f"{side}_{k}") for k in keys), "digest", "bytes")
        return named.groupBy(*(f"{side}_{k}" for k in keys)).agg(F.when(same, F.struct(F.min("digest").alias("digest"), F.min("bytes").alias("bytes"))).alias(side), F.lit(True).alias(f"in_{side}"))

    met = [F.col(f"left_{k}").eqNullSafe(F.col(f"right_{k}")) for k in keys]
    both = one(registered, "left").join(one(present, "right"), met, "full")
    equal = F.col("left").isNotNull() & (F.col("left") == F.col("right"))
    kind = F.when(F.col("in_right").isNull(), "missing").when(F.col("in_left").isNull(), "extra").when(~F.coalesce(equal, F.lit(False)), "changed")
    return both.select(*(F.coalesce(f"left_{k}", f"right_{k}").alias(k) for k in keys), kind.alias("kind")).where("kind IS NOT NULL")


def files_of(files: DataFrame) -> DataFrame:
    """path (the name within its folder), digest and bytes of `binaryFile` rows."""
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path"), F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("bytes"))
