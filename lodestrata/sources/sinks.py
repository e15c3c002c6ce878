"""Writers: exports a line each, and collections with a manifest of digests that can be read back and verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def write_collection(cards: DataFrame, path: str, key: str = "actor") -> None:
    """One JSON document for each row, in folders by key, and a manifest of each document's digest."""
    rows = cards.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(cards[c] for c in sorted(cards.columns)))).alias("value"))
    rows.write.mode("error").parquet(f"{path}/cards")
    rows.select("key", F.sha2("value", 256).alias("digest")).write.mode("error").parquet(f"{path}/manifest")


def verify_collection(spark: SparkSession, path: str) -> DataFrame:
    """(key, problem) of each card that is missing, extra or altered; empty if all is well."""
    cards = spark.read.parquet(f"{path}/cards").select("key", F.sha2("value", 256).alias("digest"))
    manifest = spark.read.parquet(f"{path}/manifest")
    a = cards.groupBy("key", "digest").agg(F.count("*").alias("n"))
    b = manifest.groupBy("key", "digest").agg(F.count("*").alias("m"))
    both = a.join(b, ["key", "digest"], "full")
    problem = F.when(F.col("n").isNull(), "missing_or_altered").when(F.col("m").isNull(), "extra_or_altered").when(F.col("n") != F.col("m"), "count")
    return both.select("key", problem.alias("problem")).where("problem IS NOT NULL")
