"""Replay of an evidence bundle that the model makes of the crawled pages, with some of its parts tampered with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.surrogate import Frames
from ..sources import evidence

#: Sources of the bundle; the last one is left untouched.
SOURCES = 7


def links(body: Column) -> Column:
    """(oid, account) of each link of a page: its place in this body, and its target's first letter where that is one from a to m."""
    targets = F.regexp_extract_all(body.cast("string"), F.lit('href="/?([^"]*)"'), F.lit(1))
    letter = lambda x: F.lower(F.substring(x, 1, 1))
    return F.transform(targets, lambda x, i: F.struct(F.concat(F.md5(body), F.lit("#"), i.cast("string")).alias("oid"), F.when(letter(x).between("a", "m"), letter(x)).alias("account")))


def bundle(f: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages, sources and blobs: every seventh page is one of a source, and leads to the seventh after it."""
    rows = f.table("pages").select("page_id", "url", F.encode("html", "UTF-8").alias("body"))
    k, whole = F.col("page_id"), F.col("page_id") % SOURCES == SOURCES - 1
    after = rows.select((k - SOURCES).alias("page_id"), F.col("url").alias("next"))
    rows = rows.join(after, "page_id", "left").withColumn("items", links(F.col("body")))
    status = F.when(~whole & (k % 60 == 23), 500).otherwise(200)
    pages = rows.select(
        F.concat(F.lit("s"), (k % SOURCES).cast("string")).alias("source"),
        (F.floor(k / SOURCES) + 1).alias("number"),
        F.col("url").alias("request"),
        F.when(whole | (k % 60 != 17), F.col("next")).alias("next_request"),
        status.alias("http_status"),
        F.when(F.col("next").isNotNull(), F.concat(F.lit("<"), F.col("next"), F.lit('>; rel="next"'))).alias("link"),
        F.sha2("body", 256).alias("body_sha256"),
        (F.length("body") + F.when(~whole & (k % 50 == 7), 1).otherwise(0)).cast("long").alias("body_bytes"),
        F.size("items").cast("long").alias("item_count"),
    )
    altered = F.when(~whole & (k % 50 == 11), F.concat("body", F.lit(b"<!-- -->"))).otherwise(F.col("body"))
    blobs = rows.where(whole | (k % 50 != 13)).select(F.sha2("body", 256).alias("name"), altered.alias("body")).select("name", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("bytes"), "body")
    claims = rows.withColumn("ok", status == 200).groupBy(F.concat(F.lit("s"), (k % SOURCES).cast("string")).alias("source")).agg(
        F.min_by("url", "page_id").alias("first_request"),
        F.count("*").alias("pages"),
        F.sum(F.when(F.col("ok"), F.size("items")).otherwise(0)).cast("long").alias("item_count"),
        F.sum(F.when(F.col("ok"), F.size(F.filter("items", lambda i: i["account"].isNull()))).otherwise(0)).cast("long").alias("unlinked"),
        F.lit("complete").alias("coverage"),
    )
    return pages, claims, blobs


def replay_faults(f: Frames) -> DataFrame:
    """How often each fault is found in each source."""
    faults, _ = evidence.replay(*bundle(f), items_of=links)
    return faults.groupBy("source", "reason").agg(F.count("*").alias("n"), F.min("number").alias("first_page"))


def replay_verdicts(f: Frames) -> DataFrame:
    """What the replay says of each source."""
    return evidence.replay(*bundle(f), items_of=links)[1]


MEASURES = {"src26_replay_faults": replay_faults, "val13_replay": replay_verdicts}
