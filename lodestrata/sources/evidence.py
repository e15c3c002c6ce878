"""Evidence bundles: pages of an interface as they were fetched, kept by the digest of their bodies, replayed without a network.

A folder holds `pages.jsonl` (a record for each request), `sources.jsonl` (what the bundle
claims of each source) and `blobs/sha256/<digest>`, the bodies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "source string, number long, request string, next_request string, http_status int, link string, body_sha256 string, body_bytes long, item_count long"
SOURCES = "source string, first_request string, pages long, item_count long, unlinked long, coverage string"
#: Faults of a source, the first that is found gives its reason.
REASONS = (
    "page_number_mismatch", "request_chain_mismatch", "body_missing", "body_digest_mismatch", "body_bytes_mismatch", "http_status_invalid",
    "http_retry_semantics_mismatch", "item_count_mismatch", "page_next_request_mismatch", "request_chain_terminated_early", "source_undeclared",
    "unlinked_mismatch", "duplicate_oids", "account_conflicts", "pagination_mismatch",
)


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages, sources and blobs (name, digest, bytes, body) of a bundle; digests are computed from the bodies, not read."""
    pages, sources = spark.read.schema(PAGES).json(f"{folder}/pages.jsonl"), spark.read.schema(SOURCES).json(f"{folder}/sources.jsonl")
    files = spark.read.format("binaryFile").load(f"{folder}/blobs/sha256")
    blobs = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("bytes"), F.col("content").alias("body"))
    return pages, sources, blobs


def commit_items(body: Column) -> Column:
    """(oid, account) of each commit in a body, a JSON list as forges send it; null if it is none."""
    rows = F.from_json(body.cast("string"), "array<struct<sha: string, author: struct<login: string>>>", {"mode": "PERMISSIVE"})
    return F.transform(rows, lambda r: F.struct(r["sha"].alias("oid"), r["author"]["login"].alias("account")))


def next_link(link: Column) -> Column:
    """The address that a Link header calls the next one, or null."""
    return F.nullif(F.regexp_extract(link, r'<([^>]*)>\s*;\s*rel="?next"?', 1), F.lit(""))


def replay(pages: DataFrame, sources: DataFrame, blobs: DataFrame, items_of: Callable[[Column], Column] = commit_items) -> tuple[DataFrame, DataFrame]:
    """(faults, verdicts): source, number and reason of every fault, and a row for each source.

    A page must follow from the one before: its number by one, its request as that one's
    next. So each page meets its predecessor by an equality join on (source, number), and
    no source is sorted. Bodies meet pages by digest, and what is in them is counted anew;
    the coverage of a source comes from its last page, never from the bundle's claim.
    """
    before = pages.groupBy("source", (F.col("number") + 1).alias("number")).agg(F.first("next_request").alias("led"), F.lit(True).alias("has_before"))
    ends = pages.groupBy("source").agg(F.max("number").alias("last"), F.count("*").alias("n"), F.min("number").alias("first"), F.countDistinct("number").alias("numbers"))
    rows = pages.join(before, ["source", "number"], "left").join(ends, "source").join(sources.select("source", "first_request"), "source", "left")
    held = blobs.groupBy(F.col("name").alias("body_sha256")).agg(F.first("digest").alias("digest"), F.first("bytes").alias("bytes"), F.first("body").alias("body"))
    rows = rows.join(held, "body_sha256", "left").withColumn("items", items_of(F.col("body")))
    ok, c = F.col("http_status") == 200, F.col
    seen, there = F.size(F.coalesce("items", F.array().cast(rows.schema["items"].dataType))), c("digest").isNotNull()
    expected = F.when(c("number") == 1, c("first_request")).otherwise(c("led"))
    broken = {
        "page_number_mismatch": (c("number") < 1) | ((c("number") > 1) & c("has_before").isNull()) | (c("numbers") != c("n")),
        "request_chain_mismatch": ~c("request").eqNullSafe(expected) & ((c("number") == 1) | c("has_before")),
        "body_missing": ~there,
        "body_digest_mismatch": there & (c("digest") != c("body_sha256")),
        "body_bytes_mismatch": there & ~c("bytes").eqNullSafe(c("body_bytes")),
        "http_status_invalid": c("http_status").isNull() | ~c("http_status").between(100, 599),
        "http_retry_semantics_mismatch": ~ok & ((c("item_count") != 0) | ~c("next_request").eqNullSafe(c("request"))),
        "item_count_mismatch": ok & there & ~c("item_count").eqNullSafe(seen.cast("long")),
        "page_next_request_mismatch": ok & ~c("next_request").eqNullSafe(next_link(c("link"))),
        "request_chain_terminated_early": c("next_request").isNull() & (c("number") < c("last")),
        "source_undeclared": c("first_request").isNull(),
    }
    page_faults = rows.select("source", "number", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in broken.items())))).alias("reason"))

    each = rows.where(ok).select("source", F.explode("items").alias("i")).select("source", "i.*")
    oids = each.groupBy("source", "oid").agg(F.count("*").alias("times"), F.min("account").alias("low"), F.max("account").alias("high"), F.count_if(c("account").isNull()).alias("unlinked"))
    counted = oids.groupBy("source").agg(F.count("*").alias("oids"), F.sum("times").alias("items"), F.count_if(c("times") > 1).alias("duplicates"), F.count_if(c("low") != c("high")).alias("conflicts"), F.sum("unlinked").alias("unlinked_seen"))
    last = rows.where(c("number") == c("last")).groupBy("source").agg(F.max("next_request").alias("cursor"))
    good = rows.groupBy("source").agg(F.count_if(ok).alias("good"))
    zero = F.lit(0).cast("long")
    whole = sources.join(ends, "source", "left").join(counted, "source", "left").join(last, "source", "left").join(good, "source", "left")
    told = F.when(c("n").isNull(), "unavailable").when(c("cursor").isNull(), "complete").when(c("good") > 0, "partial").otherwise("unavailable")
    whole = whole.select("source", "pages", "item_count", "unlinked", "coverage", told.alias("derived"), *(F.coalesce(x, zero).alias(x) for x in ("n", "oids", "items", "duplicates", "conflicts", "unlinked_seen")))
    claims = {
        "unlinked_mismatch": ~c("unlinked").eqNullSafe(c("unlinked_seen")),
        "duplicate_oids": c("duplicates") > 0,
        "account_conflicts": c("conflicts") > 0,
        "pagination_mismatch": ~c("pages").eqNullSafe(c("n")) | ~c("item_count").eqNullSafe(c("items")) | ~c("coverage").eqNullSafe(c("derived")),
    }
    source_faults = whole.select("source", F.lit(None).cast("long").alias("number"), F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in claims.items())))).alias("reason"))
    faults = page_faults.unionByName(source_faults)
    rank = F.array_position(F.array(*map(F.lit, REASONS)), c("reason"))
    first = faults.groupBy("source").agg(F.min_by("reason", rank).alias("reason"), F.count("*").alias("faults"), F.bool_and(c("reason") == "body_missing").alias("only_missing"))
    verdicts = whole.join(first, "source", "left").select(
        "source", F.when(c("reason").isNull(), "VERIFIED").when(c("reason") == "body_missing", "CANNOT_VERIFY").otherwise("MISMATCH").alias("status"), "reason", F.coalesce("faults", zero).alias("faults"), c("derived").alias("coverage"), c("n").alias("pages"), "items", "oids"
    )
    return faults, verdicts
