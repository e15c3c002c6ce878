"""Measures over many repositories: buckets, prevalence, coverage, admission, remotes and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.observe import ratio, rounded
from ..plans.surrogate import Frames
from . import commits, compare

# Shapes of credentials that must not leave.
CREDENTIALS = {
    "assignment": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{6,}",
    "access_key": r"AKIA[A-Z0-9]{16}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "long_hex": r"(^|[^0-9a-f])[0-9a-f]{32,}($|[^0-9a-f])",
}


def buckets(f: Frames) -> DataFrame:
    """Counts and ratios of each repository in closed buckets only."""
    out = commits.population(f)
    return out.select("repo", *(rules.count_bucket(F.col(c)).alias(c) for c in ("commits", "bots", "human_merges", "human_nonmerge")), rules.ratio_bucket(F.col("human_nonmerge_share")).alias("human_nonmerge_share"))


def prevalence(f: Frames) -> DataFrame:
    """Repositories that declare a library, each once, and all of its ecosystem."""
    rows = f.table("lineitem").join(f.table("part"), F.col("l_partkey") == F.col("p_partkey")).join(f.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("p_type").alias("ecosystem"), F.col("p_brand").alias("library"), F.col("s_nationkey").alias("repo")).distinct()
    libraries = rows.groupBy("ecosystem", "library").agg(F.count("*").alias("declaring"))
    whole = rows.select("ecosystem", "repo").distinct().groupBy("ecosystem").agg(F.count("*").alias("repositories"))
    return libraries.join(F.broadcast(whole), "ecosystem").select("ecosystem", "library", "declaring", "repositories", ratio(F.col("declaring"), F.col("repositories")).alias("share"))


def library_lookup(f: Frames) -> DataFrame:
    """Each library's one ecosystem, or that it is ambiguous."""
    rows = f.table("part").select(F.col("p_brand").alias("library"), F.col("p_type").alias("ecosystem")).distinct()
    out = rows.groupBy("library").agg(F.count("*").alias("n"), F.min("ecosystem").alias("e"))
    return out.select("library", F.when(F.col("n") == 1, F.col("e")).alias("ecosystem"), F.when(F.col("n") > 1, "ambiguous_ecosystem").alias("reason"))


def periods(f: Frames) -> DataFrame:
    """First and last day and the number of distinct reports of each subject; equal digests count once."""
    rows = f.table("orders").select((F.col("o_custkey") % 50).alias("subject"), F.to_date("o_orderdate").alias("day"), F.sha2(F.concat_ws("|", F.col("o_orderpriority"), F.col("o_orderstatus"), F.year("o_orderdate").cast("string")), 256).alias("digest"))
    out = rows.groupBy("subject", "digest").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b")).groupBy("subject").agg(F.count("*").alias("reports"), F.count_if(F.col("n") > 1).alias("duplicated"), F.min("a").cast("string").alias("first_day"), F.max("b").cast("string").alias("last_day"))
    return out.select("*", ratio(F.col("reports") - F.col("duplicated"), F.col("reports"), 12).alias("unique_share"))


def coverage_matrix(f: Frames) -> DataFrame:
    """Whether each measure was observed in each repository, in the long form: metric, repo, observed."""
    return compare.repo_metrics(f).groupBy("metric", "repo").agg(F.max(F.col("value").isNotNull().cast("long")).alias("observed"))


def admission(f: Frames) -> DataFrame:
    """Repositories of each region that could be measured and whose rate may be told."""
    nation = f.table("nation").select(F.col("n_nationkey").cast("long").alias("repo"), F.col("n_regionkey").cast("long").alias("group"))
    out = nation.join(commits.test_cochange(f), "repo", "left")
    return out.groupBy("group").agg(F.count("*").alias("repositories"), F.count_if(F.col("population").isNotNull()).alias("ok"), F.count_if(F.coalesce("narrate_rate", F.lit(False))).alias("narratable"))


def remotes(f: Frames) -> DataFrame:
    """Every page's address as a remote's identity."""
    return f.table("pages").select("page_id", rules.remote_identity(F.col("url")).alias("remote"))


def robots(f: Frames) -> DataFrame:
    """Whether rules of paths allow each page: the longest matching prefix decides, and allowing wins a tie."""
    rules_of = f.spark.createDataFrame([("/en", True), ("/fr", False), ("/fr/8", True), ("/de/2", False), ("/de/2", True), ("/es", False)], "prefix string, allow boolean")
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    pages = f.table("pages").select("page_id", path.alias("path"))
    hits = pages.join(F.broadcast(rules_of), F.col("path").startswith(F.col("prefix")))  # six rules
    best = hits.groupBy("page_id").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow")).alias("m"))
    return pages.join(best, "page_id", "left").select("page_id", F.coalesce("m.allow", F.lit(True)).alias("allowed"))


def leak_guard(f: Frames) -> DataFrame:
    """Documents that hold something of each shape of a credential."""
    hits = [F.when(F.col("text").rlike(p), F.lit(k)) for k, p in CREDENTIALS.items()]
    return f.table("documents").select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("shape"))


def value_bounds(f: Frames) -> DataFrame:
    """Rate rows that break an invariant: a numerator over its denominator, or a value that isn't their ratio."""
    rows = commits.test_cochange(f)
    off = F.abs(F.col("rate") - rounded(F.col("cochanged") / F.col("population"))) > 1e-12
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("cochanged") > F.col("population")).alias("over"), F.count_if(F.coalesce(off, F.lit(False))).alias("off"))
