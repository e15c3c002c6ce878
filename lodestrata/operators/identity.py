"""Who wrote a commit: declared identities first, then mapped and plain addresses, then names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..plans.surrogate import Frames
from ..sources.declarations import canonical_authors

#: States that make a declared actor one of the tenant.
TENANT_STATES = ("verified", "claimed", "inferred")
#: Declared addresses up to which they are broadcast.
BROADCAST_ROWS = 100_000


def owners(declared: DataFrame) -> DataFrame:
    """digest, candidates (in order), and canonical_id, login and state where only one actor declares the address."""
    by = declared.where("digest IS NOT NULL").groupBy("digest").agg(F.array_sort(F.collect_set("canonical_id")).alias("candidates"), F.max_by("login", "canonical_id").alias("login"), F.max_by("state", "canonical_id").alias("state"))
    one = F.size("candidates") == 1
    return by.select("digest", "candidates", *(F.when(one, c).alias(n) for c, n in ((F.get("candidates", 0), "canonical_id"), (F.col("login"), "login"), (F.col("state"), "state"))))


def resolve(authors: DataFrame, declared: DataFrame, mailmap: DataFrame, patterns: tuple[str, ...] = (), domain: str = "email") -> DataFrame:
    """author_name and author_email of distinct authors, with basis, partition_key, candidates, state, login and canonical_email.

    The first tier that knows an author tells: the declared raw address, the declared
    mapped address (both by digest, so that declarations need no plain ones), the mapped or
    plain address, the name. An address that several actors declare is a conflict: it has
    its candidates, and no later tier may decide it. An author without address and name is
    unresolved. `patterns` make undeclared addresses inferred members of the tenant.
    """
    own = owners(declared)
    own = F.broadcast(own) if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else own
    rows = canonical_authors(authors.select("author_name", "author_email").distinct(), mailmap)
    raw, mapped = rules.normal_email(F.col("author_email")), F.col("canonical_email")
    rows = rows.withColumn("raw", F.nullif(raw, F.lit(""))).withColumn("mapped", F.nullif(mapped, F.lit("")))
    for tier in ("raw", "mapped"):
        hit = own.select(F.col("digest").alias(f"{tier}_digest"), F.struct("candidates", "canonical_id", "login", "state").alias(f"by_{tier}"))
        rows = rows.withColumn(f"{tier}_digest", rules.digest(domain, F.col(tier))).join(hit, f"{tier}_digest", "left")
    found = F.coalesce("by_raw", "by_mapped")
    name = F.nullif(F.lower(F.regexp_replace(F.trim("author_name"), r"\s+", " ")), F.lit(""))
    many = F.size(found["candidates"]) > 1
    basis = (
        F.when(many, "conflicting_identity")
        .when(found.isNotNull(), "explicit_identity")
        .when(F.col("mapped").isNotNull(), F.when(F.col("mapped").eqNullSafe(F.col("raw")), "email").otherwise("mailmap"))
        .when(name.isNotNull(), "missing_email_name")
        .otherwise("unresolved")
    )
    key = F.when(found.isNotNull(), F.when(~many, F.concat(F.lit("identity:"), found["canonical_id"]))).when(F.col("mapped").isNotNull(), F.concat(F.lit("email:"), F.col("mapped"))).otherwise(F.concat(F.lit("name:"), name))
    inferred = reduce(or_, (F.col("raw").rlike(f"(?i){p}") for p in patterns), F.lit(False))
    state = F.coalesce(found["state"], F.when(found.isNull() & inferred, "inferred"), F.lit("unresolved"))
    return rows.select("author_name", "author_email", basis.alias("basis"), key.alias("partition_key"), found["candidates"].alias("candidates"), state.alias("state"), found["login"].alias("login"), F.col("mapped").alias("canonical_email"))


def resolved_commits(f: Frames) -> DataFrame:
    """The human commits with what `resolve` tells of their authors."""
    people = resolve(f.human, f.declared, f.mailmap, f.tenant_patterns)
    same = f.human["author_name"].eqNullSafe(people["author_name"]) & f.human["author_email"].eqNullSafe(people["author_email"])
    return f.human.join(people, same).drop(people["author_name"]).drop(people["author_email"])


def identity_tiers(f: Frames) -> DataFrame:
    """Commits, authors, actors and tenant commits of each tier in a repository."""
    rows = resolved_commits(f)
    return rows.groupBy("repo", "basis").agg(
        F.count("*").alias("commits"),
        F.countDistinct("author_name", "author_email").alias("authors"),
        F.countDistinct("partition_key").alias("actors"),
        F.count_if(F.col("state").isin(*TENANT_STATES)).alias("tenant_commits"),
        F.count_if(F.col("login").isNotNull()).alias("public_handles"),
    )


def identity_conflicts(f: Frames) -> DataFrame:
    """Each set of actors who declare one and the same address, with the commits that it leaves undecided."""
    rows = resolved_commits(f).where("basis = 'conflicting_identity'")
    return rows.groupBy(F.array_join("candidates", ",").alias("candidates")).agg(F.count("*").alias("commits"), F.countDistinct("canonical_email").alias("addresses"))


def identity_partition(f: Frames) -> DataFrame:
    """Commits and addresses of each actor in a repository, declared aliases and mapped addresses joined."""
    rows = resolved_commits(f).where("partition_key IS NOT NULL")
    return rows.groupBy("repo", "partition_key").agg(F.count("*").alias("commits"), F.countDistinct(F.nullif(rules.normal_email(F.col("author_email")), F.lit(""))).alias("addresses"), F.min("basis").alias("basis"))


MEASURES = {"fn40_identity_tiers": identity_tiers, "jn03_conflicts": identity_conflicts, "fn40_partition": identity_partition}
