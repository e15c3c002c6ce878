"""Small declared tables: mailmaps, identities, project requirements."""

from __future__ import annotations

import hashlib
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import normal_email

#: A mailmap of up to so many lines is broadcast; a longer one is joined by a shuffle.
BROADCAST_LINES = 100_000


def read_mailmap(spark: SparkSession, path: str) -> DataFrame:
    """line, canonical_name, canonical_email, alias_name, alias_email of each entry of a mailmap.

    The four forms are `Name <email>`, `<email> <alias>`, `Name <email> <alias>` and
    `Name <email> Alias <alias>`.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace("raw", r"(^|\s)#.*$", ""))
    form = r"^([^<>]*)<([^<>]+)>(?:\s*([^<>]*)<([^<>]+)>)?\s*$"

    def part(k: int) -> Column:
        return F.nullif(F.trim(F.regexp_extract("t", form, k)), F.lit(""))

    found = rows.select("line", text.alias("t")).where(F.col("t").rlike(form))
    first, second = normal_email(part(2)), normal_email(part(4))
    return found.select("line", part(1).alias("canonical_name"), first.alias("canonical_email"), part(3).alias("alias_name"), F.coalesce(second, first).alias("alias_email"))


def canonical_authors(commits: DataFrame, mailmap: DataFrame) -> DataFrame:
    """commits with canonical_name and canonical_email: an entry for name and address beats one for the address, a later line an earlier."""
    entries = mailmap.select(F.col("alias_email").alias("_email"), F.lower("alias_name").alias("_name"), F.struct(F.col("alias_name").isNotNull().alias("specific"), "line", "canonical_name", "canonical_email").alias("_entry"))
    small = entries.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    authors = commits.select("author_name", "author_email").distinct()
    hit = authors.join(F.broadcast(entries) if small else entries, (normal_email(F.col("author_email")) == F.col("_email")) & (F.col("_name").isNull() | (F.col("_name") == F.lower(F.trim("author_name")))), "left")
    best = hit.groupBy("author_name", "author_email").agg(F.max("_entry").alias("e"))
    mapped = best.select("author_name", "author_email", F.coalesce("e.canonical_name", F.trim("author_name")).alias("canonical_name"), F.coalesce("e.canonical_email", normal_email(F.col("author_email"))).alias("canonical_email"))
    same = commits["author_name"].eqNullSafe(mapped["author_name"]) & commits["author_email"].eqNullSafe(mapped["author_email"])
    return commits.join(mapped, same).select(commits["*"], "canonical_name", "canonical_email")


class DeclarationError(ValueError):
    """A declaration that breaks its rules."""


def identities(spark: SparkSession, text: str) -> DataFrame:
    """canonical_id and email of each declared actor in an identity TOML; an address of two actors is an error."""
    rows, owner = [], {}
    for actor in tomllib.loads(text).get("actors", []):
        name = actor.get("canonical_id")
        if not name:
            raise DeclarationError("an actor without canonical_id")
        for email in actor.get("emails", []):
            own = email.strip().lower()
            if owner.setdefault(own, name) != name:
                raise DeclarationError(f"{own} belongs to two actors")
            rows.append((name, own, bool(actor.get("consent", False))))
    return spark.createDataFrame(rows, "canonical_id string, email string, consent boolean")


def requirements(spark: SparkSession, text: str) -> DataFrame:
    """axis, name, bound and target of a project TOML: named minimums and maximums, and lists of names without a target."""
    rows = []
    for axis, block in tomllib.loads(text).items():
        if not isinstance(block, dict):
            continue
        for name, value in block.items():
            if isinstance(value, list):
                rows += [(axis, str(v), "presence", None) for v in value]
            elif isinstance(value, (int, float)) and not isinstance(value, bool):
                bound, _, rest = name.partition("_")
                rows.append((axis, rest or name, bound if bound in ("min", "max") else "min", float(value)))
    return spark.createDataFrame(rows, "axis string, name string, bound string, target double")


#: Fixed values of identity declarations.
STATES = ("verified", "claimed", "inferred", "unresolved", "external", "bot")
CONSENT, AUTHORITIES = "recorded-explicit-consent", ("repository-owner-authorization", "subject-authorization")
CANONICAL_ID, RESERVED_ID, DIGEST = r"[a-z0-9][a-z0-9._-]{0,63}", r"actor_[a-f0-9]{12,32}", r"[0-9a-f]{64}"
V2_KEYS = {"": {"schema_version", "tenant", "actors"}, "tenant": {"email_patterns"}, "actors": {"canonical_id", "emails", "email_sha256", "github_login", "attribution_state", "consent", "authority"}}
DECLARED = "canonical_id string, digest string, state string, login string, consent string, authority string"


def email_digest(email: str, domain: str = "email") -> str:
    """The digest that `rules.digest` gives for the address in its normal form."""
    return hashlib.sha256(f"{domain}\0{email.strip().lower()}".encode()).hexdigest()


def _texts(value: object, where: str) -> list[str]:
    if value is None:
        return []
    if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
        raise DeclarationError(f"{where} must be a list of texts")
    return value


def declared_identities(spark: SparkSession, text: str, domain: str = "email") -> tuple[DataFrame, list[str]]:
    """The declared actors of an identity TOML (v1 or v2), a row for each address, and the tenant's patterns of addresses.

    Addresses are there as digests only, whether they were declared in plain or as
    digests (v2). An address of two actors is an error in either form; v2 knows no other
    keys than its own, and no consent without an authority.
    """
    data = tomllib.loads(text)
    version = str(data.get("schema_version") or "identity-v1")
    if version not in ("identity-v1", "identity-v2"):
        raise DeclarationError(f"unknown version {version}")
    strict = version == "identity-v2"
    tenant = data.get("tenant") or {}
    actors = data.get("actors") or []
    if not isinstance(tenant, dict) or not isinstance(actors, list) or not all(isinstance(a, dict) for a in actors):
        raise DeclarationError("tenant must be a table and actors a list of tables")
    for where, blocks in (("", [data]), ("tenant", [tenant]), ("actors", actors)) if strict else ():
        if extra := {k for b in blocks for k in b} - V2_KEYS[where]:
            raise DeclarationError(f"unknown keys {sorted(extra)}")
    patterns = _texts(tenant.get("email_patterns"), "email_patterns")
    rows, ids, owner = [], set(), {}
    for actor in actors:
        name, state, consent, authority = str(actor.get("canonical_id") or ""), str(actor.get("attribution_state", "unresolved")), actor.get("consent"), actor.get("authority")
        if not re.fullmatch(CANONICAL_ID, name) or re.fullmatch(RESERVED_ID, name) or name in ids:
            raise DeclarationError(f"canonical_id {name!r} is invalid, reserved or there twice")
        ids.add(name)
        if state not in STATES or consent not in (None, CONSENT) or authority not in (None, *AUTHORITIES):
            raise DeclarationError(f"unknown state, consent or authority of {name}")
        if consent and (state not in ("verified", "claimed") or (strict and authority is None)):
            raise DeclarationError(f"the consent of {name} needs a known state and an authority")
        plain = _texts(actor.get("emails"), "emails")
        hashed = _texts(actor.get("email_sha256"), "email_sha256") if strict else []
        if (plain and hashed) or not all(re.fullmatch(DIGEST, d) for d in hashed):
            raise DeclarationError(f"{name} has addresses in both forms, or a digest that is none")
        digests = [email_digest(e, domain) for e in plain] + hashed
        for d in digests:
            if d in owner:
                raise DeclarationError(f"an address of {owner[d]} comes again with {name}")
            owner[d] = name
        rows += [(name, d, state, actor.get("github_login"), consent, authority) for d in digests or [None]]
    return spark.createDataFrame(rows, DECLARED), patterns
