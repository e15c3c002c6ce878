"""Trailers of commit messages, and what they declare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import normal_email

# Trailers that declare assistance.
ASSIST_KEYS = ("ai-assisted-by", "ai-generated-by", "agent-lane")
TRAILER = r"^([A-Za-z][A-Za-z0-9-]*):\s*(.*?)\s*$"


def trailers(message: Column) -> Column:
    """The (key, value) pairs of the last paragraph, if all of it is trailers; else an empty array.

    The paragraph follows a blank line. Lines that start with white space continue the one
    before, lines that start with # are left out.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(message, F.lit("")), r"\r\n?", "\n"), r"\s+$", "")
    paragraphs = F.split(text, r"\n[ \t]*\n")
    lines = F.filter(F.split(F.element_at(paragraphs, -1), "\n"), lambda x: ~x.rlike(r"^\s*#"))
    joined = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"\n[ \t]+", " "), "\n")
    sound = (F.size(paragraphs) > 1) & F.forall(joined, lambda x: x.rlike(TRAILER))
    pairs = F.transform(joined, lambda x: F.struct(F.lower(F.regexp_extract(x, TRAILER, 1)).alias("key"), F.regexp_extract(x, TRAILER, 2).alias("value")))
    return F.when(sound, pairs).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def _coauthors(pairs: Column) -> Column:
    own = F.filter(pairs, lambda p: (p["key"] == "co-authored-by") & p["value"].rlike(r"<[^<>]+>\s*$"))
    return F.transform(own, lambda p: normal_email(F.regexp_extract(p["value"], r"<([^<>]+)>\s*$", 1)))


def declared_assist(message: Column, emails: Column) -> Column:
    """Whether a trailer declares assistance, by its key or by a co-author in `emails` (an array)."""
    pairs = trailers(message)
    by_key = F.exists(pairs, lambda p: p["key"].isin(*ASSIST_KEYS) & (p["value"] != ""))
    return by_key | F.exists(_coauthors(pairs), lambda e: F.array_contains(emails, e))


def human_coauthor(message: Column, emails: Column) -> Column:
    """Whether a co-author is not in `emails`."""
    return F.exists(_coauthors(trailers(message)), lambda e: ~F.array_contains(emails, e))
