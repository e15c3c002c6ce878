"""Instants of history exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\s*(Z|[+-]\d{1,4}:?\d{2})?$"


def utc_instant(text: Column) -> Column:
    """An ISO time as UTC; offsets are resolved by arithmetic, however large; no offset means UTC; other shapes give null."""
    naive = F.try_to_timestamp(F.concat(F.regexp_extract(text, _SHAPE, 1), F.lit(" "), F.regexp_extract(text, _SHAPE, 2), F.lit("Z")))
    zone = F.regexp_extract(text, _SHAPE, 3)
    hours, minutes = (F.try_to_number(F.regexp_extract(zone, r"^[+-](\d{1,4}?):?(\d{2})$", k), F.lit("9999")).cast("int") for k in (1, 2))
    seconds = F.coalesce(hours * 3600 + minutes * 60, F.lit(0)) * F.when(zone.startswith("-"), -1).otherwise(1)
    return F.timestamp_seconds(F.unix_micros(naive) / 1_000_000 - seconds)


def zone_rule(text: Column) -> Column:
    """How a time names its zone: utc_zulu, utc_offset, or normalized from another offset."""
    return F.when(text.endswith("Z"), "utc_zulu").when(text.rlike(r"[+-]00:?00$"), "utc_offset").otherwise("normalized")


def commit_instant(iso: Column, local_day: Column) -> Column:
    """The author's instant, or noon UTC of the local day."""
    return F.coalesce(utc_instant(iso), F.timestamp_seconds(F.unix_date(local_day).cast("long") * 86400 + 43200))
