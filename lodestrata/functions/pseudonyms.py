"""Keyed pseudonyms; Spark has no keyed hash, so these are Arrow-batched functions."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scope_key(secret: bytes, scope: str) -> bytes:
    """The key of a scope: pseudonyms of one scope say nothing about another's."""
    return hmac.new(secret, scope.encode(), hashlib.sha256).digest()


def pseudonym(value: Column, key: bytes, prefix: str = "actor_") -> Column:
    """prefix and 26 letters of the keyed hash in base 32; null stays null."""

    @F.pandas_udf("string")
    def masked(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            raw = hmac.new(key, v.encode(), hashlib.sha256).digest()[:16]
            return prefix + base64.b32encode(raw).decode().rstrip("=").lower()

        return values.map(one)

    return masked(value)
