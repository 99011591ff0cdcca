"""Stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import col
from outlay.functions.money import NUMERIC


def numeric_text(amount: Column | str) -> Column:
    """An amount without trailing zeros: -70, 12.5."""
    a = col(amount).cast(NUMERIC)
    return F.when(a == 0, F.lit("0")).otherwise(F.regexp_replace(a.cast("string"), r"\.?0+$", ""))


def transaction_key(issuer="issuer", day="transaction_date", description="description", amount="amount") -> Column:
    """Hex MD5 of issuer, date, description and amount; null without an amount. Genuine repeats share a key."""
    parts = [col(issuer), col(day).cast("string"), F.coalesce(col(description), F.lit("")), numeric_text(amount)]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("_"), part)
    return F.md5(joined)


def thread_key(channel: Column | str, external_key: Column | str) -> Column:
    """SHA-256 of ``channel:key``."""
    return F.sha2(F.concat(col(channel), F.lit(":"), col(external_key)), 256)


def hashed_key(external_key: Column | str) -> Column:
    """SHA-256 of the key alone, so the key itself is never stored."""
    return F.sha2(col(external_key), 256)
