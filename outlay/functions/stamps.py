"""Instants, durations and first-recorded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import col


def from_iso(text: Column | str) -> Column:
    """An instant from ISO text; text without an offset is UTC (the session time zone of this library)."""
    return col(text).try_cast("timestamp")


def from_epoch(seconds: Column | str) -> Column:
    """An instant from epoch seconds, kept to the microsecond; null when out of range."""
    s = col(seconds).cast("double")
    return F.when(F.abs(s) < 1e11, F.timestamp_micros(F.round(s * 1e6).cast("long")))


def seconds_between(start: Column, end: Column) -> Column:
    """Duration in seconds, one place."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)).cast("decimal(20,0)") / 1_000_000, 1).cast("double")


def instant_text(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def first_recorded(*values: Column | str) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(col(v).cast("string")), F.lit("")) for v in values])


def model_label(provider: Column, model: Column) -> Column:
    """provider:model, the model alone without a provider, empty without a model."""
    m = F.coalesce(model, F.lit(""))
    p = F.coalesce(provider, F.lit(""))
    return F.when(m == "", F.lit("")).when(p == "", m).otherwise(F.concat(p, F.lit(":"), m))


def role_model(*sources: tuple[Column, Column]) -> tuple[Column, Column]:
    """(provider, model) from the first source naming a model.

    A missing provider comes from the first other source that names the same model with one.
    """
    blank = F.lit("")
    pairs = F.array(
        *[
            F.struct(
                F.coalesce(F.trim(p.cast("string")), blank).alias("provider"),
                F.coalesce(F.trim(m.cast("string")), blank).alias("model"),
            )
            for p, m in sources
        ]
    )
    first = F.try_element_at(F.filter(pairs, lambda x: x["model"] != ""), F.lit(1))
    same = F.filter(pairs, lambda x: (x["provider"] != "") & (x["model"] == first["model"]))
    provider = F.coalesce(
        F.nullif(first["provider"], blank), F.try_element_at(same, F.lit(1))["provider"], blank
    )
    return provider, F.coalesce(first["model"], blank)
