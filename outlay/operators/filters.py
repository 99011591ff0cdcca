"""Row filters of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_filters(rows: DataFrame, f) -> DataFrame:
    """Keep the rows a ``Filters`` request allows; unset fields allow all. Amount bounds are on the size."""
    for column, wanted in (("category", f.category), ("parent_group", f.parent_group), ("issuer", f.issuer)):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    if f.exclude_category:
        rows = rows.where(~F.col("category").isin(*f.exclude_category))
    if f.merchant:
        rows = rows.where(F.lower("merchant").isin(*[m.lower() for m in f.merchant]))
    if f.merchant_contains:
        rows = rows.where(F.lower("merchant").contains(f.merchant_contains.lower()))
    size = F.abs("amount")
    if f.min_amount is not None:
        rows = rows.where(size >= f.min_amount)
    if f.max_amount is not None:
        rows = rows.where(size <= f.max_amount)
    return rows


def within(day: Column | str, start: Column, end: Column) -> Column:
    """Inclusive date test."""
    d = F.col(day) if isinstance(day, str) else day
    return (d >= start) & (d <= end)


def in_months(start: Column, end: Column) -> Column:
    """Rows whose ``month``, the partition column of a stored frame, touches the dates: opens no other partition."""
    return (F.col("month") >= F.trunc(start, "MM")) & (F.col("month") <= F.trunc(end, "MM"))


def positive_rows(table: DataFrame, value: str) -> DataFrame:
    """Rows that can be drawn as shares of an area."""
    return table.where(F.coalesce(F.col(value), F.lit(0)) > 0)
