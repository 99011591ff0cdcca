"""Period evidence: the parameterized reads over the gold facts. ``today`` is always an argument."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions import calendar as cal
from outlay.functions.money import ratio_rounded

MAX_NAME = 120


def _first_of_month(value) -> Column:
    return cal.month_start(cal.day(value))


def spending_years(monthly: DataFrame) -> DataFrame:
    """Distinct years, newest first."""
    return monthly.select(F.year("transaction_month").alias("year")).distinct().orderBy(F.desc("year"))


def latest_month(monthly: DataFrame) -> DataFrame:
    """One row: the first day of the newest month, null when there is none."""
    return monthly.agg(cal.month_start(F.max("transaction_month")).alias("latest_month"))


def month_and_previous(monthly: DataFrame, month) -> DataFrame:
    """Rows of a month (given by its first day) and of the month before, months shown as first days."""
    if isinstance(month, (date, str)) and int(str(month)[8:10]) != 1:
        raise ValueError("month must be the first day of a month")
    first = _first_of_month(month)
    rows = monthly.where(F.col("transaction_month").isin(F.last_day(first), F.last_day(F.add_months(first, -1))))
    return rows.select(
        cal.month_start(F.col("transaction_month")).alias("transaction_month"),
        "category",
        "parent_group",
        "gross_spending",
        "total_refunds_and_credits",
        "net_real_expense",
        "total_transaction_count",
        "average_transaction_amount",
    ).orderBy(F.desc("transaction_month"), F.desc("net_real_expense"), "category", "parent_group")


def report_period(monthly: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """``month_and_previous`` for a year and month, or for the newest month when both are left out."""
    if (year is None) != (month is None):
        raise ValueError("give both year and month, or neither")
    if year is None:
        return month_and_previous(monthly, latest_month(monthly).scalar())
    return month_and_previous(monthly, date(int(year), int(month), 1))


def spending_summary(monthly: DataFrame, today, days_back: int = 90) -> DataFrame:
    """Month rows whose month end falls within the last ``days_back`` days."""
    if not 1 <= days_back <= 730:
        raise ValueError("days_back must be between 1 and 730")
    return monthly.where(F.col("transaction_month") >= F.date_sub(cal.day(today), days_back)).orderBy(
        F.desc("transaction_month"), F.desc("net_real_expense"), "category", "parent_group"
    )


def summary_with_totals(monthly: DataFrame, today, days_back: int = 90) -> DataFrame:
    """``spending_summary`` with each month's total beside its rows."""
    total = F.sum("net_real_expense").over(Window.partitionBy("transaction_month"))
    return spending_summary(monthly, today, days_back).withColumn("monthly_total_net_real_expense", total)


def category_detail(monthly: DataFrame, category: str, month, previous_month=None) -> DataFrame:
    """One category in one or two months."""
    if not category or len(category) > MAX_NAME:
        raise ValueError("category is required and must be at most 120 characters")
    months = [F.last_day(cal.day(m)) for m in (month, previous_month) if m is not None]
    return monthly.where((F.col("category") == category) & F.col("transaction_month").isin(*months)).orderBy(
        F.desc("transaction_month"), "parent_group"
    )


def transaction_detail(facts: DataFrame, month, category: str | None = None, limit: int = 25) -> DataFrame:
    """A month's transactions, newest then largest first, at most ``limit`` (1..100)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    first = _first_of_month(month)
    # The date range, not a function of it, so the scan can skip files.
    rows = facts.where(F.col("transaction_date").between(first, F.last_day(first)))
    if category:
        rows = rows.where(F.col("category") == category)
    columns = (
        "transaction_id", "issuer", "transaction_date", "transaction_month", "description", "amount",
        "transaction_type", "category", "parent_group",
    )
    order = (F.desc("transaction_date"), F.desc(F.abs("amount")), "transaction_id", "description")
    return rows.select(*columns).orderBy(*order).limit(limit)


def named_rows(df: DataFrame, category: str | None = None, parent_group: str | None = None) -> DataFrame:
    """Optional category and group predicates; blank means all."""
    for name, value in (("category", category), ("parent_group", parent_group)):
        value = str(value).strip() if value else None
        if value and len(value) > MAX_NAME:
            raise ValueError(f"{name} must be at most 120 characters")
        if value:
            df = df.where(F.col(name) == value)
    return df


def _period_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum a period fact over its categories; the average is net over count, null for no rows."""
    net, count = F.sum("net_real_expense"), F.sum("total_transaction_count")
    return (
        df.groupBy(*keys)
        .agg(
            F.round(F.sum("gross_spending"), 2).alias("gross_spending"),
            F.round(F.sum("total_refunds_and_credits"), 2).alias("total_refunds_and_credits"),
            F.round(net, 2).alias("net_real_expense"),
            count.alias("total_transaction_count"),
            ratio_rounded(net, count, 2).alias("average_transaction_amount"),
        )
        .orderBy(keys[0])
    )


def daily_spending(daily: DataFrame, month, category: str | None = None, parent_group: str | None = None) -> DataFrame:
    """One row per day of a month."""
    first = _first_of_month(month)
    rows = daily.where(F.col("transaction_date").between(first, F.last_day(first)))
    return _period_totals(
        named_rows(rows, category, parent_group), ["transaction_date", "day_of_week", "month", "year"]
    )


def weekly_spending(
    weekly: DataFrame, month, category: str | None = None, parent_group: str | None = None
) -> DataFrame:
    """One row per whole week touching a month."""
    first = _first_of_month(month)
    rows = weekly.where((F.col("week_end") >= first) & (F.col("week_start") <= F.last_day(first)))
    return _period_totals(named_rows(rows, category, parent_group), ["week_start", "week_end", "iso_week", "year"])
