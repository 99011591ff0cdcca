"""Category dimension, transaction facts and the month, week and day facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions import calendar as cal
from outlay.functions.categories import (
    CATEGORY_DEFAULT,
    GROUP_DEFAULT,
    budget_group,
    is_analyzed,
    standard_category,
)
from outlay.functions.identity import transaction_key
from outlay.functions.money import inflow, outflow, ratio_rounded


def dim_category(transactions: DataFrame) -> DataFrame:
    """Every raw category seen, with its category and budget group."""
    raw = transactions.select("raw_category").where(F.col("raw_category").isNotNull()).distinct()
    return raw.select("raw_category", standard_category().alias("category"), budget_group().alias("parent_group"))


def with_category(transactions: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Add category and group, with defaults for rows the dimension lacks.

    Without ``dim`` the same rules are evaluated in place: no distinct, no join. With one, the join carries no
    hint: the planner broadcasts the dimension when its measured size allows and splits hot keys when not.
    """
    if dim is None:
        return transactions.withColumns({"category": standard_category(), "parent_group": budget_group()})
    joined = transactions.join(dim.select("raw_category", "category", "parent_group"), "raw_category", "left")
    return joined.withColumns(
        {
            "category": F.coalesce("category", F.lit(CATEGORY_DEFAULT)),
            "parent_group": F.coalesce("parent_group", F.lit(GROUP_DEFAULT)),
        }
    )


def fact_transactions(transactions: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Silver transactions with key, month end, category and group. The month is stored as its last day."""
    out = with_category(transactions, dim).select(
        transaction_key().alias("transaction_id"),
        "issuer",
        "transaction_date",
        cal.month_end(F.col("transaction_date")).alias("transaction_month"),
        "description",
        "amount",
        "transaction_type",
        "raw_category",
        "category",
        "parent_group",
        *[c for c in ("processed_at",) if c in transactions.columns],
    )
    return out


def spending_metrics() -> list[Column]:
    """The five measures of every period fact."""
    net = F.sum(-F.col("amount"))
    count = F.count("transaction_date")
    return [
        F.sum(outflow()).alias("gross_spending"),
        F.sum(inflow()).alias("total_refunds_and_credits"),
        net.alias("net_real_expense"),
        count.alias("total_transaction_count"),
        ratio_rounded(net, count, 2).alias("average_transaction_amount"),
    ]


def _period_fact(facts: DataFrame, period: dict[str, Column], derived: dict[str, Column]) -> DataFrame:
    """Group analyzed rows by the period columns; texts that follow from them are added after grouping."""
    rows = facts.where(is_analyzed()).select(
        *[c.alias(name) for name, c in period.items()],
        "category",
        "parent_group",
        "amount",
        *([] if "transaction_date" in period else ["transaction_date"]),
    )
    grouped = rows.groupBy(*period, "category", "parent_group").agg(*spending_metrics())
    measures = grouped.columns[len(period) + 2 :]
    return grouped.select(
        *period, *[c.alias(name) for name, c in derived.items()], "category", "parent_group", *measures
    )


def fact_monthly_spending(facts: DataFrame) -> DataFrame:
    m = F.col("transaction_month")
    return _period_fact(
        facts,
        {"transaction_month": cal.month_end(F.col("transaction_date"))},
        {"month": cal.month_name(m), "year": cal.year_text(m)},
    )


def fact_daily_spending(facts: DataFrame) -> DataFrame:
    d = F.col("transaction_date")
    return _period_fact(
        facts,
        {"transaction_date": d},
        {
            "day_of_week": cal.weekday_name(d),
            "month": cal.month_name(d),
            "year": cal.year_text(d),
            "transaction_month": cal.month_end(d),
        },
    )


def fact_weekly_spending(facts: DataFrame) -> DataFrame:
    w = F.col("week_start")
    return _period_fact(
        facts,
        {"week_start": cal.week_start(F.col("transaction_date"))},
        {
            "week_end": F.date_add(w, 6),
            "iso_week": cal.iso_week_label(w),
            "year": cal.iso_year(w).cast("string"),
        },
    )


PERIOD_COLUMN = {"monthly": "transaction_month", "weekly": "week_start", "daily": "transaction_date"}


def presentation_order(fact: DataFrame, kind: str) -> DataFrame:
    """Newest period first, smallest gross first; applied when reading, since a written table has no order."""
    return fact.orderBy(F.desc(PERIOD_COLUMN[kind]), "gross_spending", "category", "parent_group")
