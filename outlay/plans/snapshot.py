"""Monthly budget snapshot: current against previous month, caps, notable changes, and texts made from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions import calendar as cal
from outlay.functions.categories import is_analyzed, is_discretionary
from outlay.functions.money import (
    change_direction,
    money_text,
    percent_change,
    percent_rounded,
    percent_text,
    suggested_cap,
)

MONEY = "decimal(24,2)"
# What makes a change notable, and how many are listed.
NOTABLE_PERCENT, NOTABLE_USD, NOTABLE_LIMIT = 50.0, 250.0, 5
TOP_DISCRETIONARY = 3
SHOWN_CATEGORIES = 12


CATEGORY_COLUMNS = (
    "category", "parent_group", "current_spend", "previous_spend", "goal_amount", "is_discretionary", "mom_change_percent",
    "goal_percent", "suggested_cap", "cap_source", "cap_basis", "bar_width_percent", "is_refund", "mom_direction",
)


@dataclass
class Snapshot:
    """``lines`` are the categories with the header beside each, as a struct ``header``."""

    header: DataFrame
    categories: DataFrame
    notable: DataFrame
    lines: DataFrame


def _cents(x: Column) -> Column:
    return F.round(x.cast("decimal(38,9)"), 2).cast(MONEY)


def month_sums(frame: DataFrame, month) -> DataFrame:
    """Net spend by month, category and group for a month and the one before, from an analysis frame."""
    first = cal.month_start(cal.day(month))
    d = F.col("transaction_date")
    rows = frame.where(is_analyzed() & (d >= F.add_months(first, -1)) & (d <= F.last_day(first)))
    return rows.groupBy(cal.month_start(d).alias("transaction_month"), "category", "parent_group").agg(
        F.round(F.sum(-F.col("amount")), 2).alias("net_real_expense")
    )


def monthly_snapshot(
    rows: DataFrame,
    deposit: float,
    fixed_costs: float,
    savings_goal: float | None = None,
    category_goals: Mapping[str, float] | None = None,
    notable_percent: float = NOTABLE_PERCENT,
    notable_usd: float = NOTABLE_USD,
) -> Snapshot:
    """Snapshot of rows (transaction_month, category, parent_group, net_real_expense).

    The latest and the second-latest month present are compared; empty rows give empty tables.
    """
    goals = dict(category_goals or {})
    net, month = F.col("net_real_expense"), F.col("transaction_month")
    # One row for each month, category and group: all that follows works on this small table, in one place.
    whole = Window.partitionBy()
    sums = rows.groupBy("transaction_month", "category", "parent_group").agg(F.sum(net).alias("net_real_expense"))
    sums = sums.withColumn("latest_month", F.max(month).over(whole))
    sums = sums.withColumn("previous_month", F.max(F.when(month < F.col("latest_month"), month)).over(whole))
    latest, previous = F.col("latest_month"), F.col("previous_month")
    # Both months side by side, a missing side is 0.
    base = sums.where((month == latest) | (month == previous)).groupBy("category", "parent_group").agg(
        _cents(F.sum(F.when(month == latest, net).otherwise(0))).alias("current_spend"),
        _cents(F.sum(F.when(month == previous, net).otherwise(0))).alias("previous_spend"),
        F.max("latest_month").alias("latest_month"),
        F.max("previous_month").alias("previous_month"),
    )
    goal = F.lit(None).cast(MONEY)
    if goals:
        table = F.create_map(*[x for k, v in goals.items() for x in (F.lit(k), F.lit(str(v)).cast(MONEY))])
        goal = F.try_element_at(table, F.col("category"))
    base = base.withColumns({"goal_amount": goal, "is_discretionary": is_discretionary()})

    current, before, discretionary = F.col("current_spend"), F.col("previous_spend"), F.col("is_discretionary")
    target = F.lit(None if savings_goal is None else str(savings_goal)).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    positive = discretionary & (current > 0)
    largest = whole.orderBy(F.desc_nulls_last(F.when(positive, current)), "category", "parent_group")
    base = base.withColumn("_place", F.when(positive, F.row_number().over(largest)))
    top = F.collect_list(F.when(F.col("_place") <= TOP_DISCRETIONARY, F.struct("_place", "category")))
    fixed, income = F.lit(str(fixed_costs)).cast(MONEY), F.lit(str(deposit)).cast(MONEY)
    base = base.withColumns(
        {
            "_total": _cents(F.sum(current).over(whole)),
            "_before": F.when(previous.isNotNull(), _cents(F.sum(before).over(whole))),
            "_eligible": F.coalesce(_cents(F.sum(F.when(positive, current)).over(whole)), zero),
            "_most": F.coalesce(F.max(F.when(current > 0, current)).over(whole), zero),
            "_any": F.max(discretionary).over(whole),
            "_open": F.max(discretionary & F.col("goal_amount").isNull()).over(whole),
            "_top": F.array_sort(top.over(whole)),
        }
    )
    base = base.withColumn("_cash", (income - (F.col("_total") + fixed)).cast(MONEY))
    base = base.withColumn("_short", F.when(target.isNotNull(), F.greatest(zero, (target - F.col("_cash")).cast(MONEY))))
    short, eligible = F.col("_short"), F.col("_eligible")
    method = F.when(F.col("_any") & ~F.col("_open"), F.lit("configured")).when(target.isNull(), F.lit("no_savings_target"))
    header = {
        "latest_total_net_expense": F.col("_total"),
        "eligible_discretionary_total": eligible,
        "max_positive_spend": F.col("_most"),
        "latest_month": latest,
        "previous_month": previous,
        "monthly_deposit": income,
        "fixed_costs": fixed,
        "savings_goal": target,
        "disposable_cash": F.col("_cash"),
        "previous_total_net_expense": F.col("_before"),
        "projected_savings": F.col("_cash"),
        "savings_shortfall": short,
        "mom_change_percent": percent_change(F.col("_total"), F.col("_before")),
        "goal_method": method.when(short > 0, F.lit("shortfall_allocation")).otherwise(F.lit("trend_maintenance")),
        "discretionary_cuts_insufficient": F.coalesce((short > 0) & (short > eligible), F.lit(False)),
        "remaining_gap_after_cuts": F.greatest(zero, (short - eligible).cast(MONEY)),
        "top_discretionary_categories": F.transform("_top", lambda x: x["category"]),
    }
    header = F.struct(*[value.alias(name) for name, value in header.items()])

    has_previous = previous.isNotNull()
    cap, reason = suggested_cap(current, before, has_previous, target, short, eligible)
    table = base.withColumns({"header": header, "_cap": cap, "_reason": reason})
    configured = F.col("goal_amount").isNotNull()
    table = table.withColumns(
        {
            "mom_change_percent": F.when(has_previous, percent_change(current, before)),
            "goal_percent": F.when(F.col("goal_amount") > 0, percent_rounded(current, F.col("goal_amount"), 2)),
            "suggested_cap": F.when(discretionary, F.coalesce("goal_amount", "_cap")),
            "cap_source": F.when(
                discretionary,
                F.when(configured, F.lit("configured")).when(F.col("_cap").isNotNull(), F.lit("suggested")),
            ),
            "cap_basis": F.when(
                discretionary, F.when(configured, F.lit("Configured category goal.")).otherwise(F.col("_reason"))
            ).otherwise(F.lit("")),
            "bar_width_percent": F.when(current > 0, percent_rounded(current, F.col("_most"), 2)).otherwise(F.lit(0.0)),
            "is_refund": current < 0,
            "mom_direction": change_direction(current, before, has_previous),
        }
    )
    share = F.when(F.col("suggested_cap") > 0, percent_rounded(current, F.col("suggested_cap"), 2))
    lines = table.select(*CATEGORY_COLUMNS, share.alias("percent_of_cap"), "header")
    first = lines.agg(F.first("header").alias("h")).where("h IS NOT NULL").select("h.*")
    return Snapshot(first, lines.drop("header"), notable_changes(lines, notable_percent, notable_usd), lines)


def notable_changes(
    categories: DataFrame, percent: float = NOTABLE_PERCENT, usd: float = NOTABLE_USD, limit: int = NOTABLE_LIMIT
) -> DataFrame:
    """Categories that moved by at least the percent or dollar threshold, largest dollar move first."""
    current, before = F.col("current_spend"), F.col("previous_spend")
    change = current - before
    pct = F.col("mom_change_percent")
    wanted = (
        (F.col("mom_direction") != "no_prior")
        & ((before > 0) | (current > 0))
        & (F.abs(change) >= 0.005)
        & (F.coalesce(F.abs(pct) >= percent, F.lit(False)) | (F.abs(change) >= usd))
    )
    return (
        categories.where(wanted)
        .select(
            "category",
            "parent_group",
            "current_spend",
            "previous_spend",
            change.alias("change_usd"),
            pct.alias("change_pct"),
            F.when(change > 0, F.lit("increase")).otherwise(F.lit("decrease")).alias("direction"),
        )
        .orderBy(F.desc(F.abs("change_usd")), "category", "parent_group")
        .limit(limit)
    )


def nearest_months(months: DataFrame, target, limit: int = 5) -> DataFrame:
    """The months with data closest to one that has none. ``months`` has one DATE column, ``month``."""
    first = cal.month_start(cal.day(target))
    return (
        months.select("month").distinct().orderBy(F.abs(F.datediff("month", first)), "month").limit(limit).orderBy("month")
    )


def month_snapshot(frame: DataFrame, month, deposit: float, fixed_costs: float, **options) -> Snapshot:
    """Snapshot of one month straight from an analysis frame."""
    return monthly_snapshot(month_sums(frame, month), deposit, fixed_costs, **options)


def shown_categories(snapshot: Snapshot, limit: int = SHOWN_CATEGORIES) -> DataFrame:
    """Largest categories first, each with the snapshot's totals beside it."""
    return (
        snapshot.lines.select(
            "category", "parent_group", "current_spend", "previous_spend", F.col("mom_change_percent"),
            "header.latest_total_net_expense", "header.previous_total_net_expense", "header.disposable_cash",
        )
        .orderBy(F.desc("current_spend"), "category", "parent_group")
        .limit(limit)
    )


def category_lines(snapshot: Snapshot) -> DataFrame:
    """Report fact line per category: amounts as text, change in words, cap in words."""
    current, before = F.col("current_spend"), F.col("previous_spend")
    cap = F.col("suggested_cap")
    prior = F.when(F.col("mom_direction") == "no_prior", F.lit("no prior-month data (say so)")).otherwise(
        money_text(before)
    )
    reason = F.coalesce(F.nullif("cap_basis", F.lit("")), F.lit("no cap can be calculated"))
    label = F.when(F.col("cap_source") == "configured", F.lit("configured goal ")).otherwise(
        F.lit("advisor-suggested cap ")
    )
    share = F.when(
        F.col("percent_of_cap").isNull(),
        F.concat(
            F.lit("no percent of cap; state that it does not apply because the cap is "), money_text(cap)
        ),
    ).otherwise(F.concat(F.lit("percent of cap "), F.format_string("%.2f", F.col("percent_of_cap")), F.lit("%")))
    cap_text = F.when(
        cap.isNull(), F.concat(F.lit("no cap and no percent; state why: "), reason)
    ).otherwise(F.concat(label, money_text(cap), F.lit("; "), share))
    line = F.concat(
        "category", F.lit(": current "), money_text(current), F.lit("; previous "), prior, F.lit("; MoM "),
        percent_text(F.col("mom_change_percent"), F.col("mom_direction")), F.lit("; "), cap_text, F.lit("."),
    )
    return snapshot.categories.select("category", "parent_group", line.alias("line"))


def group_lines(snapshot: Snapshot) -> DataFrame:
    """One line per budget group, groups without discretionary spending first. Categories are a closed list."""
    refund = F.when(F.col("is_refund"), F.lit(" (label as refund/credit)")).otherwise(F.lit(""))
    item = F.concat("category", F.lit(" "), money_text(F.col("current_spend")), refund)
    return (
        snapshot.categories.groupBy("parent_group")
        .agg(
            F.array_sort(F.collect_list(F.struct("category", item.alias("text")))).alias("items"),
            F.bool_or("is_discretionary").alias("discretionary"),
        )
        .select(
            "parent_group",
            "discretionary",
            F.concat(
                "parent_group", F.lit(": "), F.array_join(F.transform("items", lambda x: x["text"]), ", "), F.lit(".")
            ).alias("line"),
        )
        .orderBy("discretionary", "parent_group")
    )
