"""Category dimension, transaction facts, period facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import gold
from outlay.queries.base import CATEGORY, GROUP, average, big, dbl, query, with_

METRICS = ", ".join(
    [
        dbl("sum(gross)", "gross_spending"),
        dbl("sum(refund)", "total_refunds_and_credits"),
        dbl("sum(spend)", "net_real_expense"),
        big("count(*)", "total_transaction_count"),
        f"{average('sum(spend)', 'count(*)')} AS average_transaction_amount",
    ]
)

_DIM = with_("txn") + (
    f"SELECT raw_category, {CATEGORY} AS category, {GROUP} AS parent_group "
    "FROM (SELECT DISTINCT raw_category FROM txn WHERE raw_category IS NOT NULL)"
)


@query("p7_p8_a4_dim_category", _DIM)
def dim_category(s):
    return gold.dim_category(s.transactions)


_FACT_COLUMNS = """transaction_id, issuer, transaction_date, transaction_month, description, CAST(amount AS DOUBLE) AS amount,
  transaction_type, raw_category, category, parent_group"""
_ID = """md5(issuer || '_' || CAST(transaction_date AS VARCHAR) || '_' || COALESCE(description, '') || '_' ||
  regexp_replace(CAST(CAST(amount AS DECIMAL(38,9)) AS VARCHAR), '\\.?0+$', '')) AS transaction_id"""
_FACT = with_("fact") + f"SELECT {_FACT_COLUMNS} FROM (SELECT *, {_ID} FROM fact)"


@query("f1_f2_fact_transactions", _FACT)
def facts(s):
    return s.facts


@query("j1_fact_category_join", _FACT)
def fact_join(s):
    return gold.fact_transactions(s.transactions, gold.dim_category(s.transactions))


_MONTHLY = with_("spend") + (
    "SELECT transaction_month, strftime(transaction_month, '%B') AS month, strftime(transaction_month, '%Y') AS year, "
    f"category, parent_group, {METRICS} FROM spend GROUP BY ALL"
)


@query("a1_monthly_spending", _MONTHLY)
def monthly(s):
    return gold.fact_monthly_spending(s.facts)


@query(
    "a2_daily_spending",
    with_("spend")
    + "SELECT transaction_date, strftime(transaction_date, '%A') AS day_of_week, strftime(transaction_date, '%B') AS month, "
    f"strftime(transaction_date, '%Y') AS year, transaction_month, category, parent_group, {METRICS} FROM spend GROUP BY ALL",
)
def daily(s):
    return gold.fact_daily_spending(s.facts)


@query(
    "a3_f9_weekly_spending",
    with_("spend")
    + ", w AS (SELECT *, CAST(date_trunc('week', transaction_date) AS DATE) AS week_start FROM spend) "
    "SELECT week_start, CAST(week_start + INTERVAL 6 DAY AS DATE) AS week_end, strftime(week_start, '%G-W%V') AS iso_week, "
    f"strftime(week_start, '%G') AS year, category, parent_group, {METRICS} FROM w GROUP BY ALL",
)
def weekly(s):
    return gold.fact_weekly_spending(s.facts)


@query("p9_analyzed_types", with_("fact") + "SELECT transaction_type, count(*) AS n FROM fact WHERE transaction_type "
       "IN ('Sale', 'Return', 'Adjustment') GROUP BY 1")  # fmt: skip
def analyzed(s):
    from outlay.functions.categories import is_analyzed

    return s.facts.where(is_analyzed()).groupBy("transaction_type").agg(F.count("*").alias("n"))


@query(
    "o1_presentation_order",
    with_("spend")
    + ", m AS (SELECT transaction_month, category, parent_group, sum(gross) AS g FROM spend GROUP BY ALL) "
    "SELECT transaction_month, category, parent_group, CAST(g AS DOUBLE) AS gross_spending, "
    "row_number() OVER (ORDER BY transaction_month DESC, g, category, parent_group) AS position FROM m",
)
def ordered(s):
    from pyspark.sql import Window

    out = gold.presentation_order(gold.fact_monthly_spending(s.facts), "monthly")
    # Position within a month plus the rows of later months, so no task sees more than one month.
    inside = Window.partitionBy("transaction_month").orderBy("gross_spending", "category", "parent_group")
    sizes = out.groupBy("transaction_month").agg(F.count("*").alias("n"))
    later = sizes.select(
        "transaction_month",
        F.coalesce(
            F.sum("n").over(Window.orderBy(F.desc("transaction_month")).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("before"),
    )
    return out.withColumn("rank", F.row_number().over(inside)).join(later, "transaction_month").select(
        "transaction_month", "category", "parent_group", "gross_spending", (F.col("rank") + F.col("before")).alias("position")
    )
