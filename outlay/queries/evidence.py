"""Period evidence over the gold facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import evidence as ev
from outlay.operators import gold
from outlay.queries.base import MONTH, TODAY, average, big, dbl, query, with_

_MEASURES = ", ".join(
    [
        dbl("gross_spending", "gross_spending"),
        dbl("total_refunds_and_credits", "total_refunds_and_credits"),
        dbl("net_real_expense", "net_real_expense"),
        "total_transaction_count",
        f"{average('net_real_expense', 'total_transaction_count')} AS average_transaction_amount",
    ]
)
_NAMES = "strftime(transaction_month, '%B') AS month, strftime(transaction_month, '%Y') AS year"
_TOTALS = ", ".join(
    [
        dbl("sum(gross)", "gross_spending"),
        dbl("sum(refund)", "total_refunds_and_credits"),
        dbl("sum(spend)", "net_real_expense"),
        big("count(*)", "total_transaction_count"),
        f"{average('sum(spend)', 'count(*)')} AS average_transaction_amount",
    ]
)


def _monthly(s):
    return gold.fact_monthly_spending(s.facts)


@query("a5_f7_spending_years", with_("monthly") + "SELECT DISTINCT CAST(year(transaction_month) AS BIGINT) AS year FROM monthly")
def years(s):
    return ev.spending_years(_monthly(s))


@query("a6_latest_month", with_("monthly") + "SELECT CAST(date_trunc('month', max(transaction_month)) AS DATE) AS latest_month FROM monthly")
def latest(s):
    return ev.latest_month(_monthly(s))


_MONTH_ROWS = f"""SELECT CAST(date_trunc('month', transaction_month) AS DATE) AS transaction_month, category, parent_group,
  {_MEASURES} FROM monthly"""


@query(
    "o3_p10_month_and_previous",
    with_("monthly") + _MONTH_ROWS + " WHERE transaction_month IN (DATE '2001-09-30', DATE '2001-08-31')",
)
def month_rows(s):
    return ev.month_and_previous(_monthly(s), MONTH)


@query(
    "o3_latest_report_period",
    with_("monthly")
    + _MONTH_ROWS
    + """ WHERE transaction_month IN ((SELECT max(transaction_month) FROM monthly),
  (SELECT last_day(max(transaction_month) - INTERVAL 1 MONTH) FROM monthly))""",
)
def latest_period(s):
    return ev.report_period(_monthly(s))


@query(
    "p11_spending_summary",
    with_("monthly") + f"SELECT transaction_month, {_NAMES}, category, parent_group, {_MEASURES} FROM monthly "
    "WHERE transaction_month >= DATE '2001-11-15' - INTERVAL 400 DAY",
)
def summary(s):
    return ev.spending_summary(_monthly(s), TODAY, 400)


@query(
    "w3_month_totals",
    with_("monthly")
    + f"""SELECT transaction_month, {_NAMES}, category, parent_group, {_MEASURES},
  CAST(sum(net_real_expense) OVER (PARTITION BY transaction_month) AS DOUBLE) AS monthly_total_net_real_expense
  FROM monthly WHERE transaction_month >= DATE '2001-11-15' - INTERVAL 90 DAY""",
)
def with_totals(s):
    return ev.summary_with_totals(_monthly(s), TODAY)


@query(
    "o4_category_detail",
    with_("monthly") + f"SELECT transaction_month, {_NAMES}, category, parent_group, {_MEASURES} FROM monthly "
    "WHERE category = 'Health & Wellness' AND transaction_month IN (DATE '2001-09-30', DATE '2001-08-31')",
)
def category(s):
    return ev.category_detail(_monthly(s), "Health & Wellness", "2001-09-10", "2001-08-01")


@query(
    "o2_transaction_detail",
    with_("fact")
    + """SELECT md5(issuer || '_' || CAST(transaction_date AS VARCHAR) || '_' || description || '_' ||
    regexp_replace(CAST(CAST(amount AS DECIMAL(38,9)) AS VARCHAR), '\\.?0+$', '')) AS transaction_id, issuer,
  transaction_date, transaction_month, description, CAST(amount AS DOUBLE) AS amount, transaction_type, category,
  parent_group FROM fact WHERE transaction_month = DATE '2001-09-30' AND category = 'Travel'
  ORDER BY transaction_date DESC, abs(amount) DESC, transaction_id, description LIMIT 40""",
)
def transactions(s):
    return ev.transaction_detail(s.facts, MONTH, "Travel", 40)


@query(
    "a7_daily_totals",
    with_("spend")
    + f"""SELECT transaction_date, strftime(transaction_date, '%A') AS day_of_week, strftime(transaction_date, '%B') AS month,
  strftime(transaction_date, '%Y') AS year, {_TOTALS} FROM spend
  WHERE transaction_month = DATE '2001-09-30' AND parent_group = 'Wants' GROUP BY ALL""",
)
def daily(s):
    return ev.daily_spending(gold.fact_daily_spending(s.facts), MONTH, parent_group="Wants")


@query(
    "a7_p13_weekly_totals",
    with_("spend")
    + f""", w AS (SELECT *, CAST(date_trunc('week', transaction_date) AS DATE) AS week_start FROM spend)
  SELECT week_start, CAST(week_start + INTERVAL 6 DAY AS DATE) AS week_end, strftime(week_start, '%G-W%V') AS iso_week,
  strftime(week_start, '%G') AS year, {_TOTALS} FROM w
  WHERE week_start + INTERVAL 6 DAY >= DATE '2001-09-01' AND week_start <= DATE '2001-09-30' GROUP BY ALL""",
)
def weekly(s):
    return ev.weekly_spending(gold.fact_weekly_spending(s.facts), MONTH)


@query(
    "p12_optional_filters",
    with_("spend") + f"SELECT transaction_date, strftime(transaction_date, '%A') AS day_of_week, "
    "strftime(transaction_date, '%B') AS month, strftime(transaction_date, '%Y') AS year, "
    f"{_TOTALS} FROM spend WHERE transaction_month = DATE '2001-09-30' AND category = 'Shopping' "
    "AND parent_group = 'Wants' GROUP BY ALL",
)
def filtered(s):
    return ev.daily_spending(gold.fact_daily_spending(s.facts), MONTH, " Shopping ", "Wants")


@query("f6_safe_divide", with_("spend") + """SELECT category, CASE WHEN sum(refund) <> 0 THEN
  CAST(sum(gross) AS DOUBLE) / CAST(sum(refund) AS DOUBLE) END AS gross_per_refund FROM spend
  WHERE transaction_month = DATE '2001-09-30' GROUP BY 1""")  # fmt: skip
def safe_divide(s):
    from outlay.functions.money import safe_ratio

    rows = _monthly(s).where(F.col("transaction_month") == F.lit("2001-09-30").cast("date")).groupBy("category")
    return rows.agg(safe_ratio(F.sum("gross_spending"), F.sum("total_refunds_and_credits")).alias("gross_per_refund"))
