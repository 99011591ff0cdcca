"""Declarative analysis: periods, grids, folding, comparisons, transforms, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.functions.categories import is_analyzed
from outlay.operators import filters, periods, series
from outlay.plans.analyze import Context, analyze, display_table, matrix
from outlay.plans.profile import distinct_counts
from outlay.plans.spec import AnalysisSpec
from outlay.queries.base import LATE_TODAY, TODAY, percent, query, with_

CTX = Context(TODAY)


def _run(s, **spec):
    return analyze(s.frame, AnalysisSpec(**spec), CTX)


def _bounds(s):
    return s.facts.agg(F.min("transaction_date").alias("data_min"), F.max("transaction_date").alias("data_max"))


# ----- periods -----

_BOUNDS = "b AS (SELECT min(transaction_date) AS lo, max(transaction_date) AS hi FROM txn)"
_COVER = """cover AS (SELECT CAST(m AS DATE) AS month, lo <= m + INTERVAL 2 DAY AND hi >= last_day(m) - INTERVAL 2 DAY
  AND DATE '{today}' > last_day(m) AS complete
  FROM b, generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH) g(m))"""


def _periods_sql(today) -> str:
    """Period dates when data reaches this month, else moved to the end of the data, one row per period."""
    t, m = f"DATE '{today}'", f"date_trunc('month', DATE '{today}')"
    q, y = f"date_trunc('quarter', DATE '{today}')", f"date_trunc('year', DATE '{today}')"
    plain = {
        "all": ("lo", "hi"),
        "this_month": (m, t),
        "last_month": (f"{m} - INTERVAL 1 MONTH", f"{m} - INTERVAL 1 DAY"),
        **{f"last_{n}_months": (f"{m} - INTERVAL {n} MONTH", f"{m} - INTERVAL 1 DAY") for n in (3, 6, 12)},
        "year_to_date": (y, t),
        "last_year": (f"{y} - INTERVAL 1 YEAR", f"{y} - INTERVAL 1 DAY"),
        "this_quarter": (q, t),
        "last_quarter": (f"{q} - INTERVAL 3 MONTH", f"{q} - INTERVAL 1 DAY"),
        "focus_month": ("date_trunc('month', hi)", "last_day(hi)"),
        "custom": ("lo", "hi"),
    }
    # The newest complete month, and how the month that closes a moved period ends.
    last = "COALESCE(latest, date_trunc('month', hi))"
    close = f"CASE WHEN latest IS NOT NULL THEN last_day(latest) ELSE least(last_day({last}), hi) END"
    newest = "date_trunc('month', hi)"
    back = "latest - to_months(CAST(month(latest) % 3 AS INTEGER))"
    moved = {
        "this_month": (newest, f"CASE WHEN {newest} = latest THEN last_day(hi) ELSE least(last_day(hi), hi) END"),
        "last_month": (last, close),
        **{f"last_{n}_months": (f"{last} - INTERVAL {n - 1} MONTH", close) for n in (3, 6, 12)},
        "year_to_date": ("date_trunc('year', hi)", "hi"),
        "this_quarter": ("date_trunc('quarter', hi)", "hi"),
        "last_quarter": (f"{back} - INTERVAL 2 MONTH", f"last_day({back})"),
    }
    rows = []
    for name, (start, end) in plain.items():
        if name in moved:
            test = f"hi < {m} AND {end} > hi"
            start = f"CASE WHEN {test} THEN CAST({moved[name][0]} AS DATE) ELSE CAST({start} AS DATE) END"
            end = f"CASE WHEN {test} THEN CAST({moved[name][1]} AS DATE) ELSE CAST({end} AS DATE) END"
        rows.append(f"SELECT '{name}' AS period, CAST({start} AS DATE) AS start, CAST({end} AS DATE) AS \"end\" FROM c")
    cover = _COVER.replace("{today}", str(today))
    pick = "c AS (SELECT lo, hi, (SELECT max(month) FROM cover WHERE complete) AS latest FROM b)"
    return f"{_BOUNDS}, {cover}, {pick}, p AS ({' UNION ALL '.join(rows)})"


@query("c1_named_periods", with_("txn") + ", " + _periods_sql(TODAY) + ' SELECT period, start, "end" FROM p')
def named_periods(s):
    return periods.all_periods(_bounds(s), TODAY).select("period", "start", "end")


@query("c2_periods_after_data_stops", with_("txn") + ", " + _periods_sql(LATE_TODAY) + ' SELECT period, start, "end" FROM p')
def late_periods(s):
    return periods.all_periods(_bounds(s), LATE_TODAY).select("period", "start", "end")


@query(
    "c1_spend_by_period",
    with_("spend")
    + ", "
    + _periods_sql(TODAY)
    + ' SELECT period, CAST(sum(spend) AS DOUBLE) AS net, count(*) AS count FROM spend JOIN p ON transaction_date '
    'BETWEEN start AND "end" GROUP BY 1',
)
def by_period(s):
    daily = s.facts.where(is_analyzed()).groupBy("transaction_date").agg(
        F.sum(-F.col("amount")).alias("net"), F.count("*").alias("count")
    )
    return periods.spend_by_period(daily, periods.all_periods(_bounds(s), TODAY)).select(
        "period", "net", F.col("count").cast("long").alias("count")
    )


@query(
    "f13_period_labels",
    with_("txn")
    + ", "
    + _periods_sql(LATE_TODAY)
    + """, whole AS (SELECT *, day(start) = 1 AND "end" = last_day("end") AS months FROM p)
  SELECT period, CASE WHEN months AND date_trunc('month', start) = date_trunc('month', "end") THEN strftime(start, '%B %Y')
    WHEN months AND year(start) = year("end") THEN strftime(start, '%b') || '–' || strftime("end", '%b %Y')
    WHEN months THEN strftime(start, '%b %Y') || '–' || strftime("end", '%b %Y')
    ELSE strftime(start, '%b %-d, %Y') || ' – ' || strftime("end", '%b %-d, %Y') END AS label FROM whole""",
)
def labels(s):
    from outlay.functions.calendar import period_text

    p = periods.all_periods(_bounds(s), LATE_TODAY)
    return p.select("period", period_text(F.col("start"), F.col("end")).alias("label"))


@query(
    "c3_month_coverage",
    with_("txn") + f", {_BOUNDS}, {_COVER.replace('{today}', str(TODAY))} SELECT month, complete FROM cover",
)
def coverage(s):
    return periods.month_coverage(_bounds(s), TODAY)


@query(
    "c4_f10_comparison_windows",
    with_("txn")
    + ", "
    + _periods_sql(TODAY)
    + """, shape AS (SELECT *, day(start) = 1 AS by_month,
      (year("end") - year(start)) * 12 + month("end") - month(start) + 1 AS n, "end" = last_day("end") AS closes FROM p),
  w AS (SELECT period, 'previous_period' AS compare_to, CASE WHEN by_month THEN n ELSE 0 END AS months,
      CASE WHEN by_month THEN 0 ELSE "end" - start + 1 END AS days, start, "end", closes FROM shape
    UNION ALL SELECT period, 'same_period_last_year', 12, 0, start, "end", closes FROM shape)
  SELECT period, compare_to, CAST(months AS BIGINT) AS months, CAST(days AS BIGINT) AS days,
    CASE WHEN months > 0 THEN CAST(start - to_months(CAST(months AS INTEGER)) AS DATE)
      ELSE CAST(start - to_days(CAST(days AS INTEGER)) AS DATE) END AS start,
    CASE WHEN months > 0 AND closes THEN last_day("end" - to_months(CAST(months AS INTEGER)))
      WHEN months > 0 THEN CAST("end" - to_months(CAST(months AS INTEGER)) AS DATE)
      ELSE CAST("end" - to_days(CAST(days AS INTEGER)) AS DATE) END AS "end" FROM w""",
)
def comparison_windows(s):
    rows = None
    p = periods.all_periods(_bounds(s), TODAY)
    for kind in ("previous_period", "same_period_last_year"):
        c = periods.comparison(F.col("start"), F.col("end"), kind)
        one = p.select(
            "period",
            F.lit(kind).alias("compare_to"),
            c.months.alias("months"),
            c.days.alias("days"),
            c.start.alias("start"),
            c.end.alias("end"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "c5_f12_custom_window",
    with_("txn") + f""", {_BOUNDS} SELECT 'reversed' AS request, DATE '1999-02-01' AS start, DATE '1999-05-31' AS "end"
  FROM b UNION ALL SELECT 'open_end', DATE '2001-03-15', hi FROM b
  UNION ALL SELECT 'beyond', greatest(DATE '1990-01-01', lo), least(DATE '2030-12-31', hi) FROM b""",
)
def custom_windows(s):
    asks = {"reversed": ("1999-05", "1999-02"), "open_end": ("2001-03-15", None), "beyond": ("1990-01", "2030-12")}
    rows = [periods.Ask("custom", low, high, key=name) for name, (low, high) in asks.items()]
    return periods.resolve(_bounds(s), TODAY, rows).select(F.col("key").alias("request"), "start", "end")


@query(
    "f11_time_points",
    with_("txn")
    + ", "
    + _periods_sql(TODAY)
    + """ SELECT period, (year("end") - year(start)) * 12 + month("end") - month(start) + 1 AS months,
  (year("end") * 4 + quarter("end")) - (year(start) * 4 + quarter(start)) + 1 AS quarters,
  datediff('week', start, "end") + 1 AS weeks FROM p""",
)
def points(s):
    from outlay.functions.calendar import time_points

    a, b = F.col("start"), F.col("end")
    return periods.all_periods(_bounds(s), TODAY).select(
        "period",
        time_points("month", a, b).alias("months"),
        time_points("quarter", a, b).alias("quarters"),
        time_points("week", a, b).alias("weeks"),
    )


@query(
    "w18_month_ranges",
    with_("fact")
    + """, m AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, sum(amount) AS total FROM fact GROUP BY 1),
  k AS (SELECT month FROM m WHERE total > 0),
  g AS (SELECT month, year(month) * 12 + month(month) - row_number() OVER (ORDER BY month) AS island FROM k)
  SELECT min(month) AS start, max(month) AS "end", count(*) AS months FROM g GROUP BY island""",
)
def month_ranges(s):
    """Ranges of months in which more came back than was spent, over all facts: other months are the gaps."""
    months = s.facts.groupBy(F.trunc("transaction_date", "month").alias("month")).agg(F.sum("amount").alias("total"))
    return periods.month_ranges(months.where("total > 0").select("month"))


# ----- tables -----

_Q = "transaction_date BETWEEN DATE '2001-07-01' AND DATE '2001-09-30'"
_HALF = "transaction_date BETWEEN DATE '2001-05-01' AND DATE '2001-10-31'"
_MONTHS6 = "g AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(TIMESTAMP '2001-05-01', TIMESTAMP '2001-10-01', INTERVAL 1 MONTH) t(m))"
_VALUES = {
    "net_spend": "CAST(sum(spend) AS DOUBLE)",
    "gross_spend": "CAST(sum(gross) AS DOUBLE)",
    "refunds": "CAST(sum(refund) AS DOUBLE)",
    "transaction_count": "count(*)",
    "avg_transaction": "CAST(sum(spend) AS DOUBLE) / CAST(count(*) AS DOUBLE)",
    "share_of_total": f"CAST(sum(spend) AS DOUBLE) / (SELECT CAST(sum(spend) AS DOUBLE) FROM spend WHERE {_Q}) * 100",
}
_SQL_DIMS = {"category": "category", "parent_group": "parent_group", "issuer": "issuer", "merchant": "merchant"}


def _metric_query(metric: str, dim: str):
    sql = with_("spend") + f"SELECT {dim}, {_VALUES[metric]} AS {metric} FROM spend WHERE {_Q} GROUP BY 1"
    if metric == "transaction_count":
        sql = sql.replace("count(*) AS", "CAST(count(*) AS DOUBLE) AS")

    @query(f"a8_{metric}_by_{dim}", sql)
    def build(s, metric=metric, dim=dim):
        return analyze(s.frame, AnalysisSpec(metric=metric, group_by=dim, period="last_quarter"), CTX, rounded=False).table


for _metric, _dim in zip(_VALUES, ("category", "parent_group", "issuer", "merchant", "category", "parent_group")):
    _metric_query(_metric, _dim)


@query(
    "x1_f8_month_by_category",
    with_("spend")
    + f""", {_MONTHS6}, c AS (SELECT DISTINCT category FROM spend WHERE {_HALF}),
  t AS (SELECT strftime(transaction_date, '%Y-%m') AS month, category, sum(spend) AS net FROM spend WHERE {_HALF} GROUP BY ALL),
  r AS (SELECT category, sum(net) AS net FROM t GROUP BY 1 ORDER BY net DESC, category LIMIT 7),
  f AS (SELECT month, CASE WHEN category IN (SELECT category FROM r) THEN category ELSE 'Other' END AS category,
    sum(net) AS net FROM t GROUP BY ALL)
  SELECT g.month, k.category, CAST(COALESCE(f.net, 0) AS DOUBLE) AS net_spend FROM g CROSS JOIN
  (SELECT DISTINCT category FROM f) k LEFT JOIN f ON f.month = g.month AND f.category = k.category""",
)
def month_by_category(s):
    """More than eight categories: the seven largest and Other."""
    return _run(s, group_by=("month", "category"), period="last_6_months").table


@query(
    "j4_c6_weekday_by_quarter_grid",
    with_("spend")
    + f""", days AS (SELECT unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun']) AS weekday, unnest(range(1, 8)) AS d),
  q AS (SELECT unnest(['2001-Q2', '2001-Q3', '2001-Q4']) AS quarter),
  t AS (SELECT isodow(transaction_date) AS d, year(transaction_date) || '-Q' || quarter(transaction_date) AS quarter,
    count(*) AS n FROM spend WHERE {_HALF} GROUP BY ALL)
  SELECT weekday, q.quarter, CAST(COALESCE(n, 0) AS BIGINT) AS transaction_count FROM days CROSS JOIN q
  LEFT JOIN t ON t.d = days.d AND t.quarter = q.quarter""",
)
def weekday_grid(s):
    return _run(s, metric="transaction_count", group_by=("weekday", "quarter"), period="last_6_months").table


@query(
    "j4_c6_weekday_by_group_grid",
    with_("spend")
    + f""", days AS (SELECT unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun']) AS weekday, unnest(range(1, 8)) AS d),
  f AS (SELECT * FROM spend WHERE {_HALF} AND abs(spend) > 90000), c AS (SELECT DISTINCT parent_group FROM f),
  t AS (SELECT isodow(transaction_date) AS d, parent_group, count(*) AS n FROM f GROUP BY ALL)
  SELECT weekday, c.parent_group, CAST(COALESCE(n, 0) AS BIGINT) AS transaction_count FROM days CROSS JOIN c
  LEFT JOIN t ON t.d = days.d AND t.parent_group = c.parent_group""",
)
def weekday_group_grid(s):
    """Large amounts alone, so that the grid has cells without a transaction."""
    return _run(s, metric="transaction_count", group_by=("weekday", "parent_group"), period="last_6_months", filters={"min_amount": 90000.01}).table


@query(
    "c6_week_and_day_of_month_grid",
    with_("spend")
    + f""", w AS (SELECT strftime(m, '%Y-%m-%d') AS week FROM generate_series(TIMESTAMP '2001-06-25', TIMESTAMP '2001-09-30',
    INTERVAL 7 DAY) t(m)), d AS (SELECT unnest(range(1, 32)) AS day_of_month),
  t AS (SELECT strftime(date_trunc('week', transaction_date), '%Y-%m-%d') AS week, day(transaction_date) AS day_of_month,
    sum(gross) AS g FROM spend WHERE {_Q} GROUP BY ALL)
  SELECT w.week, d.day_of_month, CAST(COALESCE(g, 0) AS DOUBLE) AS gross_spend FROM w CROSS JOIN d
  LEFT JOIN t ON t.week = w.week AND t.day_of_month = d.day_of_month""",
)
def week_grid(s):
    return _run(s, metric="gross_spend", group_by=("week", "day_of_month"), period="last_quarter").table


@query(
    "w9_top_merchants_fold",
    with_("spend")
    + f""", t AS (SELECT merchant, sum(spend) AS net FROM spend WHERE {_Q} GROUP BY 1),
  r AS (SELECT merchant FROM t ORDER BY net DESC, merchant LIMIT 10)
  SELECT CASE WHEN merchant IN (SELECT merchant FROM r) THEN merchant ELSE 'Other' END AS merchant,
  CAST(sum(net) AS DOUBLE) AS net_spend FROM t GROUP BY 1""",
)
def top_merchants(s):
    return _run(s, group_by="merchant", period="last_quarter", top_n=10).table


_COMPARE = """cur AS (SELECT category, sum(spend) AS v FROM spend WHERE transaction_date BETWEEN DATE '2001-10-01' AND DATE '2001-10-31' GROUP BY 1),
  prev AS (SELECT category, sum(spend) AS v FROM spend WHERE transaction_date BETWEEN DATE '2001-09-01' AND DATE '2001-09-30' GROUP BY 1)"""


@query(
    "j3_u2_previous_period_by_category",
    with_("spend")
    + f""", {_COMPARE}, j AS (SELECT COALESCE(cur.category, prev.category) AS category, COALESCE(cur.v, 0) AS a,
    COALESCE(prev.v, 0) AS b FROM cur FULL JOIN prev ON cur.category = prev.category)
  SELECT category, CAST(a AS DOUBLE) AS net_spend, CAST(b AS DOUBLE) AS comparison, CAST(a - b AS DOUBLE) AS change,
  {percent("a - b", "abs(b)", 1)} AS change_pct FROM j""",
)
def previous_period(s):
    return _run(s, group_by="category", period="last_month", compare_to="previous_period").table


@query(
    "j3_last_year_by_week",
    with_("spend")
    + """, w AS (SELECT strftime(m, '%Y-%m-%d') AS week FROM generate_series(TIMESTAMP '2001-06-25', TIMESTAMP '2001-09-30',
    INTERVAL 7 DAY) t(m)),
  cur AS (SELECT strftime(date_trunc('week', transaction_date), '%Y-%m-%d') AS week, sum(spend) AS v FROM spend
    WHERE transaction_date BETWEEN DATE '2001-07-01' AND DATE '2001-09-30' GROUP BY 1),
  prev AS (SELECT strftime(date_trunc('week', transaction_date + INTERVAL 12 MONTH), '%Y-%m-%d') AS week, sum(spend) AS v
    FROM spend WHERE transaction_date BETWEEN DATE '2000-07-01' AND DATE '2000-09-30' GROUP BY 1)
  SELECT w.week, CAST(COALESCE(cur.v, 0) AS DOUBLE) AS net_spend, CAST(COALESCE(prev.v, 0) AS DOUBLE) AS comparison,
  CAST(COALESCE(cur.v, 0) - COALESCE(prev.v, 0) AS DOUBLE) AS change, """
    + percent("COALESCE(cur.v, 0) - COALESCE(prev.v, 0)", "abs(COALESCE(prev.v, 0))", 1)
    + " AS change_pct FROM w LEFT JOIN cur USING (week) LEFT JOIN prev USING (week)",
)
def last_year(s):
    return _run(s, group_by="week", period="last_quarter", compare_to="same_period_last_year").table


_SERIES = f"""{_MONTHS6}, t AS (SELECT strftime(transaction_date, '%Y-%m') AS month, parent_group, sum(spend) AS v FROM spend
    WHERE {_HALF} GROUP BY ALL), k AS (SELECT DISTINCT parent_group FROM t),
  x AS (SELECT g.month, k.parent_group, COALESCE(t.v, 0) AS v FROM g CROSS JOIN k
    LEFT JOIN t ON t.month = g.month AND t.parent_group = k.parent_group)"""


def _transform_query(name: str, transform: str, expression: str):
    @query(
        name,
        with_("spend") + f", {_SERIES} SELECT month, parent_group, CAST(v AS DOUBLE) AS net_spend, {expression} "
        f"AS net_spend_{transform} FROM x WINDOW w AS (PARTITION BY parent_group ORDER BY month)",
    )
    def build(s):
        spec = AnalysisSpec(group_by=("month", "parent_group"), period="last_6_months", transform=transform)
        return analyze(s.frame, spec, CTX, rounded=False).table


_transform_query("w5_cumulative", "cumulative", "CAST(sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE)")
_transform_query(
    "w6_rolling_mean",
    "rolling_3",
    "CAST(lag(v, 2) OVER w + lag(v, 1) OVER w + v AS DOUBLE) / 3",
)
_transform_query(
    "w7_percent_change",
    "pct_change",
    "CASE WHEN lag(v) OVER w <> 0 THEN (CAST(v AS DOUBLE) - CAST(lag(v) OVER w AS DOUBLE)) / "
    "abs(CAST(lag(v) OVER w AS DOUBLE)) * 100 END",
)


@query(
    "w8_largest_step",
    with_("spend")
    + f""", t AS (SELECT strftime(transaction_date, '%Y-%m') AS month, sum(spend) AS v FROM spend WHERE {_HALF} GROUP BY 1),
  d AS (SELECT lag(month) OVER (ORDER BY month) AS "from", month AS "to", lag(v) OVER (ORDER BY month) AS b, v FROM t)
  SELECT "from", "to", CAST(b AS DOUBLE) AS before, CAST(v AS DOUBLE) AS after, CAST(v AS DOUBLE) - CAST(b AS DOUBLE) AS change,
  (CAST(v AS DOUBLE) - CAST(b AS DOUBLE)) / abs(CAST(b AS DOUBLE)) * 100 AS change_pct FROM d WHERE b IS NOT NULL
  ORDER BY abs(v - b) DESC, "to" LIMIT 1""",
)
def largest_step(s):
    done = analyze(s.frame, AnalysisSpec(group_by="month", period="last_6_months"), CTX, rounded=False)
    return series.largest_step(done.table, "month", "net_spend")


@query(
    "w4_share_of_total",
    with_("spend") + "SELECT merchant, CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(gross) AS DOUBLE) / "
    "(SELECT CAST(sum(gross) AS DOUBLE) FROM spend) * 100 AS share FROM spend GROUP BY 1",
)
def share(s):
    from outlay.functions.money import outflow

    sums = s.frame.where(is_analyzed()).groupBy("merchant").agg(F.sum(outflow()).alias("gross"))
    return series.share_of_total(sums, "gross", "share")


@query(
    "o6_top_weeks",
    with_("spend")
    + f"""SELECT strftime(date_trunc('week', transaction_date), '%Y-%m-%d') AS week, CAST(sum(gross) AS DOUBLE) AS gross_spend
  FROM spend WHERE {_HALF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def top_weeks(s):
    return _run(s, metric="gross_spend", group_by="week", period="last_6_months", top_n=5).table


@query(
    "o5_result_order",
    with_("spend")
    + f""", t AS (SELECT merchant, sum(spend) AS net FROM spend WHERE {_Q} GROUP BY 1),
  r AS (SELECT merchant FROM t ORDER BY net DESC, merchant LIMIT 12),
  f AS (SELECT CASE WHEN merchant IN (SELECT merchant FROM r) THEN merchant ELSE 'Other' END AS merchant, sum(net) AS net FROM t GROUP BY 1)
  SELECT merchant, row_number() OVER (ORDER BY merchant = 'Other', net DESC, merchant) AS position FROM f""",
)
def result_order(s):
    """The sorted table, numbered; a folded table has at most 26 rows."""
    from pyspark.sql import Window

    table = _run(s, group_by="merchant", period="last_quarter", top_n=12).table
    place = Window.orderBy(F.col("merchant") == "Other", F.desc("net_spend"), "merchant")
    return table.select("merchant", F.row_number().over(place).alias("position"))


_FILTERED = """category IN ('Shopping', 'Travel', 'Health & Wellness') AND category NOT IN ('Travel')
  AND parent_group IN ('Needs', 'Wants') AND issuer = 'Chase' AND lower(merchant) IN ('blue anvil', 'cold ring', 'small bolt')
  AND contains(lower(merchant), 'l') AND abs(amount) BETWEEN 5000 AND 80000"""


@query("p14_p15_all_filters", with_("spend") + f"SELECT category, parent_group, merchant, CAST(sum(spend) AS DOUBLE) AS net, "
       f"count(*) AS n FROM spend WHERE {_FILTERED} AND {_HALF} GROUP BY ALL")  # fmt: skip
def all_filters(s):
    f = AnalysisSpec(
        filters={
            "category": ["Shopping", "Travel", "Health & Wellness"],
            "exclude_category": ["Travel"],
            "parent_group": ["Needs", "Wants"],
            "issuer": "Chase",
            "merchant": ["BLUE ANVIL", "cold ring", "Small Bolt"],
            "merchant_contains": "L",
            "min_amount": 5000,
            "max_amount": 80000,
        }
    ).filters
    rows = filters.apply_filters(s.frame.where(is_analyzed()), f)
    rows = rows.where(filters.within("transaction_date", F.lit("2001-05-01").cast("date"), F.lit("2001-10-31").cast("date")))
    return rows.groupBy("category", "parent_group", "merchant").agg(F.sum("spend").alias("net"), F.count("*").alias("n"))


@query("p19_positive_rows", with_("spend") + f"SELECT category, parent_group, CAST(sum(refund) AS DOUBLE) AS refunds FROM spend "
       f"WHERE {_Q} AND merchant = 'Hot Rod' GROUP BY ALL HAVING sum(refund) > 0")  # fmt: skip
def positive(s):
    done = _run(
        s, metric="refunds", group_by=("category", "parent_group"), period="last_quarter", top_n=25,
        filters={"merchant": ["Hot Rod"]},
    )
    return filters.positive_rows(done.table, "refunds")


@query(
    "a28_distinct_values",
    with_("spend") + "SELECT count(DISTINCT merchant) AS merchants, count(DISTINCT category) AS categories, "
    "count(DISTINCT transaction_date) AS days FROM spend",
)
def distinct_values(s):
    row = distinct_counts(s.frame, ["merchant", "category", "transaction_date"])
    return row.toDF("merchants", "categories", "days")


_TOTAL = "CAST(sum(spend) AS DOUBLE)"


@query(
    "x1_o7_summary",
    with_("spend")
    + f""", t AS (SELECT merchant, sum(spend) AS v FROM spend WHERE {_HALF} GROUP BY 1),
  prev AS (SELECT sum(spend) AS v FROM spend WHERE transaction_date BETWEEN DATE '2000-11-01' AND DATE '2001-04-30'),
  a AS (SELECT sum(spend) AS v, count(*) AS n FROM spend WHERE {_HALF})
  SELECT CAST(a.v AS DOUBLE) AS total, a.n AS transactions,
  (SELECT merchant FROM t ORDER BY v DESC, merchant LIMIT 1) AS highest, (SELECT merchant FROM t ORDER BY v, merchant LIMIT 1) AS lowest,
  (SELECT string_agg(merchant, '|' ORDER BY v DESC, merchant) FROM (SELECT * FROM t ORDER BY v DESC, merchant LIMIT 5)) AS top,
  CAST(prev.v AS DOUBLE) AS comparison_total, CAST(a.v - prev.v AS DOUBLE) AS comparison_change,
  {percent("a.v - prev.v", "abs(prev.v)", 1)} AS comparison_change_pct FROM a, prev""",
)
def summary(s):
    done = _run(s, group_by="merchant", period="last_6_months", compare_to="previous_period")
    return done.summary.select(
        "total",
        "transactions",
        F.col("highest.label").alias("highest"),
        F.col("lowest.label").alias("lowest"),
        F.array_join(F.transform("top", lambda x: x["label"]), "|").alias("top"),
        F.col("comparison.total").alias("comparison_total"),
        F.col("comparison.change").alias("comparison_change"),
        F.col("comparison.change_pct").alias("comparison_change_pct"),
    )


@query(
    "f21_rounding_by_unit",
    with_("spend")
    + f"""SELECT category, count(*) AS transaction_count, CAST(sum(spend) AS DOUBLE) AS net_spend,
  {percent("sum(refund)", "sum(gross)", 1)} AS refund_pct FROM spend WHERE {_Q} GROUP BY 1""",
)
def rounding(s):
    from outlay.functions.money import by_unit, inflow, outflow

    rows = s.frame.where(is_analyzed()).where("transaction_date between date'2001-07-01' and date'2001-09-30'")
    sums = rows.groupBy("category").agg(
        F.count("*").alias("n"), F.sum("spend").alias("net"), F.sum(inflow()).alias("r"), F.sum(outflow()).alias("g")
    )
    pct = F.try_divide(F.col("r").cast("double"), F.col("g").cast("double")) * 100
    return sums.select(
        "category",
        by_unit(F.col("n"), "count").alias("transaction_count"),
        by_unit(F.col("net"), "usd").alias("net_spend"),
        by_unit(pct, "pct").alias("refund_pct"),
    )


@query(
    "x16_matrix",
    with_("spend")
    + f"""SELECT strftime(date_trunc('month', transaction_date), '%Y-%m') AS month, """
    + ", ".join(
        f"count(CASE WHEN isodow(transaction_date) = {i + 1} THEN 1 END) AS {d}"
        for i, d in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))
    )
    + f" FROM spend WHERE {_HALF} GROUP BY 1",
)
def pivoted(s):
    done = _run(s, metric="transaction_count", group_by=("month", "weekday"), period="last_6_months")
    return matrix(done.table, "month", "weekday", "transaction_count", ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])


@query(
    "x17_display_table",
    with_("spend")
    + f"""SELECT strftime(date_trunc('month', transaction_date), '%b %Y') AS "Month", strftime(transaction_date, '%A') AS "Weekday",
  CAST(sum(gross) AS DOUBLE) AS "Gross spend ($)" FROM spend WHERE {_Q} GROUP BY ALL""",
)
def shown(s):
    return display_table(_run(s, metric="gross_spend", group_by=("month", "weekday"), period="last_quarter"))
