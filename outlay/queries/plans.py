"""Snapshots, change attribution, profile, catalog, name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.functions.categories import is_analyzed
from outlay.operators import resolve, series
from outlay.plans import catalog, change, profile, snapshot
from outlay.plans.repair import repair
from outlay.plans.spec import AnalysisSpec
from outlay.queries.base import MONTH, TODAY, average, cents, half_away, percent, query, with_
from outlay.session import scratch_dir

# ----- snapshot: September 2001 against August -----

_PAIR = (
    with_("spend")
    + """, base AS (SELECT category, parent_group,
    CAST(sum(CASE WHEN transaction_month = DATE '2001-09-30' THEN spend ELSE 0 END) AS DECIMAL(24,2)) AS cur,
    CAST(sum(CASE WHEN transaction_month = DATE '2001-08-31' THEN spend ELSE 0 END) AS DECIMAL(24,2)) AS prev
  FROM spend WHERE transaction_month IN (DATE '2001-09-30', DATE '2001-08-31') GROUP BY ALL)"""
)
# A goal just above what is left over, so the shortfall must be shared.
DEPOSIT, FIXED, GOAL = 40000000.0, 1000000.0, 33000000.0
GOALS = {"Travel": 1500000.0}


def _snapshot(s, **options):
    return snapshot.month_snapshot(s.frame, MONTH, DEPOSIT, FIXED, savings_goal=GOAL, category_goals=GOALS, **options)


_HEAD = f""", h AS (SELECT sum(cur) AS total, sum(prev) AS before,
    sum(CASE WHEN parent_group = 'Wants' AND cur > 0 THEN cur ELSE 0 END) AS eligible,
    max(CASE WHEN cur > 0 THEN cur END) AS top, greatest(0, {GOAL} - ({DEPOSIT} - (sum(cur) + {FIXED}))) AS short FROM base)"""
_HEAD = _HEAD.replace(str(GOAL), f"CAST({GOAL} AS DECIMAL(24,2))").replace(
    str(DEPOSIT), f"CAST({DEPOSIT} AS DECIMAL(24,2))").replace(f"+ {FIXED}", f"+ CAST({FIXED} AS DECIMAL(24,2))")


@query(
    "x3_a10_snapshot_header",
    _PAIR
    + _HEAD
    + f""" SELECT DATE '2001-09-01' AS latest_month, DATE '2001-08-01' AS previous_month, CAST(total AS DOUBLE) AS latest_total_net_expense,
  CAST(before AS DOUBLE) AS previous_total_net_expense, {percent("total - before", "abs(before)", 2)} AS mom_change_percent,
  CAST({DEPOSIT} - total - {FIXED} AS DECIMAL(24,2))::DOUBLE AS disposable_cash, CAST(short AS DECIMAL(24,2))::DOUBLE AS savings_shortfall,
  CAST(eligible AS DOUBLE) AS eligible_discretionary_total,
  CASE WHEN short > 0 THEN 'shortfall_allocation' ELSE 'trend_maintenance' END AS goal_method,
  short > 0 AND short > eligible AS discretionary_cuts_insufficient,
  CAST(greatest(0, short - eligible) AS DECIMAL(24,2))::DOUBLE AS remaining_gap_after_cuts, CAST(top AS DOUBLE) AS max_positive_spend FROM h""",
)
def header(s):
    return _snapshot(s).header.select(
        "latest_month", "previous_month", "latest_total_net_expense", "previous_total_net_expense",
        "mom_change_percent", "disposable_cash", "savings_shortfall", "eligible_discretionary_total", "goal_method",
        "discretionary_cuts_insufficient", "remaining_gap_after_cuts", "max_positive_spend",
    )


_SHARED = f"CAST({half_away(f'{cents('cur')} * greatest(0, {cents('eligible')} - {cents('short')})', cents('eligible'))} AS DOUBLE) / 100"
_CAP = f"""CASE WHEN parent_group <> 'Wants' THEN NULL WHEN category = 'Travel' THEN {GOALS['Travel']} WHEN cur <= 0 THEN NULL
  WHEN short > 0 THEN {_SHARED} WHEN cur > prev AND prev > 0 THEN CAST(prev AS DOUBLE) ELSE CAST(cur AS DOUBLE) END"""


@query(
    "j2_f20_w16_snapshot_categories",
    _PAIR
    + _HEAD
    + f""", c AS (SELECT *, {_CAP} AS cap FROM base, h)
  SELECT category, parent_group, CAST(cur AS DOUBLE) AS current_spend, CAST(prev AS DOUBLE) AS previous_spend,
  {percent("cur - prev", "abs(prev)", 2)} AS mom_change_percent, cap AS suggested_cap,
  CASE WHEN parent_group <> 'Wants' THEN NULL WHEN category = 'Travel' THEN 'configured' WHEN cap IS NOT NULL THEN 'suggested' END AS cap_source,
  {percent("cur", "CAST(cap AS DECIMAL(24,2))", 2)} AS percent_of_cap,
  COALESCE(CASE WHEN cur > 0 THEN {percent("cur", "top", 2)} END, 0) AS bar_width_percent, cur < 0 AS is_refund,
  CASE WHEN abs(cur - prev) < 0.005 THEN 'flat' WHEN cur > prev THEN 'increase' ELSE 'decrease' END AS mom_direction FROM c""",
)
def categories(s):
    return _snapshot(s).categories.select(
        "category", "parent_group", "current_spend", "previous_spend", "mom_change_percent", "suggested_cap",
        "cap_source", "percent_of_cap", "bar_width_percent", "is_refund", "mom_direction",
    )


@query(
    "o9_notable_changes",
    _PAIR
    + f""", x AS (SELECT category, parent_group, cur, prev, cur - prev AS d, {percent("cur - prev", "abs(prev)", 2)} AS pct FROM base)
  SELECT category, parent_group, CAST(cur AS DOUBLE) AS current_spend, CAST(prev AS DOUBLE) AS previous_spend,
  CAST(d AS DOUBLE) AS change_usd, pct AS change_pct, CASE WHEN d > 0 THEN 'increase' ELSE 'decrease' END AS direction
  FROM x WHERE (prev > 0 OR cur > 0) AND abs(d) >= 0.005 AND (abs(pct) >= 20 OR abs(d) >= 300000)
  ORDER BY abs(d) DESC, category, parent_group LIMIT 5""",
)
def notable(s):
    return _snapshot(s, notable_percent=20.0, notable_usd=300000.0).notable


@query(
    "o8_p16_top_discretionary",
    _PAIR + " SELECT string_agg(category, '|' ORDER BY cur DESC, category) AS top FROM (SELECT * FROM base "
    "WHERE lower(trim(parent_group)) IN ('wants', 'discretionary', 'wants/discretionary') AND cur > 0 "
    "ORDER BY cur DESC, category LIMIT 3)",
)
def top_discretionary(s):
    return _snapshot(s).header.select(F.array_join("top_discretionary_categories", "|").alias("top"))


@query(
    "a9_x6_month_sums",
    with_("spend")
    + """SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS transaction_month, category, parent_group,
  CAST(sum(spend) AS DOUBLE) AS net_real_expense FROM spend
  WHERE transaction_month IN (DATE '2001-09-30', DATE '2001-08-31') GROUP BY ALL""",
)
def month_sums(s):
    return snapshot.month_sums(s.frame, MONTH)


@query(
    "o17_x6_shown_categories",
    _PAIR
    + _HEAD
    + f""" SELECT category, parent_group, CAST(cur AS DOUBLE) AS current_spend, CAST(prev AS DOUBLE) AS previous_spend,
  {percent("cur - prev", "abs(prev)", 2)} AS mom_change_percent, CAST(total AS DOUBLE) AS latest_total_net_expense,
  CAST(before AS DOUBLE) AS previous_total_net_expense, CAST({DEPOSIT} - total - {FIXED} AS DECIMAL(24,2))::DOUBLE AS disposable_cash
  FROM base, h ORDER BY cur DESC, category, parent_group LIMIT 12""",
)
def shown(s):
    return snapshot.shown_categories(_snapshot(s))


def _money_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-$' ELSE '$' END || format('{{:,.2f}}', CAST(abs({x}) AS DOUBLE)))"


@query(
    "x18_f19_group_lines",
    _PAIR
    + f""" SELECT parent_group, parent_group = 'Wants' AS discretionary, parent_group || ': ' || string_agg(category || ' ' ||
  {_money_sql("cur")} || CASE WHEN cur < 0 THEN ' (label as refund/credit)' ELSE '' END, ', ' ORDER BY category) || '.' AS line
  FROM base GROUP BY 1, 2""",
)
def group_lines(s):
    return snapshot.group_lines(_snapshot(s))


_PCT = percent("cur - prev", "abs(prev)", 2)


@query(
    "x18_category_lines",
    _PAIR
    + _HEAD
    + f""", c AS (SELECT *, {_CAP} AS cap, {_PCT} AS pct FROM base, h),
  t AS (SELECT *, {percent("cur", "CAST(cap AS DECIMAL(24,2))", 2)} AS share FROM c)
  SELECT category, parent_group, category || ': current ' || {_money_sql("cur")} || '; previous ' || {_money_sql("prev")} || '; MoM ' ||
  CASE WHEN pct IS NULL THEN 'no percentage (previous amount was $0.00)' WHEN abs(pct) < 0.005 THEN '0.00% (no change)'
    ELSE format('{{:.2f}}', abs(pct)) || CASE WHEN pct > 0 THEN '% increase' ELSE '% decrease' END END || '; ' ||
  CASE WHEN cap IS NULL THEN 'no cap and no percent; state why: ' || CASE WHEN parent_group = 'Wants'
      THEN 'No positive current discretionary spend to cap.' ELSE 'no cap can be calculated' END
    ELSE CASE WHEN category = 'Travel' THEN 'configured goal ' ELSE 'advisor-suggested cap ' END || {_money_sql("cap")} || '; ' ||
      CASE WHEN share IS NULL THEN 'no percent of cap; state that it does not apply because the cap is ' || {_money_sql("cap")}
        ELSE 'percent of cap ' || format('{{:.2f}}', share) || '%' END END || '.' AS line FROM t""",
)
def category_lines(s):
    return snapshot.category_lines(_snapshot(s))


@query(
    "j15_nearest_months",
    with_("fact") + "SELECT DISTINCT CAST(date_trunc('month', transaction_date) AS DATE) AS month FROM fact "
    "ORDER BY abs(month - DATE '2002-06-01'), month LIMIT 5",
)
def nearest(s):
    months = s.facts.select(F.trunc("transaction_date", "month").alias("month"))
    return snapshot.nearest_months(months, "2002-06-01")


@query(
    "w16_bar_width",
    with_("spend") + ", t AS (SELECT category, CAST(sum(spend) AS DOUBLE) AS net FROM spend GROUP BY 1) "
    "SELECT category, net, CASE WHEN net > 0 THEN net / (SELECT max(net) FROM t WHERE net > 0) * 100 ELSE 0 END AS width FROM t",
)
def width(s):
    sums = s.facts.where(is_analyzed()).groupBy("category").agg(F.sum(-F.col("amount")).cast("double").alias("net"))
    return series.bar_width(sums, "net", "width")


# ----- change attribution: Shopping, September 2001 against August -----

_CHANGE = (
    with_("spend")
    + """, r AS (SELECT upper(regexp_replace(description, '\\s+', ' ', 'g')) AS description, transaction_date, spend,
    transaction_month = DATE '2001-09-30' AS now FROM spend
    WHERE category = 'Shopping' AND transaction_month IN (DATE '2001-09-30', DATE '2001-08-31')),
  p AS (SELECT description, COALESCE(sum(spend) FILTER (now), 0) AS cur, COALESCE(sum(spend) FILTER (NOT now), 0) AS prev,
    count(*) FILTER (now) AS n1, count(*) FILTER (NOT now) AS n0 FROM r GROUP BY 1)"""
)


def _explain(s):
    return change.explain_change(s.facts, "Shopping", MONTH, 10)


_C = """t AS (SELECT count(*) FILTER (now) AS c1, count(*) FILTER (NOT now) AS c0, sum(spend) FILTER (now) AS t1,
  sum(spend) FILTER (NOT now) AS t0, max(spend) FILTER (now) AS m1, max(spend) FILTER (NOT now) AS m0 FROM r)"""


@query(
    "x4_a11_a12_a14_change_header",
    _CHANGE
    + f""", {_C} SELECT 'Shopping' AS category, c1 AS current_count, CAST(t1 AS DOUBLE) AS current_net, {average("t1", "c1")} AS current_average,
  CAST(m1 AS DOUBLE) AS current_largest, c0 AS previous_count, CAST(t0 AS DOUBLE) AS previous_net, {average("t0", "c0")} AS previous_average,
  CAST(m0 AS DOUBLE) AS previous_largest, CAST(t1 - t0 AS DOUBLE) AS change_usd, CAST({half_away(f'(c1 - c0) * {cents("t0")}', 'c0')} AS DOUBLE) / 100 AS from_transaction_count,
  CAST(t1 - t0 - CAST({half_away(f'(c1 - c0) * {cents("t0")}', 'c0')} AS DECIMAL(24,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS from_average_amount,
  c1 - c0 AS transaction_count_change, (SELECT count(*) FROM p) AS distinct_descriptions,
  (SELECT count(*) FILTER (n0 + n1 = 1) >= 0.9 * count(*) FROM p) AND c0 + c1 >= 5 AS limited FROM t""",
)
def change_header(s):
    return _explain(s).header


@query(
    "a13_by_description",
    _CHANGE + " SELECT description, CAST(cur AS DOUBLE) AS current, CAST(prev AS DOUBLE) AS previous, n1 AS current_n, "
    "n0 AS previous_n FROM p",
)
def by_description(s):
    rows = change.category_rows(s.facts, "Shopping", MONTH)
    return change.by_description(rows).select("description", "current", "previous", "current_n", "previous_n")


@query(
    "o10_increases_and_decreases",
    _CHANGE
    + """, x AS (SELECT description, CAST(cur AS DOUBLE) AS current, CAST(prev AS DOUBLE) AS previous, CAST(cur - prev AS DOUBLE) AS change FROM p)
  SELECT * FROM (SELECT 'increase' AS kind, * FROM x WHERE change >= 0.005 ORDER BY change DESC, description LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'decrease' AS kind, * FROM x WHERE change <= -0.005 ORDER BY change, description LIMIT 10)""",
)
def movers(s):
    c = _explain(s)
    up, down = c.increases, c.decreases
    return up.select(F.lit("increase").alias("kind"), "*").unionByName(down.select(F.lit("decrease").alias("kind"), "*"))


@query(
    "o11_new_descriptions",
    _CHANGE + " SELECT description, CAST(cur AS DOUBLE) AS current FROM p WHERE n1 > 0 AND n0 = 0 ORDER BY cur DESC, description LIMIT 10",
)
def new_descriptions(s):
    return _explain(s).new


@query(
    "o12_largest_transactions",
    _CHANGE + " SELECT transaction_date, description, CAST(spend AS DOUBLE) AS amount FROM r WHERE now "
    "ORDER BY spend DESC, transaction_date, description LIMIT 3",
)
def largest(s):
    return _explain(s).largest


# ----- profile -----

_DIMS = {
    "category": "category", "parent_group": "parent_group", "issuer": "issuer", "merchant": "merchant",
    "weekday": "strftime(transaction_date, '%a')", "day_of_month": "CAST(day(transaction_date) AS VARCHAR)",
    "month": "strftime(transaction_date, '%Y-%m')",
    "quarter": "year(transaction_date) || '-Q' || quarter(transaction_date)",
    "week": "strftime(date_trunc('week', transaction_date), '%Y-%m-%d')",
}
_COUNTS = ", v AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {label} AS value, count(*) AS n, sum(gross) AS gross FROM spend GROUP BY 2"
    for name, label in _DIMS.items()
) + ")"


@query("a15_value_counts", with_("spend") + _COUNTS + " SELECT dimension, value, n, CAST(gross AS DOUBLE) AS gross FROM v")
def value_counts(s):
    return profile.value_counts(s.frame)


_STATS = """, s AS (SELECT dimension, count(*) AS "distinct", median(n) AS median_per_value, min(n) AS min_per_value,
    sum(n) AS total, sum(gross) AS all_gross FROM v GROUP BY 1),
  a AS (SELECT dimension, sum(n) AS top_n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS r FROM v) WHERE r <= 10 GROUP BY 1),
  g AS (SELECT dimension, sum(gross) AS top_gross FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY gross DESC, value) AS r FROM v) WHERE r <= 10 GROUP BY 1)"""


@query(
    "x5_profile_statistics",
    with_("spend")
    + _COUNTS
    + _STATS
    + """ SELECT dimension, "distinct", median_per_value, min_per_value, CAST(top_n AS DOUBLE) / CAST(total AS DOUBLE) AS top10_transaction_share,
  CAST(top_gross AS DOUBLE) / CAST(all_gross AS DOUBLE) AS top10_spend_share FROM s JOIN a USING (dimension) JOIN g USING (dimension)""",
)
def statistics(s):
    return profile.profile(s.frame, TODAY).drop("status", "reason", "top_values")


@query(
    "x5_profile_status",
    with_("spend")
    + _COUNTS
    + _STATS
    + """, j AS (SELECT *, CAST(top_n AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM s JOIN a USING (dimension))
  SELECT dimension, CASE
    WHEN dimension IN ('category', 'parent_group', 'issuer', 'merchant') THEN CASE WHEN "distinct" < 2 THEN 'unusable'
      WHEN median_per_value < 3 OR ("distinct" > 10 AND share < 0.4) THEN 'limited' ELSE 'usable' END
    WHEN dimension = 'weekday' THEN CASE WHEN "distinct" < 2 THEN 'unusable' WHEN median_per_value < 3 THEN 'limited' ELSE 'usable' END
    WHEN dimension = 'day_of_month' THEN CASE WHEN median_per_value < 2 THEN 'limited' ELSE 'usable' END
    WHEN dimension = 'week' THEN CASE WHEN "distinct" >= 4 THEN 'usable' WHEN "distinct" >= 2 THEN 'limited' ELSE 'unusable' END
    WHEN dimension = 'quarter' THEN CASE WHEN "distinct" >= 2 THEN 'usable' ELSE 'unusable' END
    ELSE 'usable' END AS status FROM j""",
)
def status(s):
    return profile.profile(s.frame, TODAY).select("dimension", "status")


@query(
    "c3_coverage_row",
    with_("spend")
    + """, b AS (SELECT min(transaction_date) AS lo, max(transaction_date) AS hi, count(*) AS n FROM spend)
  SELECT n AS transactions, lo AS data_min, hi AS data_max, '2001-10' AS latest_complete_month,
  DATE '2001-11-15' - hi AS data_end_lag_days FROM b""",
)
def coverage_row(s):
    row = profile.coverage(s.frame, TODAY)
    return row.select("transactions", "data_min", "data_max", "latest_complete_month", "data_end_lag_days")


@query("a16_type_counts", with_("fact") + "SELECT transaction_type, count(*) AS n FROM fact GROUP BY 1")
def types(s):
    return profile.type_counts(s.facts)


# ----- catalog and names -----


@query(
    "x7_a17_catalog",
    with_("spend")
    + """, b AS (SELECT min(transaction_date) AS lo, max(transaction_date) AS hi FROM fact),
  m AS (SELECT merchant, sum(spend) AS v FROM spend GROUP BY 1 ORDER BY v DESC, merchant LIMIT 30)
  SELECT strftime(lo, '%Y-%m-%d') AS date_min, strftime(hi, '%Y-%m-%d') AS date_max,
  (year(hi) - year(lo)) * 12 + month(hi) - month(lo) + 1 AS months, (SELECT count(*) FROM spend) AS transactions,
  (SELECT string_agg(DISTINCT issuer, '|' ORDER BY issuer) FROM spend) AS issuers,
  (SELECT string_agg(DISTINCT parent_group, '|' ORDER BY parent_group) FROM spend) AS parent_groups,
  (SELECT string_agg(merchant, '|' ORDER BY v DESC, merchant) FROM m) AS merchants,
  (SELECT count(DISTINCT merchant) FROM spend) AS merchant_count,
  (SELECT string_agg(DISTINCT category, '|' ORDER BY category) FROM spend) AS categories FROM b""",
)
def catalog_row(s):
    lists = ("issuers", "parent_groups", "merchants")
    return catalog.catalog(s.frame).select(
        "date_min", "date_max", "months", "transactions", "merchant_count",
        *[F.array_join(c, "|").alias(c) for c in lists],
        F.array_join(F.map_keys("categories"), "|").alias("categories"),
    )


@query(
    "a17_category_groups",
    with_("spend") + "SELECT category, string_agg(DISTINCT parent_group, '|' ORDER BY parent_group) AS parent_groups "
    "FROM spend GROUP BY 1",
)
def category_groups(s):
    return catalog.category_groups(s.frame).select("category", F.array_join("parent_groups", "|").alias("parent_groups"))


@query("a18_merchants_by_spend", with_("spend") + "SELECT merchant, CAST(sum(spend) AS DOUBLE) AS spend FROM spend GROUP BY 1")
def merchants(s):
    return catalog.merchants_by_spend(s.frame)


@query("a18_months_present", with_("fact") + "SELECT DISTINCT strftime(transaction_date, '%Y-%m') AS month FROM fact")
def months(s):
    return catalog.months_present(s.facts)


@query(
    "o16_list_values",
    with_("spend")
    + """, t AS (SELECT merchant AS value, sum(spend) AS v FROM spend GROUP BY 1 HAVING contains(lower(merchant), 'old'))
  SELECT value, (SELECT count(*) FROM t) AS total_matches FROM t ORDER BY v DESC, value LIMIT 10""",
)
def values(s):
    return catalog.list_values(s.frame, "merchant", "OLD", 10)


WANTED = ["blue anvil", "Gizmo", "small rign", "anvl blue", "hot ro", "qqqq", "Large"]


@query(
    "j9_exact_or_containing",
    with_("spend")
    + """, m AS (SELECT DISTINCT merchant AS value FROM spend),
  w AS (SELECT unnest(['blue anvil', 'Gizmo', 'small rign', 'anvl blue', 'hot ro', 'qqqq', 'Large']) AS wanted)
  SELECT wanted, min(value) FILTER (lower(value) = lower(wanted)) AS exact, count(*) FILTER (contains(lower(value), lower(wanted))) AS containing,
  min(value) FILTER (contains(lower(value), lower(wanted))) AS first_containing FROM w JOIN m ON contains(lower(value), lower(wanted))
  GROUP BY 1""",
)
def exact(s):
    return resolve.exact_or_containing(WANTED, s.merchant_names)


# The block ratio of every request and merchant: equal cells, stretches along diagonals, and parts around the longest stretch.
_RATIOS = (
    with_("spend").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", m AS (SELECT DISTINCT merchant AS value, lower(merchant) AS low FROM spend),
  w AS (SELECT wanted, lower(wanted) AS key FROM (SELECT unnest({WANTED}) AS wanted)),
  p AS (SELECT wanted, key, value, low, length(low) AS la, length(key) AS lb FROM w, m),
  equal AS (SELECT wanted, low, i, j FROM p, unnest(range(la)) AS a(i), unnest(range(lb)) AS b(j) WHERE substr(low, i + 1, 1) = substr(key, j + 1, 1)),
  islands AS (SELECT *, i - row_number() OVER (PARTITION BY wanted, low, j - i ORDER BY i) AS island FROM equal),
  cells AS (SELECT wanted, low, i, j, row_number() OVER (PARTITION BY wanted, low, j - i, island ORDER BY i DESC) AS k FROM islands),
  parts AS (SELECT wanted, low, CAST(0 AS BIGINT) AS i0, CAST(la AS BIGINT) AS i1, CAST(0 AS BIGINT) AS j0, CAST(lb AS BIGINT) AS j1, CAST(0 AS BIGINT) AS matched FROM p
    UNION ALL
    SELECT wanted, low, CASE side WHEN 0 THEN i0 ELSE i + n END, CASE side WHEN 0 THEN i ELSE i1 END,
      CASE side WHEN 0 THEN j0 ELSE j + n END, CASE side WHEN 0 THEN j ELSE j1 END, CASE side WHEN 0 THEN n ELSE 0 END
    FROM (SELECT s.*, c.i, c.j, least(c.k, s.i1 - c.i, s.j1 - c.j) AS n FROM parts s JOIN cells c ON c.wanted = s.wanted AND c.low = s.low
      AND c.i >= s.i0 AND c.i < s.i1 AND c.j >= s.j0 AND c.j < s.j1
      QUALIFY row_number() OVER (PARTITION BY s.wanted, s.low, s.i0, s.j0, s.i1, s.j1 ORDER BY least(c.k, s.i1 - c.i, s.j1 - c.j) DESC, c.i, c.j) = 1), (VALUES (0), (1)) AS t(side)),
  ratios AS (SELECT p.wanted, p.value, p.low, p.key, CAST(2 * sum(matched) AS DOUBLE) / (la + lb) AS ratio FROM p JOIN parts USING (wanted, low) GROUP BY p.wanted, p.value, p.low, p.key, la, lb)"""
)


@query(
    "j9_f30_match_values",
    _RATIOS
    + """, r AS (SELECT wanted, min(value) FILTER (low = key) AS exact, count(*) FILTER (contains(low, key)) AS containing,
    min(value) FILTER (contains(low, key)) AS one, arg_max(value, (ratio, low)) FILTER (ratio >= 0.6) AS close FROM ratios GROUP BY 1)
  SELECT wanted, COALESCE(exact, CASE WHEN containing = 1 THEN one END, close) AS resolved,
  CASE WHEN exact IS NOT NULL THEN 'exact' WHEN containing = 1 THEN 'contains' WHEN close IS NOT NULL THEN 'close' END AS how FROM r""",
)
def matched(s):
    return resolve.match_values(WANTED, s.merchant_names)


@query(
    "j10_f30_closest",
    _RATIOS
    + " SELECT wanted, value, ratio, CAST(row_number() OVER (PARTITION BY wanted ORDER BY ratio DESC, low DESC) AS INTEGER) AS place FROM ratios QUALIFY place <= 5",
)
def closest(s):
    """The letters of the names are indexed in a table of their own first, as a service would keep them."""
    names, folder = s.merchant_names, scratch_dir(s.spark, "names")
    resolve.name_index(names).write.partitionBy("kind").parquet(folder)
    return resolve.closest(WANTED, names, index=s.spark.read.parquet(folder))


@query(
    "x2_repaired_analysis",
    with_("spend")
    + """, t AS (SELECT merchant, sum(spend) AS v FROM spend WHERE category = 'Travel' AND contains(lower(merchant), 'gizmo')
    AND transaction_date BETWEEN DATE '2001-07-01' AND DATE '2001-09-30' GROUP BY 1)
  SELECT merchant, CAST(v AS DOUBLE) AS net_spend FROM t""",
)
def repaired(s):
    """A misspelt category and an ambiguous merchant, put right and run."""
    from outlay.plans.analyze import Context, analyze

    asked = AnalysisSpec(
        group_by="merchant", filters={"category": "travle", "merchant": "gizmo"}, date_from="2001-07", date_to="2001-09"
    )
    spec, _ = repair(asked, s.frame, TODAY)
    return analyze(s.frame, spec, Context(TODAY)).table
