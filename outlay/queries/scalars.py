"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.functions import calendar as cal
from outlay.functions import identity, merchants, money, text
from outlay.queries.base import percent, query, with_

_STATES = "|".join(merchants.STATES.split())
# The descriptor rules as one nested replacement, innermost first.
_RAW = "trim(regexp_replace(upper(COALESCE(description, '')), '\\s+', ' ', 'g'))"


def _nest(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


def _tidy(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


_EDGE = "' -.,/:;''\"&+'"
_M = _nest(_RAW, ("(?i)(?:https?://|www\\.)\\S*", " "))
_M = _tidy(_nest(_M, ("^(?:(?:SQ|TST|PY|PP|PAYPAL|SP)\\s*\\*\\s*|SP\\s+)", "")))
_M = f"CASE WHEN regexp_matches({_M}, '^(?:AMZN\\b|AMAZON(?:\\.COM|\\s+MKTP|\\s+MKTPL|\\s+MKTPLACE|\\s+MARKETPLACE)\\b)') THEN 'AMAZON' ELSE {_M} END"
_M = _nest(
    _M,
    ("\\(?\\b\\d{3}\\)?[-. ]\\d{3}[-. ]\\d{4}\\b|\\b\\d{10}\\b", " "),
    ("(?:\\b(?:STORE|STR|NO|NUM)\\s*)?#\\s*\\d+|\\b(?:STORE|STR)\\s+\\d+\\b", " "),
    ("\\b[A-Z]?-?\\d{3,}\\b", " "),
)
_M = _tidy(_nest(_M, ("[\\[\\]()!<>*_`{}|\\\\]", " ")))
_M = f"trim({_tidy(_nest(_M, ('(?:\\s+(?:STORE|STR|NO|NUM|#))+\\s*$', '')))}, {_EDGE})"
_M = f"trim({_tidy(_nest(_M, (f' (?:{_STATES})$', '')))}, {_EDGE})"
_M = f"trim({_tidy(_nest(_M, ('(?:\\s+(?:STORE|STR|NO|NUM|#))+\\s*$', '')))}, {_EDGE})"
_TITLE = "array_to_string(list_transform(string_split(lower(m), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(
    "f14_merchant_names",
    with_("descriptors")
    + f""", d AS (SELECT p_partkey, description, {_RAW} AS raw, {_M} AS m FROM descriptors)
  SELECT p_partkey, CASE WHEN raw = '' THEN 'Unknown'
    WHEN regexp_matches(raw, 'THANK\\s*YOU|\\bAUTOPAY\\b|\\bAUTOMATIC PAYMENT\\b|^(?:ONLINE |MOBILE |ELECTRONIC |INTERNET )?PAYMENT\\b') THEN 'Card Payment'
    WHEN regexp_matches(raw, '\\bSTATEMENT CREDIT\\b|\\bCREDIT\\s*$') THEN 'Card Credit'
    WHEN m = '' THEN 'Unknown' ELSE {_TITLE} END AS merchant FROM d""",
)
def merchant_names(s):
    return s.descriptors.select("p_partkey", merchants.merchant_name("description").alias("merchant"))


ALIASES = {"small": "Small Things", "small ring": "Tiny Ring", "BLUE ANVIL": "<b>Blue</b>", "cold": "Cold Co"}


@query(
    "f15_aliases",
    """SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 'Tiny Ring' WHEN p_name LIKE 'small %' THEN 'Small Things'
  WHEN p_name = 'blue anvil' THEN 'b Blue /b' WHEN p_name LIKE 'cold %' THEN 'Cold Co'
  ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS merchant FROM part""",
)
def aliases(s):
    described = F.concat(F.upper("p_name"), F.lit(" #"), F.col("p_partkey") + 100)
    return s.table("part").select("p_partkey", merchants.merchant_name(described, ALIASES).alias("merchant"))


_LABEL = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)(?:https?://|www\\.)\\S*', ' ', 'g'), '[\\[\\]()!<>*_`{{}}|\\\\]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("f16_clean_labels", with_("descriptors") + f"SELECT p_partkey, trim(({_LABEL.format(x='description')})[1:12]) AS label FROM descriptors")
def labels(s):
    return s.descriptors.select("p_partkey", merchants.clean_label("description", 12).alias("label"))


@query(
    "f17_description_keys",
    with_("descriptors")
    + """SELECT p_partkey, COALESCE(nullif(rtrim(upper(trim(regexp_replace(description || '  ' || description, '\\s+', ' ', 'g')))[1:40]), ''),
  '(NO DESCRIPTION)') AS key FROM descriptors""",
)
def description_keys(s):
    twice = F.concat("description", F.lit("  "), "description")
    return s.descriptors.select("p_partkey", merchants.description_key(twice).alias("key"))


@query(
    "f18_amounts_in_text",
    """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) * 1000 + CAST(o_orderkey AS DOUBLE) + CAST(o_custkey % 7 AS DOUBLE) * 1000000 AS amount,
  2.0::DOUBLE + CAST(o_custkey AS DOUBLE) AS with_comma FROM orders""",
)
def amounts(s):
    """A comma ends a number, so $2,000000007 reads as 2 and 7."""
    words = F.concat(
        F.lit("pay "), F.col("o_custkey"), F.lit("k and "), F.col("o_orderkey"), F.lit(" then "), F.col("o_custkey") % 7, F.lit(" M")
    )
    return s.table("orders").select(
        "o_orderkey",
        money.amounts_in_text(words).alias("amount"),
        money.amounts_in_text(F.concat(F.lit("$2,"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("with_comma"),
    )


@query(
    "f19_money_text",
    """SELECT c_custkey, CASE WHEN x < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', CAST(abs(x) AS DOUBLE)) AS shown
  FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) * CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE -1 END AS x FROM customer)""",
)
def money_text(s):
    x = F.col("c_acctbal").cast("decimal(18,2)") * F.when(F.col("c_custkey") % 2 == 0, 100).otherwise(-1)
    return s.table("customer").select("c_custkey", money.money_text(x).alias("shown"))


_CHANGE = "SELECT l.*, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(l_tax * 100000 AS DECIMAL(18,2)) AS b FROM lineitem l"


@query(
    "f20_change_percent_and_direction",
    f"""SELECT direction, pct IS NULL AS none, count(*) AS n, CAST(sum(CAST(pct AS DECIMAL(24,2))) AS DOUBLE) AS total FROM (
  SELECT {percent("a - b", "abs(b)", 2)} AS pct, CASE WHEN b = 0 THEN 'no_prior' WHEN abs(a - b) < 0.005 THEN 'flat' WHEN a > b THEN 'increase'
    ELSE 'decrease' END AS direction FROM ({_CHANGE})) GROUP BY ALL""",
)
def change_percent(s):
    a, b = F.col("l_extendedprice").cast("decimal(18,2)"), (F.col("l_tax") * 100000).cast("decimal(18,2)")
    rows = s.table("lineitem").select(
        money.percent_change(a, b).alias("pct"), money.change_direction(a, b, b != 0).alias("direction")
    )
    return rows.groupBy("direction", F.col("pct").isNull().alias("none")).agg(
        F.count("*").alias("n"), F.sum(F.col("pct").cast("decimal(24,2)")).alias("total")
    )


@query(
    "f19_percent_text",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN pct IS NULL THEN 'no percentage (previous amount was $0.00)' WHEN abs(pct) < 0.005 THEN '0.00% (no change)'
  ELSE format('{{:.2f}}', abs(pct)) || CASE WHEN pct > 0 THEN '% increase' ELSE '% decrease' END END AS shown, count(*) AS n
  FROM (SELECT l_orderkey, l_linenumber, {percent("a - b", "abs(b)", 2)} AS pct FROM ({_CHANGE})) GROUP BY ALL""",
)
def percent_text(s):
    a, b = F.col("l_extendedprice").cast("decimal(18,2)"), (F.col("l_tax") * 100000).cast("decimal(18,2)")
    # The change is a column first: its text asks for it several times.
    rows = s.table("lineitem").select("l_orderkey", "l_linenumber", money.percent_change(a, b).alias("pct"))
    shown = money.percent_text(F.col("pct"), F.lit("increase"))
    return rows.groupBy("l_orderkey", "l_linenumber", shown.alias("shown")).agg(F.count("*").alias("n"))


@query(
    "f5_signed_parts_and_rounding",
    with_("fact") + """SELECT issuer, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS gross,
  CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS refunds, CAST(sum(-amount) AS DOUBLE) AS net,
  CAST(round(sum(amount) / 1, 0) AS DOUBLE) AS whole FROM fact GROUP BY 1""".replace("round(sum(amount) / 1, 0)", "round(sum(amount), 0)"),
)
def signed(s):
    return s.facts.groupBy("issuer").agg(
        F.sum(money.outflow()).alias("gross"),
        F.sum(money.inflow()).alias("refunds"),
        F.sum(money.spend()).alias("net"),
        F.round(F.sum("amount"), 0).alias("whole"),
    )


@query(
    "f3_f4_f8_date_labels",
    """SELECT o_orderdate AS day, strftime(o_orderdate, '%B') AS month_name, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%A') AS weekday_name,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter,
  strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, strftime(o_orderdate, '%a') AS weekday, day(o_orderdate) AS day_of_month
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS o_orderdate FROM orders)""",
)
def date_labels(s):
    d = F.col("day")
    days = s.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(
        "day",
        cal.month_name(d).alias("month_name"),
        cal.year_text(d).alias("year"),
        cal.weekday_name(d).alias("weekday_name"),
        cal.week_start(d).alias("week_start"),
        *[cal.dimension_label(n, d).alias(n) for n in ("month", "quarter", "week", "weekday", "day_of_month")],
    )


@query(
    "f10_month_shift",
    "SELECT day, " + ", ".join(f"CAST(day + INTERVAL ({n}) MONTH AS DATE) AS {name}" for n, name in ((1, "one"), (-3, "back_three"), (12, "year")))
    + " FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
)
def shifted(s):
    days = s.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", *[F.add_months("day", n).alias(name) for n, name in ((1, "one"), (-3, "back_three"), (12, "year"))])


@query(
    "f12_f13_month_text",
    """SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, last_day(o_orderdate) AS last,
  strftime(o_orderdate, '%B %Y') AS shown, strftime(o_orderdate, '%b %Y') AS short FROM orders""",
)
def month_text(s):
    months = s.table("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    m = F.col("month")
    return months.select(
        "month",
        cal.date_from_text(m).alias("first"),
        cal.date_from_text(m, end=True).alias("last"),
        cal.month_text(m).alias("shown"),
        cal.friendly_label("month", m).alias("short"),
    )


@query(
    "f1_transaction_keys",
    with_("fact") + "SELECT issuer, count(DISTINCT md5(issuer || '_' || CAST(transaction_date AS VARCHAR) || '_' || COALESCE(description, '') || '_' || "
    "regexp_replace(CAST(CAST(amount AS DECIMAL(38,9)) AS VARCHAR), '\\.?0+$', ''))) AS keys, count(*) AS n FROM fact GROUP BY 1",
)
def transaction_keys(s):
    return s.facts.groupBy("issuer").agg(F.count_distinct(identity.transaction_key()).alias("keys"), F.count("*").alias("n"))


@query(
    "f22_hashed_identity",
    "SELECT c_custkey, sha256('email:' || c_name) AS internal_id, sha256(c_name) AS hashed FROM customer",
)
def hashed(s):
    return s.table("customer").select(
        "c_custkey", identity.thread_key(F.lit("email"), F.col("c_name")).alias("internal_id"), identity.hashed_key("c_name").alias("hashed")
    )


_TIDY = "trim(regexp_replace(text, '[\\s\\x{0b}\\x{85}\\x{a0}\\x{2028}\\x{2029}]+', ' ', 'g'))"


@query(
    "f35_clip",
    f"SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE rtrim(t[1:199]) || '…' END AS clipped FROM (SELECT doc_id, {_TIDY} AS t FROM documents)",
)
def clipped(s):
    return s.table("documents").select("doc_id", text.clip("text", 200).alias("clipped"))


@query(
    "f35_head_and_tail",
    """SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE regexp_replace(t[1:300], '\\s+$', '') || chr(10) || '[...]' || chr(10) || regexp_replace(t[length(t) - 192:], '^\\s+', '') END AS excerpt
  FROM (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> ''), chr(10)) AS t FROM documents)""",
)
def excerpt(s):
    return s.table("documents").select("doc_id", text.head_tail("text", 500).alias("excerpt"))
