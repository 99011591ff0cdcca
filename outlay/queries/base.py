"""Query registry and shared check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions.categories import (
    CATEGORY_DEFAULT,
    CATEGORY_RULES,
    GROUP_DEFAULT,
    GROUP_RULES,
)
from outlay.sources import sample
from outlay.sources.sample import Sample, check_sql

# Data current, and data that stopped before this month.
TODAY = date(2001, 11, 15)
LATE_TODAY = date(2002, 2, 10)
MONTH = date(2001, 9, 1)


@dataclass(frozen=True)
class Entry:
    build: Callable[[Sample], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under ``name`` with its check SQL; None where SQL cannot express it."""

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(build, sql.strip() if sql else None)
        return build

    return add


def run(entry: Entry, spark: SparkSession, path: str) -> DataFrame:
    return comparable(entry.build(Sample(spark, path)))


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as double and integers as long, so both engines report the same types."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


# ----- check SQL pieces -----


def _case(rules, default: str, raw: str = "raw_category") -> str:
    whens = []
    for name, prefixes, names in rules:
        tests = [f"{raw} LIKE '{p}%'" for p in prefixes]
        if names:
            tests.append(f"{raw} IN (" + ", ".join(f"'{n}'" for n in names) + ")")
        whens.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(whens) + f" ELSE '{default}' END"


CATEGORY = _case(CATEGORY_RULES, CATEGORY_DEFAULT)
GROUP = _case(GROUP_RULES, GROUP_DEFAULT)
ANALYZED = "transaction_type IN ('Sale', 'Return', 'Adjustment')"


def half_away(top: str, bottom: str) -> str:
    """Whole-number division rounded half away from zero."""
    t, b = f"CAST({top} AS HUGEINT)", f"CAST({bottom} AS HUGEINT)"
    return f"(CASE WHEN {t} < 0 THEN -1 ELSE 1 END * ((2 * abs({t}) + {b}) // (2 * {b})))"


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def average(total: str, count: str) -> str:
    """Exact two-place average of a two-place total."""
    return f"CASE WHEN ({count}) > 0 THEN CAST({half_away(cents(total), count)} AS DOUBLE) / 100 END"


def percent(top: str, bottom: str, places: int) -> str:
    """100 * top / bottom rounded half away from zero, for two-place inputs; null on 0."""
    t = f"{cents(top)} * {100 * 10**places}"
    sign = f"(CASE WHEN ({bottom}) < 0 THEN -1 ELSE 1 END)"
    return (
        f"CASE WHEN ({bottom}) <> 0 THEN CAST({half_away(f'({t}) * {sign}', f'abs({cents(bottom)})')} AS DOUBLE)"
        f" / {10**places} END"
    )


CTES = {
    "lines": check_sql(sample.CARD_LINES),
    "txn": check_sql(sample.TRANSACTIONS),
    "raw": check_sql(sample.RAW_LINES),
    "trace": check_sql(sample.TRACE),
    "ledger": check_sql(sample.LEDGER),
    "findings": check_sql(sample.FINDINGS),
    "runs": check_sql(sample.RUNS),
    "descriptors": check_sql(sample.DESCRIPTORS),
    "narratives": check_sql(sample.NARRATIVES),
    "known": check_sql(sample.KNOWN_NUMBERS),
    "fact": f"SELECT *, last_day(transaction_date) AS transaction_month, {CATEGORY} AS category, "
    f"{GROUP} AS parent_group FROM txn",
    "spend": f"SELECT *, -amount AS spend, CASE WHEN amount < 0 THEN -amount ELSE 0 END AS gross, "
    f"CASE WHEN amount > 0 THEN amount ELSE 0 END AS refund, "
    f"list_aggregate(list_transform(string_split(lower(regexp_replace(description, ' #.*', '')), ' '), "
    f"lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS merchant FROM fact WHERE {ANALYZED}",
    "monthly": "SELECT transaction_month, category, parent_group, sum(gross) AS gross_spending, "
    "sum(refund) AS total_refunds_and_credits, sum(spend) AS net_real_expense, "
    "count(*) AS total_transaction_count FROM spend GROUP BY ALL",
}
NEEDS = {"fact": ("txn",), "spend": ("txn", "fact"), "monthly": ("txn", "fact", "spend")}


def with_(*names: str) -> str:
    """WITH clause of the named pieces and what they need."""
    order: list[str] = []
    for name in names:
        for part in (*NEEDS.get(name, ()), name):
            if part not in order:
                order.append(part)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order) + "\n"


D = "DOUBLE"


def dbl(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"
