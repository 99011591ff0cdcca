"""Named periods as date expressions.

Everything follows from one row: today, the first and the last data day.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions import calendar as cal

# The named periods, and those that move to the end of the data when it stops early.
PERIODS = (
    "all", "this_month", "last_month", "last_3_months", "last_6_months", "last_12_months",
    "year_to_date", "last_year", "this_quarter", "last_quarter", "focus_month", "custom",
)
RELATIVE = (
    "this_month", "last_month", "last_3_months", "last_6_months", "last_12_months",
    "year_to_date", "this_quarter", "last_quarter",
)
# Fixed value: a month is complete when data starts and ends within this many days of its edges and it is over.
EDGE_DAYS = 2


@dataclass(frozen=True)
class Period:
    start: Column
    end: Column
    label: Column
    notes: Column


def is_complete(month: Column, data_min: Column, data_max: Column, today: Column) -> Column:
    """Whether the month starting at ``month`` is covered by the data and over."""
    last = F.last_day(month)
    return (
        (data_min <= F.date_add(month, EDGE_DAYS)) & (data_max >= F.date_sub(last, EDGE_DAYS)) & (today > last)
    )


def latest_complete_month(data_min: Column, data_max: Column, today: Column) -> Column:
    """First day of the newest complete month, or null. Only the edge months can be partial, so no list is built."""
    newest = cal.month_start(data_max)
    newest = F.when(data_max >= F.date_sub(F.last_day(data_max), EDGE_DAYS), newest).otherwise(
        F.add_months(newest, -1)
    )
    month = F.least(newest, F.add_months(cal.month_start(today), -1))
    return F.when(is_complete(month, data_min, data_max, today), month)


def month_coverage(bounds: DataFrame, today) -> DataFrame:
    """One row per month touched by (data_min, data_max), with ``complete``."""
    lo, hi = F.col("data_min"), F.col("data_max")
    months = F.sequence(cal.month_start(lo), cal.month_start(hi), F.expr("interval 1 month"))
    rows = bounds.where(lo <= hi).select(lo, hi, F.explode(months).alias("month"))
    return rows.select("month", is_complete(F.col("month"), lo, hi, cal.day(today)).alias("complete"))


def custom_window(date_from: str | None, date_to: str | None, data_min: Column, data_max: Column):
    """(start, end, swapped) of explicit dates; YYYY-MM covers the whole month, reversed dates are swapped."""
    first, last = F.lit(date_from), F.lit(date_to)
    swapped = F.lit(False)
    if date_from and date_to:
        swapped = cal.date_from_text(first) > cal.date_from_text(last, end=True)
    low = F.when(swapped, last).otherwise(first)
    high = F.when(swapped, first).otherwise(last)
    start = cal.date_from_text(low) if date_from else data_min
    end = cal.date_from_text(high, end=True) if date_to else data_max
    return start, end, swapped


def _span(low: Column, high: Column) -> Column:
    return F.concat(cal.day_text(low), F.lit(" – "), cal.day_text(high))


@dataclass(frozen=True)
class Ask:
    """One period request; dates matter for custom and focus_month only."""

    period: str
    date_from: str | None = None
    date_to: str | None = None
    focus_month: date | None = None
    key: str | None = None

    def __post_init__(self):
        if self.period not in PERIODS:
            raise ValueError(f"unknown period {self.period!r}")


def _asked(ask: Ask) -> tuple[Column, Column, str | None, Column]:
    """(start, end, name, swapped) of a request while the data reaches today."""
    period, month, quarter, today = ask.period, F.col("_month"), F.col("_quarter"), F.col("_today")
    year, yesterday, no = F.trunc(today, "year"), F.date_sub(month, 1), F.lit(False)
    if period == "all":
        return F.col("_lo"), F.col("_hi"), "all data", no
    if period == "this_month":
        return month, today, "month to date", no
    if period == "last_month":
        return F.add_months(month, -1), yesterday, None, no
    if period.endswith("_months"):
        count = int(period.split("_")[1])
        return F.add_months(month, -count), yesterday, f"last {count} months", no
    if period == "year_to_date":
        return year, today, "year to date", no
    if period == "last_year":
        return F.add_months(year, -12), F.date_sub(year, 1), None, no
    if period == "this_quarter":
        return quarter, today, "quarter to date", no
    if period == "last_quarter":
        return F.add_months(quarter, -3), F.date_sub(quarter, 1), "last quarter", no
    if period == "focus_month":
        anchor = F.col("_hi") if ask.focus_month is None else cal.day(ask.focus_month)
        if ask.date_from:
            anchor = cal.date_from_text(F.lit(ask.date_from))
        return cal.month_start(anchor), F.last_day(anchor), "focus month", no
    start, end, swapped = custom_window(ask.date_from, ask.date_to, F.col("_lo"), F.col("_hi"))
    return start, end, None, swapped


def _moved(period: str) -> tuple[Column, Column, Column, str | None]:
    """(possible, start, end, name) of a relative period that ends with the data."""
    yes, hi, newest = F.lit(True), F.col("_hi"), F.col("_newest")
    last, close, latest = F.col("_last"), F.col("_close"), F.col("_latest")
    if period == "this_month":
        whole = F.when(newest == latest, F.last_day(newest)).otherwise(F.least(F.last_day(newest), hi))
        return yes, newest, whole, "latest month with data"
    if period == "last_month":
        return yes, last, close, None
    if period.endswith("_months"):
        count = int(period.split("_")[1])
        return yes, F.add_months(last, 1 - count), close, f"last {count} months"
    if period == "year_to_date":
        return yes, F.trunc(hi, "year"), hi, "year to date"
    if period == "this_quarter":
        return yes, cal.quarter_start(hi), hi, "latest quarter with data"
    if period == "last_quarter":
        return F.col("_quarter_is_whole"), F.col("_quarter_first"), F.last_day("_quarter_last"), "last quarter"
    return F.lit(False), F.lit(None), F.lit(None), None


def resolve(bounds: DataFrame, today, asks: list[Ask]) -> DataFrame:
    """(key, period, start, end, label, notes) of every request, from a one-row (data_min, data_max) table.

    "Last N months" are whole months before the current one; to-date periods end today. When the data stops before
    this month, relative periods end with the data instead. Each step is a projection over the one before, so the
    shared dates are computed once and the rules below the requests once for all of them.
    """
    now = cal.day(today)
    lo, hi = F.col("_lo"), F.col("_hi")
    shared = bounds.select(
        F.coalesce("data_min", now).alias("_lo"), F.coalesce("data_max", now).alias("_hi"), now.alias("_today")
    ).withColumns({"_month": cal.month_start(F.col("_today")), "_quarter": cal.quarter_start(F.col("_today"))})
    shared = shared.withColumns(
        {"_newest": cal.month_start(hi), "_latest": latest_complete_month(lo, hi, F.col("_today"))}
    )
    shared = shared.withColumns(
        {
            "_last": F.coalesce("_latest", "_newest"),
            "_quarter_last": F.add_months("_latest", -(F.month("_latest") % 3)),
        }
    ).withColumns(
        {
            "_close": F.when(F.col("_latest").isNotNull(), F.last_day("_last")).otherwise(
                F.least(F.last_day("_last"), hi)
            ),
            "_quarter_first": F.add_months("_quarter_last", -2),
        }
    )
    whole = is_complete(F.col("_quarter_first"), lo, hi, F.col("_today")) & is_complete(
        F.col("_quarter_last"), lo, hi, F.col("_today")
    )
    shared = shared.withColumn("_quarter_is_whole", F.coalesce(whole, F.lit(False)))

    rows = []
    for ask in asks:
        start, end, name, swapped = _asked(ask)
        possible, to_start, to_end, to_name = _moved(ask.period)
        rows.append(
            F.struct(
                F.lit(ask.key or ask.period).alias("key"),
                F.lit(ask.period).alias("period"),
                start.cast("date").alias("start"),
                end.cast("date").alias("end"),
                F.lit(name).cast("string").alias("name"),
                swapped.alias("swapped"),
                possible.alias("possible"),
                to_start.cast("date").alias("to_start"),
                to_end.cast("date").alias("to_end"),
                F.lit(to_name).cast("string").alias("to_name"),
            )
        )
    out = shared.select("_lo", "_hi", "_month", "_newest", "_latest", F.inline(F.array(*rows)))
    custom = F.col("period") == "custom"
    low, high = F.greatest("start", lo), F.least("end", hi)
    out = out.withColumns(
        {
            "move": F.col("period").isin(*RELATIVE) & (hi < F.col("_month")) & (F.col("end") > hi) & F.col("possible"),
            "limited": custom & ((F.col("start") < lo) | (F.col("end") > hi)) & (low <= high),
        }
    )
    out = out.withColumns(
        {
            c: F.when(F.col("move"), F.col(f"to_{c}")).when(F.col("limited"), limit).otherwise(F.col(c))
            for c, limit in (("start", low), ("end", high))
        }
        | {"name": F.when(F.col("move"), F.col("to_name")).otherwise(F.col("name"))}
    )
    out = out.withColumns(
        {
            "text": cal.period_text(F.col("start"), F.col("end")),
            "empty": (F.col("end") < lo) | (F.col("start") > hi),
            "data": _span(lo, hi),
            "ends": cal.day_text(hi),
        }
    )
    asked = F.regexp_replace("period", "_", " ")
    moved_to = _moved_text(F.col("period"), F.col("start"), F.col("end"), F.col("_newest"), F.col("_latest"))
    measured = ~F.col("empty") & (F.col("period") != "all")
    notes = [
        (F.col("swapped"), [F.lit("date_from was after date_to, so the dates were swapped.")]),
        (F.col("limited"), [F.lit("Custom dates were limited to the available data ("), F.col("data"), F.lit(").")]),
        (F.col("move"), [F.lit("Data ends "), F.col("ends"), F.lit("; '"), asked, F.lit("' = "), moved_to, F.lit(".")]),
        (F.col("empty"), [F.lit("No data in this period; available data covers "), F.col("data"), F.lit(".")]),
        (measured & (F.col("end") > hi), [F.lit("Data currently ends "), F.col("ends"), F.lit(", so this period is incomplete.")]),
        (
            measured & ~custom & (F.col("start") < lo),
            [F.lit("Data starts "), cal.day_text(lo), F.lit(", so the start of this period is partial.")],
        ),
    ]
    return out.select(
        "key",
        "period",
        "start",
        "end",
        F.concat("text", F.coalesce(F.concat(F.lit(" ("), "name", F.lit(")")), F.lit(""))).alias("label"),
        F.array_compact(F.array(*[F.when(test, F.concat(*words)) for test, words in notes])).alias("notes"),
    )


def _moved_text(period: Column, start: Column, end: Column, newest: Column, latest: Column) -> Column:
    """What a moved period became, for its note."""
    month = F.date_format(start, "MMM yyyy")
    known = latest.isNotNull()
    whole = F.coalesce(newest == latest, F.lit(False))
    months = F.when(end == F.last_day(end), cal.period_text(start, end)).otherwise(
        F.concat(month, F.lit("–"), cal.day_text(end))
    )
    closing = F.when(known, F.lit(" (ending with the latest complete month)")).otherwise(
        F.lit(" (no complete month yet)")
    )
    state = F.when(known, F.lit(" (the latest complete month)")).otherwise(
        F.lit(" (partial; no complete month yet)")
    )
    return (
        F.when(
            period == "this_month",
            F.concat(month, F.when(whole, F.lit(" (complete)")).otherwise(F.lit(" (partial)"))),
        )
        .when(period == "last_month", F.concat(month, state))
        .when(period == "year_to_date", F.concat(F.lit("Jan 1 – "), cal.day_text(end)))
        .when(period == "this_quarter", F.concat(cal.day_text(start), F.lit(" – "), cal.day_text(end), F.lit(" (partial)")))
        .when(
            period == "last_quarter",
            F.concat(
                F.date_format(start, "MMM"), F.lit("–"), F.date_format(end, "MMM yyyy"),
                F.lit(" (the latest complete quarter)"),
            ),
        )
        .otherwise(F.concat(months, closing))
    )


def _named(start: Column, end: Column, name: str) -> Column:
    return F.concat(cal.period_text(start, end), F.lit(f" ({name})"))


COMPARISONS = {"previous_period": "previous period", "same_period_last_year": "same period last year"}


@dataclass(frozen=True)
class Comparison:
    start: Column
    end: Column
    label: Column
    months: Column
    days: Column

    def shift(self, day: Column) -> Column:
        """A comparison date moved onto the current period; months clamp to the month's last day."""
        return F.when(self.months > 0, F.add_months(day, self.months)).otherwise(F.date_add(day, self.days))


def comparison(start: Column, end: Column, compare_to: str) -> Comparison:
    """The window a period is compared with, and how far its days move forward to line up."""
    if compare_to == "same_period_last_year":
        months, days = F.lit(12), F.lit(0)
    else:
        by_month = F.dayofmonth(start) == 1
        months = F.when(by_month, cal.months_touched(start, end)).otherwise(F.lit(0))
        days = F.when(by_month, F.lit(0)).otherwise(F.datediff(end, start) + 1)
    back_end = F.add_months(end, -months)
    back_end = F.when(end == F.last_day(end), F.last_day(back_end)).otherwise(back_end)
    low = F.when(months > 0, F.add_months(start, -months)).otherwise(F.date_sub(start, days))
    high = F.when(months > 0, back_end).otherwise(F.date_sub(end, days))
    return Comparison(low, high, _named(low, high, COMPARISONS[compare_to]), months, days)


def all_periods(bounds: DataFrame, today, focus_month=None, date_from=None, date_to=None) -> DataFrame:
    """Every named period, one row each."""
    return resolve(bounds, today, [Ask(name, date_from, date_to, focus_month) for name in PERIODS]).drop("key")


def spend_by_period(daily: DataFrame, periods: DataFrame) -> DataFrame:
    """Net spend and count of every period from day totals.

    Days are few whatever the facts hold, and the periods are at most twelve rows, so each day is matched
    against one small array instead of being joined.
    """
    known = periods.agg(F.collect_list(F.struct("period", "start", "end")).alias("p")).scalar()
    d = F.col("transaction_date")
    inside = F.filter(F.col("_periods"), lambda p: (p["start"] <= d) & (d <= p["end"]))
    rows = daily.withColumn("_periods", known)
    rows = rows.select("net", "count", F.explode(F.transform(inside, lambda p: p["period"])).alias("period"))
    return rows.groupBy("period").agg(F.sum("net").alias("net"), F.sum("count").alias("count"))


def month_ranges(months: DataFrame) -> DataFrame:
    """Consecutive months as ranges: (start, end, months). ``months`` has one DATE column, ``month``."""
    from pyspark.sql import Window

    distinct = months.select("month").distinct()
    place = F.year("month") * 12 + F.month("month")
    island = place - F.row_number().over(Window.orderBy("month"))
    return (
        distinct.withColumn("_island", island)
        .groupBy("_island")
        .agg(F.min("month").alias("start"), F.max("month").alias("end"), F.count("*").alias("months"))
        .drop("_island")
    )
