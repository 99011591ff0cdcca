"""Dates: month arithmetic, dimension labels, ISO weeks, period text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import col, lit_or_col

# Weekday labels, Monday first.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def day(value) -> Column:
    """A DATE column from a Column, a date, or ISO text."""
    if isinstance(value, str):
        value = date.fromisoformat(value)
    return lit_or_col(value).cast("date")


def month_start(d: Column) -> Column:
    return F.trunc(d, "month").cast("date")


def month_end(d: Column) -> Column:
    return F.last_day(d)


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter").cast("date")


def week_start(d: Column) -> Column:
    """The Monday on or before a date."""
    return F.date_trunc("week", d).cast("date")


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def year_text(d: Column) -> Column:
    return F.date_format(d, "yyyy")


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d)


def iso_week_label(d: Column) -> Column:
    """2026-W35"""
    return F.concat(iso_year(d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def months_touched(start: Column, end: Column) -> Column:
    """Calendar months touched by an inclusive range."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1


def time_points(dimension: str, start: Column, end: Column) -> Column:
    """How many labels a time dimension has over an inclusive range."""
    if dimension == "quarter":
        return (F.year(end) * 4 + F.quarter(end)) - (F.year(start) * 4 + F.quarter(start)) + 1
    if dimension == "week":
        return F.floor((F.datediff(end, start) + F.weekday(start)) / 7).cast("int") + 1
    return months_touched(start, end)


def date_from_text(text: Column, end: bool = False) -> Column:
    """YYYY-MM as the first (or last) day of the month, YYYY-MM-DD as that day; null on other text."""
    whole = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    month = F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    short = F.length(text) == 7
    return F.when(short, F.last_day(month) if end else month).when(F.length(text) == 10, whole)


def weekday_label(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(d) + 1)


def dimension_label(name: str, d: Column) -> Column:
    """The label of one calendar dimension; all sort as text except weekday, day_of_month is an integer."""
    if name == "month":
        return F.date_format(d, "yyyy-MM")
    if name == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    if name == "week":
        return F.date_format(week_start(d), "yyyy-MM-dd")
    if name == "weekday":
        return weekday_label(d)
    if name == "day_of_month":
        return F.dayofmonth(d)
    raise ValueError(f"not a calendar dimension: {name}")


def label_sort_key(name: str, label: Column) -> Column:
    """What a calendar label sorts by."""
    if name == "weekday":
        return F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), label)
    return label


def calendar_labels(name: str, start: Column, end: Column) -> Column:
    """Every label of a calendar dimension over an inclusive range, as an array."""
    one_month = F.expr("interval 1 month")
    if name == "month":
        days = F.sequence(month_start(start), month_start(end), one_month)
        return F.transform(days, lambda d: dimension_label("month", d))
    if name == "quarter":
        days = F.sequence(quarter_start(start), quarter_start(end), F.expr("interval 3 month"))
        return F.transform(days, lambda d: dimension_label("quarter", d))
    if name == "week":
        days = F.sequence(week_start(start), end, F.expr("interval 7 day"))
        return F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd"))
    if name == "weekday":
        return F.array(*[F.lit(w) for w in WEEKDAYS])
    if name == "day_of_month":
        same_month = month_start(start) == month_start(end)
        return F.sequence(F.lit(1), F.when(same_month, F.dayofmonth(end)).otherwise(F.lit(31)))
    raise ValueError(f"not a calendar dimension: {name}")


def day_text(d: Column) -> Column:
    """Sep 5, 2026"""
    return F.concat(F.date_format(d, "MMM"), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), year_text(d))


def period_text(start: Column, end: Column) -> Column:
    """September 2026, Jul–Sep 2026, Jan 2025–Dec 2026, one day, or a day range."""
    whole = (F.dayofmonth(start) == 1) & (end == F.last_day(end))
    months = (
        F.when(month_start(start) == month_start(end), F.date_format(start, "MMMM yyyy"))
        .when(
            F.year(start) == F.year(end),
            F.concat(F.date_format(start, "MMM"), F.lit("–"), F.date_format(end, "MMM yyyy")),
        )
        .otherwise(F.concat(F.date_format(start, "MMM yyyy"), F.lit("–"), F.date_format(end, "MMM yyyy")))
    )
    return (
        F.when(start > end, F.lit("no dates"))
        .when(whole, months)
        .when(start == end, day_text(start))
        .otherwise(F.concat(day_text(start), F.lit(" – "), day_text(end)))
    )


def month_text(month: Column | str) -> Column:
    """August 2026 from YYYY-MM or YYYY-MM-DD text; other text is returned as it is."""
    text = col(month)
    d = F.try_to_timestamp(F.concat(F.substring(text, 1, 7), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    missing = text.isNull() | (text == "")
    return F.when(missing, F.lit("the previous month")).otherwise(F.coalesce(F.date_format(d, "MMMM yyyy"), text))


def friendly_label(name: str, label: Column) -> Column:
    """A dimension label as shown to people: Aug 2026, Q3 2026, Sep 7, 2026, Monday."""
    text = label.cast("string")
    if name == "month":
        return F.date_format(F.to_date(F.concat(text, F.lit("-01"))), "MMM yyyy")
    if name == "quarter":
        return F.concat(F.substring_index(text, "-", -1), F.lit(" "), F.substring_index(text, "-", 1))
    if name == "week":
        return day_text(F.to_date(text))
    if name == "weekday":
        names = F.array(*[F.lit(w) for w in WEEKDAY_NAMES])
        place = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), text).cast("int")
        return F.when(place > 0, F.element_at(names, F.greatest(place, F.lit(1)))).otherwise(text)
    return label
