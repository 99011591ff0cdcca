"""Amounts: signed parts, exact rounding, safe ratios, money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import col, lit_or_col

NUMERIC = "decimal(38,9)"
WHOLE = "decimal(38,0)"


def safe_numeric(text: Column | str) -> Column:
    """Amount text as NUMERIC; null when it is not a number."""
    return F.trim(col(text)).try_cast(NUMERIC)


def spend(amount: Column | str = "amount") -> Column:
    """Money out is positive: purchases are stored negative."""
    return -col(amount)


def outflow(amount: Column | str = "amount") -> Column:
    """The purchase part of a signed amount (0 for refunds)."""
    a = col(amount)
    return F.when(a < 0, -a).otherwise(F.lit(0))


def inflow(amount: Column | str = "amount") -> Column:
    """The refund or credit part of a signed amount (0 for purchases)."""
    a = col(amount)
    return F.when(a > 0, a).otherwise(F.lit(0))


def whole_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` on whole numbers, rounded half away from zero, null when ``bottom`` is 0 or null.

    Integer arithmetic: no binary fractions and no double rounding, at any group size.
    """
    t, b = top.cast(WHOLE), F.abs(bottom.cast(WHOLE))
    sign = F.when((top < 0) != (bottom < 0), F.lit(-1)).otherwise(F.lit(1))
    magnitude = F.call_function("div", F.abs(t) * 2 + b, b * 2)
    return F.when(bottom != 0, sign * magnitude)


def ratio_rounded(top: Column, bottom: Column, places: int, scale: int = 9) -> Column:
    """``top / bottom`` rounded half away from zero to ``places`` digits, as double; null on a zero divisor.

    ``scale`` is how many fraction digits the inputs carry.
    """
    up = F.lit(10**scale).cast(WHOLE)
    t = (top.cast(f"decimal(38,{scale})") * up).cast(WHOLE) * F.lit(10**places).cast(WHOLE)
    b = (bottom.cast(f"decimal(38,{scale})") * up).cast(WHOLE)
    return whole_ratio(t, b).cast("double") / F.lit(float(10**places))


def percent_rounded(top: Column, bottom: Column, places: int, scale: int = 2) -> Column:
    """``100 * top / bottom`` rounded half away from zero, as double; null on a zero divisor."""
    return ratio_rounded(top.cast(f"decimal(38,{scale})") * 100, bottom, places, scale)


def percent_change(current: Column, previous: Column, places: int = 2) -> Column:
    """Change relative to the size of the earlier value; null without an earlier value or when it is 0."""
    return percent_rounded(current - previous, F.abs(previous), places)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, null when the divisor is 0 or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def change_direction(current: Column, previous: Column, has_previous: Column) -> Column:
    """no_prior / flat / increase / decrease."""
    return (
        F.when(~has_previous, F.lit("no_prior"))
        .when(F.abs(current - previous) < 0.005, F.lit("flat"))
        .when(current > previous, F.lit("increase"))
        .otherwise(F.lit("decrease"))
    )


def by_unit(value: Column, unit: str) -> Column:
    """Final rounding by unit (usd 2 places, pct 1, count 0), NaN and infinities to null."""
    x = value.cast("double")
    x = F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(x)
    if unit == "count":
        return F.round(x, 0).cast("long")
    return F.round(x, 1 if unit == "pct" else 2)


def money_text(value: Column) -> Column:
    """$1,234.56, negatives as -$1,234.56."""
    rounded = F.round(value.cast("decimal(38,6)"), 2)
    return F.concat(F.when(rounded < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(rounded), 2))


def percent_text(percent: Column, direction: Column) -> Column:
    """A percent change in words; says why when there is none."""
    return (
        F.when(
            percent.isNull(),
            F.when(direction == "no_prior", F.lit("no previous-month comparison")).otherwise(
                F.lit("no percentage (previous amount was $0.00)")
            ),
        )
        .when(F.abs(percent) < 0.005, F.lit("0.00% (no change)"))
        .otherwise(
            F.concat(
                F.format_string("%.2f", F.abs(percent).cast("double")),
                F.when(percent > 0, F.lit("% increase")).otherwise(F.lit("% decrease")),
            )
        )
    )


# Fixed value: what counts as one amount inside free text. A comma ends the number.
AMOUNT_PATTERN = r"-?\d+(?:\.\d+)?\s*[kKmM]?"


def amounts_in_text(text: Column | str) -> Column:
    """Sum of every amount written in a text, with k and m suffixes; null when there is none."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(AMOUNT_PATTERN), F.lit(0))

    def one(part: Column) -> Column:
        number = F.regexp_replace(part, r"[\skKmM]", "").cast("double")
        suffix = F.lower(F.substring(part, -1, 1))
        return number * F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).otherwise(1.0)

    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda acc, part: acc + one(part)))


def suggested_cap(
    current: Column, previous: Column, has_previous: Column, target, shortfall: Column, eligible: Column
) -> tuple[Column, Column]:
    """(cap, reason) for one discretionary category: share the shortfall, else hold at last month's spend.

    All amounts carry two decimals; the share is exact whole-number arithmetic in cents.
    """
    goal = lit_or_col(target).cast("decimal(20,2)")

    def cents(x: Column) -> Column:
        return (x.cast("decimal(24,2)") * 100).cast(WHOLE)

    left = F.greatest(F.lit(0).cast(WHOLE), cents(eligible) - cents(shortfall))
    shared = (whole_ratio(cents(current) * left, cents(eligible)).cast("decimal(24,2)") / 100).cast("decimal(24,2)")
    held = has_previous & (current > previous) & (previous > 0)
    money = "decimal(24,2)"
    rules = [
        (goal.isNull(), F.lit(None).cast(money), "No numeric savings target is configured."),
        (current <= 0, F.lit(None).cast(money), "No positive current discretionary spend to cap."),
        (shortfall > 0, shared, "Proportional share of the savings shortfall."),
        (held, previous.cast(money), "Spending increased; capped at previous-month spend."),
        (F.lit(True), current.cast(money), "Savings target met; maintain current spend."),
    ]
    cap = reason = F
    for test, amount, words in rules:
        cap, reason = cap.when(test, amount), reason.when(test, F.lit(words))
    return cap, reason
