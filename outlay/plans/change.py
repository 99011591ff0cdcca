"""What drove one category's change between a month and the month before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions import calendar as cal
from outlay.functions.categories import is_analyzed
from outlay.functions.merchants import description_key
from outlay.functions.money import ratio_rounded

TOP_DEFAULT, TOP_MAX, LARGEST_MAX = 5, 10, 3
# When nearly every description occurs once, the split by description says little.
UNIQUE_SHARE, UNIQUE_MIN_ROWS = 0.9, 5


@dataclass
class Change:
    header: DataFrame
    increases: DataFrame
    decreases: DataFrame
    new: DataFrame
    largest: DataFrame


def category_rows(facts: DataFrame, category: str, month, parent_group: str | None = None) -> DataFrame:
    """Analyzed rows of a category in a month and the one before, with ``spend``, ``is_current`` and the group key."""
    first = cal.month_start(cal.day(month))
    d = F.col("transaction_date")
    rows = facts.where(is_analyzed() & (F.col("category") == category))
    rows = rows.where((d >= F.add_months(first, -1)) & (d <= F.last_day(first)))
    if parent_group:
        rows = rows.where(F.col("parent_group") == parent_group)
    return rows.select(
        "transaction_date",
        description_key("description").alias("description"),
        (-F.col("amount")).alias("spend"),
        (d >= first).alias("is_current"),
    )


def by_description(rows: DataFrame) -> DataFrame:
    """Both months side by side per description: sums, counts and the largest transaction."""
    cur, spend = F.col("is_current"), F.col("spend")

    def pick(now: bool) -> Column:
        return F.when(cur if now else ~cur, spend)

    zero = F.lit(0)
    return rows.groupBy("description").agg(
        F.coalesce(F.sum(pick(True)), zero).alias("current"),
        F.coalesce(F.sum(pick(False)), zero).alias("previous"),
        F.count(pick(True)).alias("current_n"),
        F.count(pick(False)).alias("previous_n"),
        F.max(pick(True)).alias("current_max"),
        F.max(pick(False)).alias("previous_max"),
    )


def change_breakdown(total0: Column, count0: Column, total1: Column, count1: Column) -> tuple[Column, Column, Column]:
    """(change, part from the number of transactions, part from their size); the parts add up exactly.

    With an empty month all of the change comes from the number of transactions.
    """
    change = F.round(total1 - total0, 2).cast("decimal(24,2)")
    by_count = ratio_rounded((count1 - count0).cast("decimal(18,0)") * total0.cast("decimal(18,2)"), count0, 2, 2)
    from_count = F.when((count0 == 0) | (count1 == 0), change).otherwise(by_count.cast("decimal(24,2)"))
    return change, from_count, change - from_count


def explain_change(
    facts: DataFrame, category: str, month, top_n: int = TOP_DEFAULT, parent_group: str | None = None
) -> Change:
    """Month statistics, the count-against-size split, and the descriptions behind the change."""
    if not category or len(category) > 120:
        raise ValueError("category is required and must be at most 120 characters")
    if not 1 <= top_n <= TOP_MAX:
        raise ValueError(f"top_n must be between 1 and {TOP_MAX}")
    rows = category_rows(facts, category, month, parent_group)
    per = by_description(rows)

    once = F.col("current_n") + F.col("previous_n") == 1
    sums = per.agg(
        F.sum("current_n").alias("c1"),
        F.sum("previous_n").alias("c0"),
        F.sum("current").alias("t1"),
        F.sum("previous").alias("t0"),
        F.max("current_max").alias("m1"),
        F.max("previous_max").alias("m0"),
        F.count(F.lit(1)).alias("distinct_descriptions"),
        F.count_if(once).alias("single_use"),
    ).where("distinct_descriptions > 0")
    c0, c1, t0, t1 = (F.col(x) for x in ("c0", "c1", "t0", "t1"))
    change, from_count, from_average = change_breakdown(t0, c0, t1, c1)
    n = F.col("distinct_descriptions")
    header = sums.select(
        F.lit(category).alias("category"),
        c1.alias("current_count"),
        F.round(t1, 2).alias("current_net"),
        ratio_rounded(F.round(t1, 2), c1, 2).alias("current_average"),
        F.round("m1", 2).alias("current_largest"),
        c0.alias("previous_count"),
        F.round(t0, 2).alias("previous_net"),
        ratio_rounded(F.round(t0, 2), c0, 2).alias("previous_average"),
        F.round("m0", 2).alias("previous_largest"),
        change.alias("change_usd"),
        from_count.alias("from_transaction_count"),
        from_average.alias("from_average_amount"),
        (c1 - c0).alias("transaction_count_change"),
        n,
        ((c0 + c1 >= UNIQUE_MIN_ROWS) & (F.col("single_use") * 10 >= n * int(UNIQUE_SHARE * 10))).alias("limited"),
    )
    moved = per.select(
        "description",
        F.round("current", 2).alias("current"),
        F.round("previous", 2).alias("previous"),
        F.round(F.col("current") - F.col("previous"), 2).alias("change"),
    )
    increases = moved.where("change >= 0.005").orderBy(F.desc("change"), "description").limit(top_n)
    decreases = moved.where("change <= -0.005").orderBy("change", "description").limit(top_n)
    new = (
        per.where("current_n > 0 and previous_n = 0")
        .orderBy(F.desc("current"), "description")
        .limit(top_n)
        .select("description", "current")
    )
    largest = (
        rows.where("is_current")
        .orderBy(F.desc("spend"), "transaction_date", "description")
        .limit(min(top_n, LARGEST_MAX))
        .select("transaction_date", "description", F.round("spend", 2).alias("amount"))
    )
    return Change(header, increases, decreases, new, largest)
