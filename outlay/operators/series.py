"""Transforms along a time dimension and changes inside a series. Groups are label series: as long as a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transformed(value: str, transform: str, time: str, others: list[str]) -> Column:
    """Running total, mean of three, or percent change of ``value`` along ``time`` within the other dimensions."""
    w = Window.partitionBy(*others).orderBy(time)
    x = F.col(value)
    if transform == "cumulative":
        return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if transform == "rolling_3":
        three = w.rowsBetween(-2, 0)
        return F.when(F.count(x).over(three) == 3, F.sum(x).over(three).cast("double") / 3)
    before = F.lag(x).over(w).cast("double")
    return F.try_divide(x.cast("double") - before, F.abs(before)) * 100


def largest_step(series: DataFrame, time: str, value: str) -> DataFrame:
    """One row: the neighbours in time between which ``value`` changed most; the earliest on ties."""
    w = Window.orderBy(time)
    x = F.col(value).cast("double")
    steps = series.select(
        F.lag(time).over(w).alias("from"),
        F.col(time).alias("to"),
        F.lag(x).over(w).alias("before"),
        x.alias("after"),
    ).where(F.col("before").isNotNull() & F.col("after").isNotNull())
    change = F.col("after") - F.col("before")
    best = F.min_by(
        F.struct("from", "to", "before", "after", change.alias("change")), F.struct(-F.abs(change), F.col("to"))
    )
    return steps.agg(best.alias("b")).select(
        "b.*", (F.try_divide(F.col("b.change"), F.abs("b.before")) * 100).alias("change_pct")
    )


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Each row's percent of the column total. The total is one scalar, not a window over everything."""
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total.cast("double")) * 100)


def bar_width(df: DataFrame, value: str, out: str) -> DataFrame:
    """Each positive value as percent of the largest positive one, else 0."""
    top = df.agg(F.max(F.when(F.col(value) > 0, F.col(value))).alias("t")).scalar()
    return df.withColumn(
        out, F.when(F.col(value) > 0, F.col(value).cast("double") / top.cast("double") * 100).otherwise(F.lit(0.0))
    )
