"""What the data can support: month coverage, and per dimension how well grouping by it works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions import calendar as cal
from outlay.functions.categories import is_analyzed
from outlay.functions.money import outflow
from outlay.operators.periods import month_coverage
from outlay.plans.spec import CATEGORICAL
from outlay.session import scratch_dir

DIMENSIONS = CATEGORICAL + ("weekday", "day_of_month", "month", "quarter", "week")
# Thresholds of the status rules.
MIN_MEDIAN, MIN_TOP10, MIN_DAY_MEDIAN = 3, 0.40, 2
MIN_COMPLETE_MONTHS, MIN_QUARTERS, MIN_WEEKS = 2, 2, 4
TOP_VALUES = 5


def _label_sums(frame: DataFrame) -> DataFrame:
    """(dimension, value, n, gross) of analyzed rows for the categorical dimensions and the day."""
    d = F.col("transaction_date")
    rows = frame.where(is_analyzed())
    first = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in CATEGORICAL]
    first.append(F.struct(F.lit("day").alias("dimension"), d.cast("string").alias("value")))
    return rows.select(outflow().alias("gross"), F.inline(F.array(*first))).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross").alias("gross")
    )


def _with_calendar(sums: DataFrame) -> DataFrame:
    day = F.col("value").try_cast("date")
    calendar = F.array(
        *[
            F.struct(F.lit(c).alias("dimension"), cal.dimension_label(c, day).cast("string").alias("value"))
            for c in DIMENSIONS
            if c not in CATEGORICAL
        ]
    )
    own = F.array(F.struct("dimension", "value"))
    spread = F.when(F.col("dimension") == "day", calendar).otherwise(own)
    return sums.select("n", "gross", F.inline(spread)).groupBy("dimension", "value").agg(
        F.sum("n").alias("n"), F.sum("gross").alias("gross")
    )


def value_counts(frame: DataFrame) -> DataFrame:
    """(dimension, value, n, gross) of analyzed rows for all nine dimensions.

    A row counts once per categorical dimension and once for its day, summed map-side, so only distinct labels are
    shuffled; the five calendar dimensions then follow from the day totals.
    """
    return _with_calendar(_label_sums(frame))


def distinct_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many different values each column of the analyzed rows has."""
    labels = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    seen = frame.where(is_analyzed()).select(F.inline(labels)).distinct()
    return seen.agg(*[F.count_if((F.col("c") == c) & F.col("v").isNotNull()).alias(c) for c in columns])


def value_stats(counts: DataFrame) -> DataFrame:
    """Per dimension: distinct values, median and least rows per value, and what the ten largest cover.

    ``row_number <= 10`` lets the planner drop all but ten rows per dimension before the shuffle.
    """
    # Both orders read both sums, so the three branches have the same input and share its shuffle.
    by_n = Window.partitionBy("dimension").orderBy(F.desc("n"), F.desc("gross"), "value")
    by_gross = Window.partitionBy("dimension").orderBy(F.desc("gross"), F.desc("n"), "value")
    frequent = counts.withColumn("r", F.row_number().over(by_n)).where("r <= 10").groupBy("dimension").agg(
        F.sum("n").alias("top_n"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= TOP_VALUES, F.struct("r", "value")))).alias("v"),
    )
    dear = counts.withColumn("r", F.row_number().over(by_gross)).where("r <= 10").groupBy("dimension").agg(
        F.sum("gross").alias("top_gross")
    )
    whole = counts.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.percentile("n", F.lit(0.5)).alias("median_per_value"),
        F.min("n").alias("min_per_value"),
        F.sum("n").alias("all_n"),
        F.sum("gross").alias("all_gross"),
    )
    spend_share = F.when(
        F.col("all_gross") > 0, F.col("top_gross").cast("double") / F.col("all_gross").cast("double")
    ).otherwise(F.lit(1.0))
    return whole.join(frequent, "dimension").join(dear, "dimension").select(
        "dimension",
        "distinct",
        "median_per_value",
        "min_per_value",
        (F.col("top_n") / F.col("all_n")).alias("top10_transaction_share"),
        spend_share.alias("top10_spend_share"),
        F.transform("v", lambda x: x["value"]).alias("top_values"),
    )


def _count_text(count: Column, word: str) -> Column:
    number = F.regexp_replace(count.cast("string"), r"\.0$", "")
    return F.concat(number, F.lit(f" {word}"), F.when(count == 1, F.lit("")).otherwise(F.lit("s")))


def _noun(distinct: Column) -> Column:
    d = F.col("dimension")
    one = F.when(d == "issuer", F.lit("card")).when(d == "parent_group", F.lit("group")).otherwise(d)
    many = F.when(d == "category", F.lit("categories")).otherwise(F.concat(one, F.lit("s")))
    return F.when(distinct == 1, one).otherwise(many)


def with_status(stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """Add ``status`` (usable, limited, unusable) and ``reason``. ``coverage`` has one row: complete, touched."""
    n, median, share = F.col("distinct"), F.col("median_per_value"), F.col("top10_transaction_share")
    name = F.col("dimension")
    stats = stats.withColumn("_cover", coverage.select(F.struct("complete", "touched").alias("c")).scalar())
    complete, touched = F.col("_cover.complete"), F.col("_cover.touched")
    each = F.concat(F.lit("a median of "), _count_text(median, "transaction"))
    only = F.concat(F.lit("a median of only "), _count_text(median, "transaction"))
    values = F.concat(n.cast("string"), F.lit(" "), _noun(n))
    plural = _noun(F.lit(2))
    thin, scattered = median < MIN_MEDIAN, (n > 10) & (share < MIN_TOP10)
    thin_text = F.when(
        thin, F.concat(n.cast("string"), F.lit(" "), plural, F.lit(" with "), each, F.lit(" each"))
    )
    scattered_text = F.when(
        scattered, F.concat(F.lit("the top 10 "), plural, F.lit(" cover only a small share of transactions"))
    )
    cat, day, wd = name.isin(*CATEGORICAL), name == "day_of_month", name == "weekday"
    month, quarter, week = name == "month", name == "quarter", name == "week"
    rules = [
        (cat & (n < 2), "unusable", F.concat(F.lit("only "), values, F.lit(" in the data"))),
        (cat & (thin | scattered), "limited", F.concat_ws("; ", thin_text, scattered_text)),
        (cat, "usable", F.concat(values, F.lit(", "), each, F.lit(" each"))),
        (wd & (n < 2), "unusable", F.concat(F.lit("transactions fall on only "), _count_text(n, "weekday"))),
        (wd & thin, "limited", F.concat(only, F.lit(" per weekday"))),
        (wd, "usable", F.concat(each, F.lit(" per weekday"))),
        (day & (median < MIN_DAY_MEDIAN), "limited", F.concat(only, F.lit(" per day of the month"))),
        (day, "usable", F.concat(each, F.lit(" per day of the month"))),
        (
            month & (complete >= MIN_COMPLETE_MONTHS),
            "usable",
            F.concat(_count_text(complete, "complete month"), F.lit(" of data")),
        ),
        (month & (touched <= 1), "unusable", F.lit("the data covers a single month")),
        (
            month & (complete == 1),
            "limited",
            F.lit("only 1 complete month of data; the others are partial"),
        ),
        (
            month,
            "limited",
            F.concat(F.lit("no complete month yet ("), _count_text(touched, "partial month"), F.lit(")")),
        ),
        (quarter & (n >= MIN_QUARTERS), "usable", F.concat(_count_text(n, "quarter"), F.lit(" with data"))),
        (quarter, "unusable", F.lit("the data covers a single quarter")),
        (week & (n >= MIN_WEEKS), "usable", F.concat(_count_text(n, "week"), F.lit(" with data"))),
        (week & (n >= 2), "limited", F.concat(F.lit("only "), _count_text(n, "week"), F.lit(" with data"))),
        (week, "unusable", F.lit("the data covers a single week")),
    ]
    status = reason = F
    for test, word, why in rules:
        status, reason = status.when(test, F.lit(word)), reason.when(test, why)
    return stats.withColumns({"status": status, "reason": reason}).drop("_cover")


def data_bounds(frame: DataFrame) -> DataFrame:
    """One row: first and last day of analyzed rows, and their number."""
    return frame.where(is_analyzed()).agg(
        F.min("transaction_date").alias("data_min"),
        F.max("transaction_date").alias("data_max"),
        F.count(F.lit(1)).alias("transactions"),
    )


def coverage_counts(bounds: DataFrame, today) -> DataFrame:
    return month_coverage(bounds.select("data_min", "data_max"), today).agg(
        F.count_if("complete").alias("complete"), F.count(F.lit(1)).alias("touched")
    )


def coverage(frame: DataFrame, today) -> DataFrame:
    """One row: analyzed rows, date range, complete and partial months, days since the data ends."""
    bounds = data_bounds(frame)
    label = F.date_format("month", "yyyy-MM")
    months = month_coverage(bounds.select("data_min", "data_max"), today).agg(
        F.struct(
            F.array_sort(F.collect_list(F.when(F.col("complete"), label))).alias("complete_months"),
            F.array_sort(F.collect_list(F.when(~F.col("complete"), label))).alias("partial_months"),
            F.max(F.when(F.col("complete"), label)).alias("latest_complete_month"),
        ).alias("m")
    )
    return (
        bounds.withColumn("_m", months.scalar())
        .select("*", "_m.*", F.datediff(cal.day(today), F.col("data_max")).alias("data_end_lag_days"))
        .drop("_m")
    )


def type_counts(frame: DataFrame) -> DataFrame:
    """Rows per transaction type, analyzed or not."""
    return frame.groupBy("transaction_type").agg(F.count(F.lit(1)).alias("n"))


def profile(frame: DataFrame, today) -> DataFrame:
    """One row per dimension with statistics, status and reason; dimensions without any row are unusable.

    The frame is read once: its label sums are written to the shared folder, and all statistics and the range of days follow from them.
    """
    spark, path = frame.sparkSession, scratch_dir(frame.sparkSession, "labels")
    sums = _label_sums(frame)
    sums.write.parquet(path)
    sums = spark.read.schema(sums.schema).parquet(path)
    day = F.col("value").try_cast("date")
    bounds = sums.where("dimension = 'day'").agg(F.min(day).alias("data_min"), F.max(day).alias("data_max"))
    stats = value_stats(_with_calendar(sums))
    full = with_status(stats, coverage_counts(bounds, today))
    names = frame.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "dimension string")
    none = F.col("status").isNull()
    return names.join(full, "dimension", "left").select(
        "dimension",
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.coalesce("median_per_value", F.lit(0.0)).alias("median_per_value"),
        F.coalesce("min_per_value", F.lit(0)).alias("min_per_value"),
        F.coalesce("top10_transaction_share", F.lit(0.0)).alias("top10_transaction_share"),
        F.coalesce("top10_spend_share", F.lit(0.0)).alias("top10_spend_share"),
        F.coalesce("status", F.lit("unusable")).alias("status"),
        F.when(none, F.lit("there is no spending data yet")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("top_values", F.array().cast("array<string>")).alias("top_values"),
    )
