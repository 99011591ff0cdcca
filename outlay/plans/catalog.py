"""What can be asked for: dates, issuers, categories, merchants, and value lists with search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.functions.categories import is_analyzed
from outlay.functions.merchants import clean_label
from outlay.plans.spec import CATEGORICAL
from outlay.session import scratch_dir

TOP_MERCHANTS = 30
LIST_LIMIT = 25


def merchants_by_spend(frame: DataFrame) -> DataFrame:
    """Every merchant with its net spend, largest first."""
    rows = frame.where(is_analyzed()).groupBy("merchant").agg(F.sum(-F.col("amount")).alias("spend"))
    return rows.orderBy(F.desc("spend"), "merchant")


def months_present(frame: DataFrame) -> DataFrame:
    """Months with any transaction, newest first."""
    return frame.select(F.date_format("transaction_date", "yyyy-MM").alias("month")).distinct().orderBy(F.desc("month"))


def category_groups(frame: DataFrame) -> DataFrame:
    """Category with the groups it occurs under; both come from closed lists."""
    return _groups_of(frame.where(is_analyzed()))


def _groups_of(rows: DataFrame) -> DataFrame:
    pairs = rows.select("category", "parent_group").distinct()
    return pairs.groupBy("category").agg(F.array_sort(F.collect_list("parent_group")).alias("parent_groups"))


def catalog(frame: DataFrame, top_merchants: int = TOP_MERCHANTS) -> DataFrame:
    """One nested row describing the data. Lists hold closed vocabularies or the top merchants only."""
    # The frame is read once; dates count all rows, everything else the analyzed ones.
    spark, path = frame.sparkSession, scratch_dir(frame.sparkSession, "catalog")
    labels = frame.groupBy(F.coalesce(is_analyzed(), F.lit(False)).alias("analyzed"), "issuer", "parent_group", "category", "merchant").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(-F.col("amount")).alias("spend"),
        F.min("transaction_date").alias("lo"),
        F.max("transaction_date").alias("hi"),
    )
    labels.write.parquet(path)
    labels = spark.read.schema(labels.schema).parquet(path)
    dates = labels.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = labels.where("analyzed")
    lists = rows.agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"),
            F.array_sort(F.collect_set("issuer")).alias("issuers"),
            F.array_sort(F.collect_set("parent_group")).alias("parent_groups"),
        ).alias("x")
    )
    groups = _groups_of(rows).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "parent_groups")))).alias("x")
    )
    spend = rows.groupBy("merchant").agg(F.sum("spend").alias("spend"))
    top = spend.orderBy(F.desc("spend"), "merchant").limit(top_merchants)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("spend")).alias("k"), "merchant")))
    months = (F.year("hi") - F.year("lo")) * 12 + F.month("hi") - F.month("lo") + 1
    out = dates.select(
        F.date_format("lo", "yyyy-MM-dd").alias("date_min"),
        F.date_format("hi", "yyyy-MM-dd").alias("date_max"),
        F.coalesce(months, F.lit(0)).alias("months"),
        lists.scalar().alias("_x"),
        groups.scalar().alias("categories"),
        top.agg(ranked.alias("m")).scalar().alias("_m"),
        spend.agg(F.count(F.lit(1)).alias("n")).scalar().alias("merchant_count"),
    )
    return out.select(
        "date_min", "date_max", "months", "_x.*", "categories",
        F.transform("_m", lambda x: x["merchant"]).alias("merchants"), "merchant_count",
    )


def list_values(frame: DataFrame, field: str, search: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Values of a field containing ``search`` (any case) with the number of matches; merchants by spend."""
    if field not in CATEGORICAL:
        raise ValueError(f"unknown field {field!r}; valid: {', '.join(CATEGORICAL)}")
    rows = frame.where(is_analyzed()).groupBy(F.col(field).alias("value")).agg(F.sum(-F.col("amount")).alias("spend"))
    if search:
        rows = rows.where(F.lower("value").contains(F.lower(clean_label(F.lit(search)))))
    # The values are found once; their number and the first of them are read from what was found.
    path, schema = scratch_dir(frame.sparkSession, "values"), rows.schema
    rows.write.parquet(path)
    rows = frame.sparkSession.read.schema(schema).parquet(path)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    order = [F.desc("spend"), F.col("value")] if field == "merchant" else [F.col("value")]
    return rows.orderBy(*order).limit(limit).select("value", total.alias("total_matches"))
