"""Table sinks and the transaction scans behind analysis."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions import calendar as cal
from outlay.functions.categories import CATEGORY_DEFAULT, GROUP_DEFAULT
from outlay.functions.merchants import merchant_name

ANALYSIS_COLUMNS = (
    "issuer", "transaction_date", "description", "amount", "transaction_type", "category", "parent_group",
)
DEFAULT_MONTHS_BACK = 24


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Full refresh of one table. A partition column is clustered first, so each value gets few files."""
    writer = df.hint("rebalance", partition_by) if partition_by else df
    writer = writer.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append JSON lines; every task writes its own file, so no lock is needed."""
    df.write.mode("append").json(path)


def read_facts(spark: SparkSession, path: str, start=None, today: date | None = None) -> DataFrame:
    """Fact transactions since ``start``, by default 24 months before ``today``; the filter reaches the scan."""
    if start is None:
        if today is None:
            raise ValueError("give start or today")
        start = F.add_months(cal.month_start(cal.day(today)), -DEFAULT_MONTHS_BACK)
    facts = spark.read.parquet(path)
    if "transaction_month" in facts.columns:
        # The column that ``write_table`` partitions by: months before the start are not opened.
        facts = facts.where(F.col("transaction_month") >= F.last_day(cal.day(start)))
    return facts.where(F.col("transaction_date") >= cal.day(start)).select(*ANALYSIS_COLUMNS)


_MERCHANTS = "description string, merchant string"


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    """(description, merchant) of a dictionary that ``extend_merchants`` keeps; empty if there is none yet."""
    try:
        return spark.read.schema(_MERCHANTS).parquet(path).dropDuplicates(["description"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MERCHANTS)


def extend_merchants(facts: DataFrame, path: str, aliases: Mapping[str, str] | None = None) -> None:
    """Add the descriptions that the dictionary lacks, each with its merchant name.

    The dozen patterns behind a name run once for each new description, not for each row; a dictionary belongs to one
    set of aliases. Descriptions added twice by concurrent writers have the same name and count once.
    """
    texts = facts.select(F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description")).distinct()
    fresh = texts.join(read_merchants(facts.sparkSession, path), "description", "left_anti")
    fresh.select("description", merchant_name("description", aliases).alias("merchant")).write.mode("append").parquet(path)


def analysis_frame(facts: DataFrame, aliases: Mapping[str, str] | None = None, merchants: DataFrame | None = None) -> DataFrame:
    """Facts ready for analysis: no null text, default category and group, bad amounts 0, derived columns.

    ``merchants`` is a dictionary (description, merchant); descriptions that it lacks are named on the spot.
    """

    def text(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    kind = facts.schema["amount"].dataType
    amount = F.col("amount") if isinstance(kind, T.DecimalType) else F.col("amount").try_cast("decimal(38,9)")
    base = facts.select(
        text("issuer").alias("issuer"),
        F.col("transaction_date").cast("date").alias("transaction_date"),
        text("description").alias("description"),
        F.coalesce(amount, F.lit(0)).alias("amount"),
        text("transaction_type").alias("transaction_type"),
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(CATEGORY_DEFAULT)).alias("category"),
        F.coalesce(F.nullif(F.col("parent_group"), F.lit("")), F.lit(GROUP_DEFAULT)).alias("parent_group"),
    )
    d, name = F.col("transaction_date"), merchant_name("description", aliases)
    columns = base.columns
    if merchants is not None:
        base = base.join(merchants.select("description", F.col("merchant").alias("_known")), "description", "left")
        name = F.coalesce("_known", name)
    return base.select(
        *columns,
        name.alias("merchant"),
        cal.month_start(d).alias("month"),
        F.weekday(d).alias("weekday"),
        (-F.col("amount")).alias("spend"),
    )


def plain_rows(df: DataFrame) -> DataFrame:
    """Decimals as double and dates as ISO text, for readers outside Spark."""

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(field.name)
        return c

    return df.select(*[plain(f) for f in df.schema.fields])


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, in column order."""
    flat = plain_rows(df)
    return flat.select(F.to_json(F.struct(*flat.columns)).alias("row"))
