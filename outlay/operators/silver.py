"""Raw exports to clean, deduplicated transactions of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.money import safe_numeric
from outlay.operators.ordered import keep_largest_copies

EXPORT_DATE = "MM/dd/yyyy"
SILVER_COLUMNS = ("transaction_date", "description", "amount", "raw_category", "transaction_type")


def export_date(name: str) -> Column:
    """An export's date text as DATE; ISO dates and DATE columns pass too, other text is null."""
    text = F.col(name).cast("string")
    american = F.try_to_timestamp(text, F.lit(EXPORT_DATE)).cast("date")
    return F.coalesce(american, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def category_or_payment(name: str = "Category") -> Column:
    return F.when(F.col(name).isNull(), F.lit("Payment")).otherwise(F.trim(F.col(name)))


def amex_type(name: str = "Category") -> Column:
    """This issuer has no type column; the category decides."""
    c = F.col(name)
    return (
        F.when(c.isNull(), F.lit("Payment"))
        .when(c.startswith("Fees & Adjustments"), F.lit("Return"))
        .otherwise(F.lit("Sale"))
    )


def chase_transactions(raw: DataFrame) -> DataFrame:
    """Trimmed, dated, deduplicated across files. Repeats inside one file are genuine and stay."""
    staged = raw.select(
        export_date("Transaction_Date").alias("transaction_date"),
        export_date("Post_Date").alias("post_date"),
        F.trim("Description").alias("description"),
        category_or_payment().alias("raw_category"),
        F.trim("Type").alias("transaction_type"),
        safe_numeric("Amount").alias("amount"),
        F.trim("Memo").alias("memo"),
        "file_source",
    ).where(F.col("transaction_date").isNotNull())
    kept = keep_largest_copies(staged, "file_source", ["transaction_date", "description", "amount"])
    return kept.withColumn("processed_at", F.current_timestamp())


def amex_transactions(raw: DataFrame) -> DataFrame:
    """As for the other issuer, with purchases turned negative and repeats told apart on the untrimmed text."""
    staged = raw.select(
        export_date("Date").alias("transaction_date"),
        F.col("Description").alias("_description"),
        F.col("Amount").alias("_amount"),
        category_or_payment().alias("raw_category"),
        amex_type().alias("transaction_type"),
        "file_source",
    ).where(F.col("transaction_date").isNotNull())
    kept = keep_largest_copies(staged, "file_source", ["transaction_date", "_description", "_amount"])
    return kept.select(
        "transaction_date",
        F.trim("_description").alias("description"),
        (-safe_numeric("_amount")).alias("amount"),
        "raw_category",
        "transaction_type",
        "file_source",
        F.current_timestamp().alias("processed_at"),
    )


def all_transactions(amex: DataFrame, chase: DataFrame) -> DataFrame:
    """Both issuers in one table."""
    columns = (*SILVER_COLUMNS, "processed_at")
    return (
        amex.select(F.lit("Amex").alias("issuer"), *columns)
        .unionByName(chase.select(F.lit("Chase").alias("issuer"), *columns))
    )
