"""Raw exports, cleaning, deduplication, landing."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import silver
from outlay.queries.base import big, dbl, query, with_
from outlay.session import scratch_dir
from outlay.sources import cards, tables

# Payments have no category in the raw files, so they come out as category and type Payment for both issuers.
_CHASE_STAGED = (
    with_("raw")
    + """, staged AS (SELECT file_name, export_date AS transaction_date, description, export_amount AS amount,
  raw_category, transaction_type FROM raw WHERE issuer = 'Chase' AND export_date IS NOT NULL)"""
)
_AMEX_STAGED = (
    with_("raw")
    + """, staged AS (SELECT file_name, export_date AS transaction_date, description, export_amount AS amount,
  CASE WHEN transaction_type = 'Return' THEN 'Fees & Adjustments-Fees & Adjustments' ELSE raw_category END AS raw_category,
  CASE WHEN transaction_type = 'Payment' THEN 'Payment' WHEN transaction_type = 'Return' THEN 'Return'
    ELSE 'Sale' END AS transaction_type FROM raw WHERE issuer = 'Amex' AND export_date IS NOT NULL)"""
)
# The rule as it reads: number repeats inside a file, then keep the last file's row of every (key, repeat number).
_DEDUP = """, numbered AS (SELECT *, row_number() OVER (PARTITION BY file_name, transaction_date, description, amount
    ORDER BY raw_category, transaction_type) AS occurrence FROM staged),
kept AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY transaction_date, description, amount, occurrence
    ORDER BY file_name DESC) = 1)"""
_COLUMNS = (
    "transaction_date, description, raw_category, transaction_type, CAST(amount AS DOUBLE) AS amount, "
    "file_name, count(*) AS copies"
)
_OUT = ["transaction_date", "description", "raw_category", "transaction_type", "amount", "file_name"]


def _staged_raw(s, issuer: str):
    """The raw table a reader returns, with the file name in place of a path."""
    raw = s.raw_export(issuer)
    return cards_columns(raw)


def cards_columns(raw):
    named = [F.col(f"`{c}`").alias(cards.column_name(c)) for c in raw.columns if c != "file_name"]
    return raw.select(*named, F.col("file_name").alias("file_source"))


def _copies(df):
    return df.withColumnRenamed("file_source", "file_name").groupBy(*_OUT).agg(F.count("*").alias("copies"))


@query("w1_w2_chase_dedup", _CHASE_STAGED + _DEDUP + f" SELECT {_COLUMNS} FROM kept GROUP BY ALL")
def chase(s):
    return _copies(silver.chase_transactions(_staged_raw(s, "Chase")))


@query("p3_p5_amex_dedup", _AMEX_STAGED + _DEDUP + f" SELECT {_COLUMNS} FROM kept GROUP BY ALL")
def amex(s):
    return _copies(silver.amex_transactions(_staged_raw(s, "Amex")))


@query(
    "u3_partial_overlap",
    _CHASE_STAGED.replace("SELECT file_name,", "SELECT CASE file_name WHEN 'f3' THEN 'f0' ELSE file_name END AS file_name,")
    + _DEDUP
    + f" SELECT {_COLUMNS} FROM kept GROUP BY ALL",
)
def partial_overlap(s):
    """The file with the repeats comes first by name, so only its extra copies survive."""
    raw = _staged_raw(s, "Chase")
    renamed = F.when(F.col("file_source") == "f3", F.lit("f0")).otherwise(F.col("file_source"))
    return _copies(silver.chase_transactions(raw.withColumn("file_source", renamed)))


@query("p1_p2_p4_p6_chase_clean", _CHASE_STAGED + " SELECT raw_category, transaction_type, " + ", ".join([
    big("count(*)", "n"), big("count(amount)", "good_amounts"), dbl("sum(amount)", "amount"),
    big("sum(length(description))", "text_length")]) + " FROM staged GROUP BY ALL")
def clean(s):
    raw = _staged_raw(s, "Chase").where(silver.export_date("Transaction_Date").isNotNull())
    rows = raw.select(
        F.trim("Description").alias("description"),
        silver.category_or_payment().alias("raw_category"),
        F.trim("Type").alias("transaction_type"),
        silver.safe_numeric("Amount").alias("amount"),
    )
    return rows.groupBy("raw_category", "transaction_type").agg(
        F.count("*").alias("n"),
        F.count("amount").alias("good_amounts"),
        F.sum("amount").alias("amount"),
        F.sum(F.length("description")).alias("text_length"),
    )


def _side(sql: str, letter: str) -> str:
    """The staged, numbered and kept pieces of one issuer, prefixed so both fit in one WITH clause."""
    pieces = (sql + _DEDUP)[len(with_("raw")) :]
    for name in ("staged", "numbered", "kept"):
        pieces = pieces.replace(name, f"{letter}_{name}")
    return pieces


@query(
    "u1_all_transactions",
    with_("raw")
    + _side(_CHASE_STAGED, "c")
    + _side(_AMEX_STAGED, "a")
    + """ SELECT issuer, transaction_type, raw_category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM (
  SELECT 'Amex' AS issuer, * FROM a_kept UNION ALL SELECT 'Chase', * FROM c_kept) GROUP BY ALL""",
)
def union(s):
    both = silver.all_transactions(
        silver.amex_transactions(_staged_raw(s, "Amex")), silver.chase_transactions(_staged_raw(s, "Chase"))
    )
    return both.groupBy("issuer", "transaction_type", "raw_category").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )


# ----- files: derived exports are written to the shared scratch folder, then read as a user reads them -----


def _export_folder(s, issuer: str) -> str:
    folder = scratch_dir(s.spark, f"exports-{issuer.lower()}")
    raw = s.raw_export(issuer)
    raw.write.partitionBy("file_name").options(**cards.EXPORT_OPTIONS).csv(folder)
    return folder


def _file_name(path: str = "file_source"):
    return F.regexp_extract(path, r"file_name=([^/]+)", 1)


@query(
    "s1_s2_chase_csv_scan",
    with_("raw")
    + """SELECT file_name, raw_category, transaction_type, count(*) AS n, CAST(sum(export_amount) AS DOUBLE) AS amount,
  count(export_date) AS dated FROM raw WHERE issuer = 'Chase' GROUP BY ALL""",
)
def chase_scan(s):
    raw = cards.read_exports(s.spark, _export_folder(s, "Chase"), cards.CHASE)
    return (
        raw.withColumn("file_name", _file_name())
        .withColumn("raw_category", silver.category_or_payment())
        .groupBy("file_name", "raw_category", F.col("Type").alias("transaction_type"))
        .agg(
            F.count("*").alias("n"),
            F.sum(silver.safe_numeric("Amount")).alias("amount"),
            F.count("Transaction_Date").alias("dated"),
        )
    )


@query(
    "s1_amex_multiline_scan",
    with_("raw")
    + """SELECT file_name, count(*) AS n, CAST(-sum(export_amount) AS DOUBLE) AS amount,
  count(*) AS two_line_details FROM raw WHERE issuer = 'Amex' GROUP BY ALL""",
)
def amex_scan(s):
    raw = cards.read_exports(s.spark, _export_folder(s, "Amex"), cards.AMEX)
    return (
        raw.withColumn("file_name", _file_name())
        .groupBy("file_name")
        .agg(
            F.count("*").alias("n"),
            F.sum(silver.safe_numeric("Amount")).alias("amount"),
            F.count_if(F.col("Extended_Details").contains("\n")).alias("two_line_details"),
        )
    )


PERSONAL = ("Card Member", "Account #", "Address", "City/State", "Zip Code", "Not A Column")


@query(
    "s3_landing_without_personal",
    with_("raw") + "SELECT 'Date,Description,Amount,Extended Details,Appears On Your Statement As,Country,Reference,Category'"
    " AS columns, count(*) AS n, CAST(-sum(export_amount) AS DOUBLE) AS amount FROM raw WHERE issuer = 'Amex'",
)
def landing(s):
    landed = scratch_dir(s.spark, "landed")
    for part in ("f1", "f2", "f3"):
        source = f"{_amex_folder(s)}/file_name={part}"
        cards.land_exports(s.spark, source, landed, cards.AMEX, PERSONAL)
    kept = [c for c in cards.AMEX.columns if c not in PERSONAL]
    raw = cards.read_exports(s.spark, landed, cards.AMEX, PERSONAL)
    return raw.agg(
        F.lit(",".join(kept)).alias("columns"),
        F.count("*").alias("n"),
        F.sum(silver.safe_numeric("Amount")).alias("amount"),
    )


def _amex_folder(s) -> str:
    if not hasattr(s, "_amex"):
        s._amex = _export_folder(s, "Amex")
    return s._amex


@query(
    "s5_all_issuers",
    with_("raw") + "SELECT issuer, count(*) AS n, sum(CASE WHEN issuer = 'Chase' THEN 1 ELSE 0 END)::BIGINT AS typed_rows "
    "FROM raw GROUP BY 1",
)
def all_issuers(s):
    config = {"Chase": {"path": _export_folder(s, "Chase")}, "Amex": {"path": _amex_folder(s)}}
    both = cards.read_all_issuers(s.spark, config)
    return both.groupBy("issuer").agg(F.count("*").alias("n"), F.count("Type").alias("typed_rows"))


@query(
    "s6_s7_fact_table_round_trip",
    with_("fact") + "SELECT issuer, category, parent_group, transaction_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount "
    "FROM fact WHERE transaction_date >= DATE '1999-11-01' GROUP BY ALL",
)
def round_trip(s):
    from outlay.queries.base import TODAY

    path = scratch_dir(s.spark, "gold-facts")
    tables.write_table(s.facts, path, "transaction_month")
    facts = tables.read_facts(s.spark, path, today=TODAY)
    return facts.groupBy("issuer", "category", "parent_group", "transaction_type").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )


@query(
    "s8_analysis_frame",
    with_("fact")
    + """SELECT category, parent_group, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
  CAST(isodow(transaction_date) - 1 AS BIGINT) AS weekday, count(*) AS n, CAST(sum(-amount) AS DOUBLE) AS spend
  FROM (SELECT issuer, transaction_date, CASE WHEN category = 'Travel' THEN 'Other' ELSE category END AS category,
    CASE WHEN parent_group = 'Needs' THEN 'Payments & Others' ELSE parent_group END AS parent_group,
    CASE WHEN issuer = 'Amex' AND transaction_type = 'Sale' THEN 0 ELSE amount END AS amount FROM fact) GROUP BY ALL""",
)
def analysis_frame(s):
    """Blank category, null group and unreadable amounts take their defaults."""
    rough = s.facts.withColumns(
        {
            "category": F.when(F.col("category") == "Travel", F.lit("")).otherwise(F.col("category")),
            "parent_group": F.when(F.col("parent_group") != "Needs", F.col("parent_group")),
            "amount": F.when(
                (F.col("issuer") == "Amex") & (F.col("transaction_type") == "Sale"), F.lit("n/a")
            ).otherwise(F.col("amount").cast("string")),
        }
    )
    return (
        tables.analysis_frame(rough)
        .groupBy("category", "parent_group", "month", "weekday")
        .agg(F.count("*").alias("n"), F.sum("spend").alias("spend"))
    )


@query(
    "s15_plain_rows",
    with_("fact")
    + """SELECT issuer, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, description,
  CAST(amount AS DOUBLE) AS amount, category FROM fact""",
)
def plain_rows(s):
    return tables.plain_rows(s.facts.select("issuer", "transaction_date", "description", "amount", "category"))
