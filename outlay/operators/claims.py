"""Amounts and percentages written in a text that match no known number within the precision they are written with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How amounts and percentages are written.
DOLLAR = r"(?<![\w.])(-?)\$\s?(-?)(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?\s?([kKmM])?(?![\w])"
PERCENT = r"(?<![\w.$])(-?)(\d+(?:\.\d+)?)\s?%"
SLACK = 1e-9


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def written_claims(texts: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """(key, position, claim, value, tolerance) of every amount and percentage; signs are ignored."""
    t = F.coalesce(F.col(text), F.lit(""))
    dollars = F.arrays_zip(
        _all(t, DOLLAR, 0).alias("claim"),
        _all(t, DOLLAR, 3).alias("whole"),
        _all(t, DOLLAR, 4).alias("fraction"),
        _all(t, DOLLAR, 5).alias("suffix"),
    )
    percents = F.arrays_zip(_all(t, PERCENT, 0).alias("claim"), _all(t, PERCENT, 2).alias("whole"))

    def dollar(x: Column) -> Column:
        suffix = F.lower(x["suffix"])
        scale = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).otherwise(1.0)
        decimals = F.greatest(F.lit(0), F.length(x["fraction"]) - 1)
        number = F.concat(F.regexp_replace(x["whole"], ",", ""), x["fraction"]).cast("double")
        return F.struct(
            F.trim(x["claim"]).alias("claim"),
            (number * scale).alias("value"),
            F.greatest(0.5 * F.pow(F.lit(10.0), -decimals) * scale, F.lit(0.01)).alias("tolerance"),
        )

    def percent(x: Column) -> Column:
        decimals = F.length(F.regexp_extract(x["whole"], r"\.(\d+)", 1))
        return F.struct(
            F.trim(x["claim"]).alias("claim"),
            x["whole"].cast("double").alias("value"),
            (0.5 * F.pow(F.lit(10.0), -decimals)).alias("tolerance"),
        )

    both = F.concat(F.transform(dollars, dollar), F.transform(percents, percent))
    return texts.select(key, F.posexplode(both).alias("position", "c")).select(key, "position", "c.*")


def unmatched_claims(claims: DataFrame, known: DataFrame, key: str = "report_id", number: str = "number") -> DataFrame:
    """Claims without a known number of the same key within their tolerance.

    Numbers go into cells as wide as the tolerance window. A window is never wider than a cell, so a cell holds a
    match exactly when its smallest or largest number is one: two numbers per cell replace all pairs, whatever the
    number of values behind one key.

    Claims come out of texts, so the planner cannot tell their number and takes a table of millions for a few MB: the
    joins are sort-merge joins by name, and nothing is sent to the driver.
    """
    width = F.col("tolerance") * 2
    classes = claims.select(key, "tolerance").distinct()
    values = known.select(key, F.abs(F.col(number).cast("double")).alias("n")).where(
        F.col("n").isNotNull() & ~F.isnan("n")
    )
    cells = (
        values.join(classes.hint("merge"), key)
        .withColumn("cell", F.floor(F.col("n") / width))
        .groupBy(key, "tolerance", "cell")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"))
    )
    reach = F.col("tolerance") + SLACK
    spans = F.sequence(
        F.floor((F.col("value") - reach) / width).cast("long"), F.floor((F.col("value") + reach) / width).cast("long")
    )
    tried = claims.withColumn("cell", F.explode(spans)).join(cells.hint("merge"), [key, "tolerance", "cell"])
    near = (F.abs(F.col("low") - F.col("value")) <= reach) | (F.abs(F.col("high") - F.col("value")) <= reach)
    found = tried.where(near).select(key, "position").distinct()
    return claims.join(found.hint("merge"), [key, "position"], "left_anti")


def narrative_problems(texts: DataFrame, known: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """(key, problem) for every number in a text that the known numbers do not support."""
    bad = unmatched_claims(written_claims(texts, key, text), known, key)
    said = F.concat("claim", F.lit(" does not match any value in the analysis summary."))
    return bad.select(key, "position", said.alias("problem"))
