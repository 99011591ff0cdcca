"""Cost ledger totals and the check whether a call may still be made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.functions.pricing import worst_case_usd

# Run names that are not a run of their own, and the default caps in USD.
GENERIC_RUNS = ("replay", "compare", "chat", "other")
DAILY_CAP, RUN_CAP = 15.0, 5.0
MICRO = "decimal(20,6)"


def _total(column: str = "cost_usd"):
    return F.coalesce(F.sum(F.coalesce(F.col(column).cast(MICRO), F.lit(0))), F.lit(0)).cast(MICRO)


def spend_by_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("date").agg(_total().alias("cost_usd"))


def spend_by_run(ledger: DataFrame) -> DataFrame:
    """Recorded cost per run; records without a run are left out."""
    named = ledger.where(F.col("run_id").isNotNull() & (F.col("run_id") != ""))
    return named.groupBy("run_id").agg(_total().alias("cost_usd"))


def spend_on(ledger: DataFrame, day: str) -> DataFrame:
    """One row: cost recorded on a date."""
    return ledger.where(F.col("date") == day).agg(_total().alias("cost_usd"))


def spend_for(ledger: DataFrame, run_id: str) -> DataFrame:
    """One row: cost recorded for a run."""
    return ledger.where(F.col("run_id") == run_id).agg(_total().alias("cost_usd"))


def budget_check(
    ledger: DataFrame, calls: DataFrame, daily_cap: float | None = DAILY_CAP, run_cap: float | None = RUN_CAP
) -> DataFrame:
    """Each planned call with its worst case, what its day and run have spent, and the cap it could pass, if any.

    ``calls``: date, run_id, model, prompt_chars, max_tokens, and session_spent for the generic run names, which are
    measured by their own session. A cap of None is off. The totals are one row per day and per run; their joins are
    left to the planner, which broadcasts them when small and splits hot keys when not.
    """
    worst = worst_case_usd("model", "prompt_chars", "max_tokens").cast(MICRO)
    days = spend_by_day(ledger).withColumnRenamed("cost_usd", "_day")
    runs = spend_by_run(ledger).withColumnRenamed("cost_usd", "_run")
    rows = calls.join(days, "date", "left").join(runs, "run_id", "left")
    zero = F.lit(0).cast(MICRO)
    session = F.col("session_spent").cast(MICRO) if "session_spent" in calls.columns else zero
    spent_run = F.when(F.col("run_id").isin(*GENERIC_RUNS), session).otherwise(F.col("_run"))
    rows = rows.withColumns(
        {
            "worst_case_usd": worst,
            "spent_today_usd": F.coalesce("_day", zero),
            "spent_run_usd": F.coalesce(spent_run, zero),
        }
    ).drop("_day", "_run")
    over = F
    for name, cap, spent in (("daily", daily_cap, "spent_today_usd"), ("run", run_cap, "spent_run_usd")):
        if cap is not None:
            over = over.when(F.col(spent) + F.col("worst_case_usd") > F.lit(str(cap)).cast(MICRO), F.lit(name))
    cap_column = F.lit(None).cast("string") if over is F else over
    return rows.withColumn("cap", cap_column).withColumn("allowed", F.col("cap").isNull())
