"""Live state of runs from their events.

A run's state is mergeable: counts and sums add up, and last values are greatest (seq, value) structs. So the stream keeps no
state of its own: every batch is reduced to one row for each run in it and appended, however late its events are. The
state table merges what was appended; ``compact`` writes a merged version, and readers take the newest version and the
batches after it. One reduction serves batch and stream, so both give the same rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.plans.runs import COST_EVENTS

EVENT_SCHEMA = (
    "run_id string, seq long, event string, role string, cycle long, round long, error_count long, "
    "repeated_error_count long, rebuttal_count long, error string, cost_usd double"
)
#: Values that the last event of some kind tells, and values that add up.
LAST = (
    "last_event", "phase", "agent_round", "validation_cycle", "last_validation_error_count", "last_repeated_error_count", "budget_exceeded",
)
ADDED = ("tool_calls", "stalled_validation_cycles", "author_rebuttals", "cost_usd")
COLUMNS = (
    "last_event", "phase", "agent_round", "validation_cycle", "tool_calls", "stalled_validation_cycles", "author_rebuttals",
    "last_validation_error_count", "last_repeated_error_count", "budget_exceeded", "cost_usd",
)


def partial_state(events: DataFrame) -> DataFrame:
    """One mergeable row per run of any part of the events. ``seq`` orders the events of a run."""
    event = F.col("event")

    def last(value: Column, test: Column) -> Column:
        return F.max(F.when(test, F.struct(F.col("seq").alias("seq"), value.alias("v"))))

    phase = (
        F.when(event == "agent_round", F.lit("author"))
        .when(event == "model_call", F.concat(F.coalesce("role", F.lit("None")), F.lit("_model_call")))
        .when(event.isin("tool_call", "tool_error"), F.lit("tools"))
        .when(event == "validation_cycle_start", F.lit("validation"))
        .when(event == "run_completed", F.lit("completed"))
        .when(event == "run_aborted", F.lit("aborted"))
    )
    result = event == "validation_cycle_result"
    rebuttals = F.when(event == "author_rebuttals", F.coalesce("rebuttal_count", F.lit(0))).otherwise(0)
    values = {
        "last_event": last(event, F.lit(True)),
        "phase": last(phase, phase.isNotNull()),
        "agent_round": last(F.col("round"), event == "agent_round"),
        "validation_cycle": last(F.col("cycle"), event == "validation_cycle_start"),
        "last_validation_error_count": last(F.col("error_count"), result & F.col("error_count").isNotNull()),
        "last_repeated_error_count": last(F.col("repeated_error_count"), result),
        "budget_exceeded": last(F.col("error"), event == "budget_exceeded"),
        "tool_calls": F.count_if(event == "tool_call"),
        "stalled_validation_cycles": F.count_if(event == "validation_stalled"),
        "author_rebuttals": F.sum(rebuttals),
        "cost_usd": F.sum(F.when(event.isin(*COST_EVENTS), F.col("cost_usd").cast("decimal(20,6)"))),
    }
    kept = {name: values[name].cast("decimal(38,6)") if name == "cost_usd" else values[name] for name in COLUMNS}
    return events.groupBy("run_id").agg(*[value.alias(name) for name, value in kept.items()])


def merged(parts: DataFrame) -> DataFrame:
    """Partial states of the same runs, merged."""
    return parts.groupBy("run_id").agg(*[(F.max(c) if c in LAST else F.sum(c).cast("decimal(38,6)") if c == "cost_usd" else F.sum(c)).alias(c) for c in COLUMNS])


def shown(state: DataFrame) -> DataFrame:
    """The values of a state without their places."""
    return state.select("run_id", *[F.col(f"{c}.v").alias(c) if c in LAST else F.col(c) for c in COLUMNS])


def run_state(events: DataFrame) -> DataFrame:
    """Last phase, last event, counters and summed cost per run."""
    return shown(partial_state(events))


def follow_runs(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100):
    """Start the stream: the partial states of every batch are written to ``target`` under its number.

    Nothing is held on the driver or in a state store. Re-running a batch after a failure writes the same rows to the same
    folder, so a batch counts once. The caller stops the query or waits for it; it ends when the files at hand are read.
    """
    events = (
        spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
    )

    def save(batch: DataFrame, number: int) -> None:
        partial_state(batch).write.mode("overwrite").parquet(f"{target}/batches/batch={number}")

    return (
        events.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/batches")


def _versions(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{target}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _newest(versions: DataFrame | None) -> int:
    """The last batch of the newest version, from the names of folders; -1 without one."""
    found = versions.agg(F.max("upto").alias("n")).first().n if versions is not None else None
    return -1 if found is None else found


def _state(spark: SparkSession, target: str, last: int | None = None) -> DataFrame:
    versions = _versions(spark, target)
    newest = _newest(versions)
    after = _batches(spark, target).where(F.col("batch") > newest)
    parts = (after if last is None else after.where(F.col("batch") <= last)).drop("batch")
    return merged(parts if newest < 0 else parts.unionByName(versions.where(F.col("upto") == newest).drop("upto")))


def compact(spark: SparkSession, target: str) -> int:
    """Write a version with all batches at hand merged; returns its last batch. Batches that arrive meanwhile come after it.

    Versions and batches before it are no longer read and may be deleted once no reader of theirs is left.
    """
    last = _batches(spark, target).agg(F.max("batch").alias("n")).first().n
    if last is not None and last > _newest(_versions(spark, target)):
        _state(spark, target, last).write.mode("overwrite").parquet(f"{target}/versions/upto={last}")
    return last


def current_state(spark: SparkSession, target: str) -> DataFrame:
    """Newest state of every run: one version and the batches after it."""
    return shown(_state(spark, target))
