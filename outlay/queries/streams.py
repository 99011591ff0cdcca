"""Structured Streaming queries: files at hand are read to the end, the result is a stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import silver
from outlay.queries.base import query, with_
from outlay.session import scratch_dir
from outlay.sources import cards
from outlay.streaming.landing import land_new_exports
from outlay.streaming.live import compact, current_state, follow_runs, run_state


def _state_events(s):
    t = s.trace
    return t.select(
        "run_id", F.col("event_id").alias("seq"), "event", "role",
        F.col("validation_cycle").alias("cycle"), (F.col("event_id") % 3).alias("round"), "error_count",
        F.lit(None).cast("long").alias("repeated_error_count"), F.lit(None).cast("long").alias("rebuttal_count"),
        F.lit(None).cast("string").alias("error"), F.col("cost_usd").cast("double").alias("cost_usd"),
    )


_STATE = (
    with_("trace")
    + """, p AS (SELECT *, CASE WHEN event = 'agent_round' THEN 'author' WHEN event = 'model_call' THEN role || '_model_call'
    WHEN event IN ('tool_call', 'tool_error') THEN 'tools' END AS phase FROM trace)
  SELECT run_id, last(event ORDER BY event_id) AS last_event, last(phase ORDER BY event_id) FILTER (phase IS NOT NULL) AS phase,
  last(event_id % 3 ORDER BY event_id) FILTER (event = 'agent_round') AS agent_round, count(*) FILTER (event = 'tool_call') AS tool_calls,
  last(error_count ORDER BY event_id) FILTER (event = 'validation_cycle_result') AS last_validation_error_count,
  CAST(sum(cost_usd) FILTER (event IN ('model_response', 'model_call_failed')) AS DOUBLE) AS cost_usd FROM p GROUP BY 1"""
)
_SHOWN = ["run_id", "last_event", "phase", "agent_round", "tool_calls", "last_validation_error_count", "cost_usd"]


@query("t2_run_state_stream", _STATE)
def stream(s):
    """Events arrive in several files and batches; the newest state per run is read from the stored batches."""
    source, target, checkpoint = (scratch_dir(s.spark, n) for n in ("events", "state", "checkpoint"))
    _state_events(s).repartition(6, "seq").write.json(source)
    follow_runs(s.spark, source, target, checkpoint, files_per_batch=2).awaitTermination()
    return current_state(s.spark, target).select(*_SHOWN)


@query("t2_compacted_state", _STATE)
def compacted(s):
    """Half of the events, a compacted version, then the rest: the state is read from the version and the batches after it."""
    source, target, checkpoint = (scratch_dir(s.spark, n) for n in ("events", "state", "checkpoint"))
    for half in (0, 1):
        _state_events(s).where(F.col("seq") % 2 == half).repartition(2, "seq").write.mode("append").json(source)
        follow_runs(s.spark, source, target, checkpoint, files_per_batch=1).awaitTermination()
        if half == 0:
            compact(s.spark, target)
    return current_state(s.spark, target).select(*_SHOWN)


@query("t3_run_state_batch", _STATE)
def batch(s):
    return run_state(_state_events(s)).select(*_SHOWN)


@query(
    "t1_s4_landing_stream",
    with_("raw") + "SELECT count(*) AS n, CAST(-sum(export_amount) AS DOUBLE) AS amount, FALSE AS has_member FROM raw WHERE issuer = 'Amex'",
)
def landing(s):
    """Two runs over a growing folder: the second lands the new files only."""
    source, target, checkpoint, archive = (scratch_dir(s.spark, n) for n in ("incoming", "landed", "checkpoint", "archive"))
    raw = s.raw_export("Amex")
    personal = ("Card Member", "Account #")
    for part in ("file_name = 'f1'", "file_name <> 'f1'"):
        rows = raw.where(part).drop("file_name")
        rows.write.mode("append").options(**cards.EXPORT_OPTIONS).csv(source)
        land_new_exports(s.spark, source, target, checkpoint, cards.AMEX, personal, archive).awaitTermination()
    landed = cards.read_exports(s.spark, target, cards.AMEX, personal)
    return landed.agg(
        F.count("*").alias("n"),
        F.sum(silver.safe_numeric("Amount")).alias("amount"),
        F.lit("Card_Member" in landed.columns).alias("has_member"),
    )
