"""Run reports from trace events and run documents.

What a report says of a run is gathered in one grouping: counts and sums, and first and last values as least and greatest
(place, value) structs, which merge map-side whatever the order of the rows.

Events carry ``run_id`` and ``order``, a list of columns that orders a run; ``bucket`` is a column that never falls
along that order (a file offset, an hour), used to cut very long runs into pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.stamps import (
    first_recorded,
    from_epoch,
    from_iso,
    instant_text,
    model_label,
    role_model,
    seconds_between,
)
from outlay.operators.ordered import neighbours

# Events that carry cost, that are worth listing, and the fields kept for those.
COST_EVENTS = ("model_response", "model_call_failed")
NOTABLE_EVENTS = (
    "validation_stalled", "author_rebuttals", "author_rebuttals_ignored", "run_deadline_exceeded",
    "agent_rounds_exhausted", "model_call_failed", "model_call_retry", "model_unavailable",
    "report_sanitization_failed", "author_format_retry", "validator_format_retry", "tool_error", "exception",
    "run_aborted",
)
EVENT_FIELDS = (
    "role", "phase", "cycle", "responding_to_cycle", "attempt", "error_type", "exception_type", "error", "reason",
    "repeated_error_count", "rebuttal_count", "elapsed_seconds", "limit_seconds", "max_agent_rounds", "category",
    "name", "response_chars",
)
ORDER = ["block", "line"]
FAILED_SUFFIX = "_failed"


def _is(event: str) -> Column:
    return F.col("event") == event


def run_counters(events: DataFrame) -> DataFrame:
    """Rounds, tool calls, review cycles, validator calls and format retries of every run."""
    validator = _is("model_call") & (F.col("role") == "validator")
    return events.groupBy("run_id").agg(
        F.count_if(_is("agent_round")).alias("agent_rounds"),
        F.count_if(_is("tool_call")).alias("tool_calls"),
        F.count_if(_is("validation_cycle_result")).alias("validation_cycles"),
        F.count_if(validator).alias("validator_calls"),
        F.count_if(_is("author_format_retry")).alias("author_format_retries"),
        F.count_if(_is("validator_format_retry")).alias("validator_format_retries"),
    )


def error_trend(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """First and last error count of a run's reviews, the reduction, and how many reviews got better or worse."""
    rows = events.where(_is("validation_progress"))
    place = F.struct(*order)
    return rows.groupBy("run_id").agg(
        F.min_by("error_count", place).alias("initial_validation_errors"),
        F.max_by("error_count", place).alias("final_validation_errors"),
        F.count_if(F.col("error_count_delta") > 0).alias("validation_cycles_improved"),
        F.count_if(F.col("error_count_delta") < 0).alias("validation_cycles_regressed"),
    ).withColumn(
        "validation_error_reduction", F.col("initial_validation_errors") - F.col("final_validation_errors")
    )


def cost_from_events(events: DataFrame) -> DataFrame:
    """Recorded cost per run, six places; null for a run without any costed call."""
    cost = F.when(F.col("event").isin(*COST_EVENTS), F.col("cost_usd").cast("decimal(20,6)"))
    return events.groupBy("run_id").agg(F.sum(cost).alias("cost_usd"))


def first_and_last_times(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Time of a run's first and of its last event, by position and not by value."""
    place = F.struct(*order)
    return events.groupBy("run_id").agg(
        F.min_by("timestamp", place).alias("first_time"), F.max_by("timestamp", place).alias("last_time")
    )


def paired_calls(events: DataFrame, order: list[str] = ORDER, bucket: str = "block") -> DataFrame:
    """Model calls with their answers.

    An answer belongs to the latest call of its role that is still open, so exactly when the event just before it in
    (run, role) is a call; a second call replaces the first. A call with nothing after it got no response. Where the events
    carry them, answers also tell their size, a parse status other than ok, and tokens read from the cache.
    """
    response = _is("model_response")
    more = {
        "response_chars": F.col("response_chars") if "response_chars" in events.columns else None,
        "parse_status": F.when(response & (F.col("parse_status") != "ok"), F.col("parse_status")) if "parse_status" in events.columns else None,
        "cache_read_tokens": F.nullif(F.col("usage.cache_read_input_tokens"), F.lit(0)) if "usage" in events.columns else None,
    }
    more = {name: value for name, value in more.items() if value is not None}
    kept = [c for c in ("prompt_chars", "validation_cycle") if c in events.columns]
    rows = events.where(F.col("event").isin("model_call", *COST_EVENTS))
    rows = rows.withColumn("role", F.coalesce("role", F.lit("")))
    near = neighbours(rows, ["run_id", "role"], bucket, order, ["event", *kept])
    called = F.col("prev.event") == "model_call"
    answered = near.where(~_is("model_call")).select(
        "run_id",
        "role",
        *order,
        *[F.when(called, F.col(f"prev.{c}")).alias(c) for c in kept],
        F.col("elapsed_seconds").cast("double").alias("seconds"),
        F.col("prompt_eval_count").alias("in_tokens"),
        F.col("eval_count").alias("out_tokens"),
        F.when(_is("model_response"), F.col("done_reason")).otherwise(F.lit("failed")).alias("done_reason"),
        F.coalesce(called, F.lit(False)).alias("paired"),
        *[value.alias(name) for name, value in more.items()],
    )
    open_calls = near.where(_is("model_call") & F.col("next").isNull()).select(
        "run_id",
        "role",
        *order,
        *kept,
        F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("long").alias("in_tokens"),
        F.lit(None).cast("long").alias("out_tokens"),
        F.lit("no_response").alias("done_reason"),
        F.lit(False).alias("paired"),
    )
    return answered.unionByName(open_calls, allowMissingColumns=True)


def review_details(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Every review cycle's result: decision, stage, counts, summary, and its errors (category, message, evidence) in order.

    A finding without a severity counts as an error.
    """
    fields = ("cycle", "decision", "stage", "error_count", "warning_count", "repeated_error_count", "resolved_finding_count", "summary")
    errors = F.transform(
        F.filter(F.coalesce("findings", F.array().cast(events.schema["findings"].dataType)), lambda f: F.coalesce(f["severity"], F.lit("error")) == "error"),
        lambda f: F.struct(f["category"].alias("category"), f["message"].alias("message"), f["evidence"].alias("evidence")),
    )
    return events.where(_is("validation_cycle_result")).select("run_id", *order, *[f for f in fields if f in events.columns], errors.alias("errors"))


def call_totals(calls: DataFrame) -> DataFrame:
    """Calls, seconds, tokens, length stops and failures per run and role."""
    seconds = F.coalesce(F.col("seconds").cast("decimal(20,6)"), F.lit(0))
    out = F.coalesce("out_tokens", F.lit(0))
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown"))
    return calls.groupBy("run_id", role.alias("role")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum(seconds), 1).alias("seconds"),
        F.round(F.max(seconds), 1).alias("max_seconds"),
        F.sum(F.coalesce("in_tokens", F.lit(0))).alias("in_tokens"),
        F.sum(out).alias("out_tokens"),
        F.max(out).alias("max_out_tokens"),
        F.count_if(F.col("done_reason") == "length").alias("length_stops"),
        F.count_if(F.col("done_reason").isin("failed", "no_response")).alias("failed"),
    )


def tool_counts(events: DataFrame) -> DataFrame:
    return events.where(_is("tool_call")).groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("uses"))


def notable_events(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Events worth listing, with the fields a reader needs."""
    kept = [c for c in EVENT_FIELDS if c in events.columns and c not in order]
    return events.where(F.col("event").isin(*NOTABLE_EVENTS)).select("run_id", *order, "event", *kept)


def first_reviews(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """First validator call of every review cycle, first attempts only."""
    rows = events.where(_is("model_call") & (F.col("role") == "validator"))
    rows = rows.where(F.col("validation_cycle").isNotNull() & (F.col("attempt").isNull() | (F.col("attempt") == 1)))
    return rows.groupBy("run_id", "validation_cycle").agg(
        F.min_by(F.struct(*order, *[c for c in ("prompt_chars", "model") if c in events.columns]), F.struct(*order)).alias("c")
    ).select("run_id", "validation_cycle", "c.*")


def selected_review(reviews: DataFrame, cycle: int | None = None, order: list[str] = ORDER) -> DataFrame:
    """The review of a given cycle, or of each run's last one in call order."""
    if cycle is not None:
        return reviews.where(F.col("validation_cycle") == cycle)
    others = [c for c in reviews.columns if c != "run_id"]
    return reviews.groupBy("run_id").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("c")).select("run_id", "c.*")


#: What a role's calls add up to, in the order of ``call_totals``.
CALL_FIELDS = ("calls", "seconds", "max_seconds", "in_tokens", "out_tokens", "max_out_tokens", "length_stops", "failed")


def run_summary(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """One row per run: counters, error trend, cost, times, per-role call totals and tool uses as maps.

    One scan: events are reduced by (run, role of a call, tool), then by run. Totals of calls need no pairing: every
    answer counts, and a role's last call is open exactly when nothing of that role follows it.
    """
    event, place = F.col("event"), F.struct(*order)
    answer, call, progress = event.isin(*COST_EVENTS), _is("model_call"), _is("validation_progress")
    role = F.when(answer | call, F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")))
    tool = F.when(_is("tool_call"), F.coalesce("name", F.lit("None")))
    out = F.when(answer, F.coalesce("eval_count", F.lit(0)))
    done = F.when(_is("model_call_failed"), F.lit("failed")).otherwise(F.col("done_reason"))
    seconds = F.when(answer, F.coalesce(F.col("elapsed_seconds").cast("double").cast("decimal(20,6)"), F.lit(0)))
    at = lambda value: F.struct(place.alias("at"), value.alias("v"))
    counters = {
        "agent_rounds": _is("agent_round"), "tool_calls": _is("tool_call"), "validation_cycles": _is("validation_cycle_result"),
        "validator_calls": call & (F.col("role") == "validator"), "author_format_retries": _is("author_format_retry"),
        "validator_format_retries": _is("validator_format_retry"), "notable_events": event.isin(*NOTABLE_EVENTS),
        "_reviews": progress, "validation_cycles_improved": progress & (F.col("error_count_delta") > 0),
        "validation_cycles_regressed": progress & (F.col("error_count_delta") < 0),
        "calls": answer, "length_stops": answer & (done == "length"), "failed": answer & done.isin("failed", "no_response"),
    }
    sums = {"cost_usd": F.when(answer, F.col("cost_usd").cast("decimal(20,6)")), "seconds": seconds, "in_tokens": F.when(answer, F.coalesce("prompt_eval_count", F.lit(0))), "out_tokens": out}
    tops = {"max_seconds": seconds, "max_out_tokens": out, "_last": at(F.col("timestamp")), "_last_call": F.when(answer | call, at(call)), "_last_review": F.when(progress, at(F.col("error_count")))}
    lows = {"_first": at(F.col("timestamp")), "_first_review": F.when(progress, at(F.col("error_count")))}
    if "resolved_findings" in events.columns:
        tops["_resolved"] = F.when(progress & F.col("resolved_findings").isNotNull(), at(F.size("resolved_findings")))
    parts = events.groupBy("run_id", role.alias("_role"), tool.alias("_tool")).agg(
        *[F.count_if(test).alias(name) for name, test in counters.items()],
        *[F.sum(value).alias(name) for name, value in sums.items()],
        *[F.max(value).alias(name) for name, value in tops.items()],
        *[F.min(value).alias(name) for name, value in lows.items()],
    )
    # At most one row for each role and tool of a run reaches the second step.
    pending = F.when(F.col("_last_call.v"), 1).otherwise(0)
    count = lambda x: F.coalesce(F.col(x), F.lit(0))
    total = F.struct(
        (F.col("calls") + pending).alias("calls"), F.round(count("seconds"), 1).alias("seconds"), F.round(count("max_seconds"), 1).alias("max_seconds"),
        count("in_tokens").alias("in_tokens"), count("out_tokens").alias("out_tokens"), count("max_out_tokens").alias("max_out_tokens"),
        "length_stops", (F.col("failed") + pending).alias("failed"),
    )
    mine = [c for c in counters if c not in CALL_FIELDS]
    listed = lambda key, value: F.array_sort(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), value.alias("v")))))
    runs = parts.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in mine],
        F.sum("cost_usd").alias("cost_usd"),
        *[F.max(c).alias(c) for c in tops if c.startswith("_") and c != "_last_call"],
        *[F.min(c).alias(c) for c in lows],
        listed("_role", total).alias("_calls"),
        listed("_tool", F.col("tool_calls")).alias("_tools"),
    )
    reviewed = F.col("_reviews") > 0
    entries = lambda c: F.when(F.size(c) > 0, F.map_from_entries(c))
    more = [F.coalesce("_resolved.v", F.lit(0)).alias("resolved_findings_at_end")] if "_resolved" in runs.columns else []
    first, last = F.col("_first_review.v"), F.col("_last_review.v")
    return runs.select(
        "run_id", *[c for c in mine if not c.startswith(("_", "validation_cycles_", "notable"))],
        first.alias("initial_validation_errors"), last.alias("final_validation_errors"),
        *[F.when(reviewed, F.col(c)).alias(c) for c in ("validation_cycles_improved", "validation_cycles_regressed")],
        (first - last).alias("validation_error_reduction"), "cost_usd", F.col("_first.v").alias("first_time"), F.col("_last.v").alias("last_time"),
        entries("_calls").alias("calls"), entries("_tools").alias("tools"), "notable_events", *more,
    )


# ----- index -----


#: The sources of a run's entry: metrics, progress, run manifest, start event, times of the trace, cost in the ledger.
SOURCES = ("m", "p", "r", "s", "t", "l")


def ledger_entries(spend: DataFrame) -> DataFrame:
    """(run_id, own, alias): spend under a run's name, and under its name without the failed suffix, from one scan."""
    cost, none = F.col("cost_usd"), F.lit(None).cast(spend.schema["cost_usd"].dataType)
    names = F.array(
        F.struct(F.col("run_id").alias("run_id"), cost.alias("own"), none.alias("alias")),
        F.struct(F.concat("run_id", F.lit(FAILED_SUFFIX)).alias("run_id"), none.alias("own"), cost.alias("alias")),
    )
    return spend.select(F.inline(names)).groupBy("run_id").agg(F.max("own").alias("own"), F.max("alias").alias("alias"))


def merged(**sources: DataFrame) -> DataFrame:
    """(run_id, one struct column for each source): tables with one row per run met in a single grouping, each read once."""
    parts = [df.select("run_id", F.struct(*[c for c in df.columns if c != "run_id"]).alias(name)) for name, df in sources.items()]
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return tall.groupBy("run_id").agg(*[F.any_value(name, True).alias(name) for name in sources])


METRIC_FIELDS = {
    "model": "string", "validator_model": "string", "author_provider": "string", "validator_provider": "string",
    "mode": "string", "guidance": "string", "status": "string", "validation": "string", "runtime_seconds": "double",
    "agent_rounds": "bigint", "tool_calls": "bigint", "validation_cycles": "bigint", "validator_calls": "bigint",
    "author_format_retries": "bigint", "validator_format_retries": "bigint",
    "initial_validation_errors": "bigint", "final_validation_errors": "bigint",
    "validation_error_reduction": "bigint", "validation_cycles_improved": "bigint",
    "validation_cycles_regressed": "bigint", "report_bytes": "bigint", "anthropic_cost_usd": "double",
}
_ROLE = "struct<provider:string,model:string>"
PROGRESS_FIELDS = {
    "status": "string", "started_at": "string", "updated_at": "string", "elapsed_seconds": "double",
    "tool_calls": "bigint", "anthropic_cost_usd": "double", "model": "string", "validator_model": "string",
    "author_provider": "string", "validator_provider": "string", "guidance": "string",
    "author_role": _ROLE, "validator_role": _ROLE,
}
MANIFEST_FIELDS = {"author_role": _ROLE, "validator_role": _ROLE, "guidance": "string", "status": "string"}
STARTED_FIELDS = ("author_provider", "author_model", "validator_provider", "validator_model")


def run_index(
    metrics: DataFrame,
    progress: DataFrame,
    manifest: DataFrame,
    started: DataFrame,
    trace_times: DataFrame,
    spend: DataFrame,
) -> DataFrame:
    """One row per run, newest name first: times, models, guidance, status, cost and recorded metrics.

    ``started`` holds the provider and model fields of each run's start event; ``spend`` the ledger cost per run.
    """

    every = {"m": metrics, "p": progress, "r": manifest, "s": started, "t": trace_times, "l": ledger_entries(spend)}
    return indexed(merged(**every))


def indexed(state: DataFrame) -> DataFrame:
    """The index from one row per run with a struct column for each of ``SOURCES``, null where a run has none.

    Progress names the start, and the end once it is final; without it the first and last trace events do. A run is running
    while its progress says so and it has no metrics. Its cost is the recorded one, else the ledger's.
    """
    m, p, t = F.col("m"), F.col("p"), F.col("t")
    has_metrics = m.isNotNull()
    running = F.coalesce((p["status"] == "running") & ~has_metrics, F.lit(False))
    final = F.when(F.coalesce(p["status"] != "running", F.lit(True)), from_iso(p["updated_at"]))
    start = F.coalesce(from_iso(p["started_at"]), from_epoch(t["first_time"]))
    end = F.when(~running, F.coalesce(final, from_epoch(t["last_time"])))
    rows = state.where(has_metrics | p.isNotNull()).withColumns({"_start": start, "_end": end})
    cost = F.coalesce(m["anthropic_cost_usd"], p["anthropic_cost_usd"], F.coalesce(F.col("l.own"), F.col("l.alias")).cast("double"))
    labels = {}
    for role, flat in (("author", "model"), ("validator", "validator_model")):
        provider, model = role_model(
            (F.col(f"r.{role}_role.provider"), F.col(f"r.{role}_role.model")),
            (F.col(f"p.{role}_role.provider"), F.col(f"p.{role}_role.model")),
            (m[f"{role}_provider"], m[flat]),
            (p[f"{role}_provider"], p[flat]),
            (F.col(f"s.{role}_provider"), F.col(f"s.{role}_model")),
        )
        labels[f"{role}_model"] = model_label(provider, model)

    def either(name: str, otherwise: Column) -> Column:
        return F.when(has_metrics, m[name]).otherwise(otherwise).alias(name)

    own = [c for c in METRIC_FIELDS if c not in ("status", "runtime_seconds", "tool_calls", "mode", "anthropic_cost_usd", "guidance", "model", "validator_model", "author_provider", "validator_provider")]
    return rows.select(
        "run_id",
        instant_text(F.col("_start")).alias("start"),
        F.when(running, F.lit("running")).otherwise(instant_text(F.col("_end"))).alias("end"),
        seconds_between(F.col("_start"), F.col("_end")).alias("duration_seconds"),
        *[c.alias(n) for n, c in labels.items()],
        F.coalesce(F.col("r.guidance"), p["guidance"], m["guidance"], F.lit("")).alias("guidance"),
        either("mode", F.lit("agent")),
        either("status", p["status"]),
        either("runtime_seconds", p["elapsed_seconds"]),
        either("tool_calls", p["tool_calls"]),
        F.when(cost.isNotNull(), F.concat(F.lit("$"), F.format_string("%.4f", cost))).alias("cost"),
        *[m[c].alias(c) for c in own],
    ).orderBy(F.desc("run_id"))


def compare_runs(index: DataFrame, run_ids: list[str]) -> DataFrame:
    """Chosen runs side by side, one row per recorded metric, ``differs`` where their values do."""
    if len(run_ids) < 2:
        raise ValueError("choose at least two runs")
    names = [c for c in index.columns if c != "run_id"]
    rows = index.where(F.col("run_id").isin(*run_ids)).select(
        "run_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]
    )
    tall = rows.unpivot("run_id", names, "metric", "value")
    sides = tall.groupBy("metric").pivot("run_id", run_ids).agg(F.first("value"))
    seen = tall.groupBy("metric").agg(
        F.count_distinct("value").alias("_values"), F.max(F.length("value")).alias("_longest")
    )
    differs = (F.col("_values") > 1) & ~F.col("metric").isin("start", "end")
    return sides.join(seen.where("_longest > 0"), "metric").withColumn("differs", differs).drop("_values", "_longest")


def started_fields(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Provider and model fields of each run's first start event."""
    rows = events.where(_is("run_started"))
    return rows.groupBy("run_id").agg(F.min_by(F.struct(*STARTED_FIELDS), F.struct(*order)).alias("s")).select("run_id", "s.*")


def recorded(*values: Column | str) -> Column:
    """First value that was recorded at all."""
    return first_recorded(*values)


def tally(results: DataFrame) -> DataFrame:
    """Passes, fails, other results and the known cost of repeated reviews."""
    decision = F.col("decision")
    return results.agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(decision == "pass").alias("passed"),
        F.count_if(decision == "fail").alias("failed"),
        F.count_if(~F.coalesce(decision, F.lit("")).isin("pass", "fail")).alias("errors"),
        F.sum(F.col("estimated_cost_usd").cast("decimal(20,4)")).alias("cost"),
    )
