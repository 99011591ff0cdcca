"""Run traces, run documents, review progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.functions import stamps, text
from outlay.operators.ordered import neighbours
from outlay.plans import progress, runs
from outlay.queries.base import query, with_
from outlay.session import scratch_dir
from outlay.sources import jsonl

ORDER = ["ts", "event_id"]
BUCKET = "hour"


def events(s):
    """Trace events with their time as epoch seconds and the hour that bounds a piece of a long run."""
    return s.trace.withColumns(
        {"timestamp": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "hour": F.date_trunc("hour", "ts")}
    )


@query(
    "a19_run_counters",
    with_("trace")
    + """SELECT run_id, count(*) FILTER (event = 'agent_round') AS agent_rounds, count(*) FILTER (event = 'tool_call') AS tool_calls,
  count(*) FILTER (event = 'validation_cycle_result') AS validation_cycles,
  count(*) FILTER (event = 'model_call' AND role = 'validator') AS validator_calls,
  count(*) FILTER (event = 'author_format_retry') AS author_format_retries,
  count(*) FILTER (event = 'validator_format_retry') AS validator_format_retries FROM trace GROUP BY 1""",
)
def counters(s):
    return runs.run_counters(events(s))


@query(
    "a20_error_trend",
    with_("trace")
    + """SELECT run_id, first(error_count ORDER BY ts, event_id) AS initial_validation_errors,
  last(error_count ORDER BY ts, event_id) AS final_validation_errors,
  count(*) FILTER (error_count_delta > 0) AS validation_cycles_improved,
  count(*) FILTER (error_count_delta < 0) AS validation_cycles_regressed,
  first(error_count ORDER BY ts, event_id) - last(error_count ORDER BY ts, event_id) AS validation_error_reduction
  FROM trace WHERE event = 'validation_progress' GROUP BY 1""",
)
def trend(s):
    return runs.error_trend(events(s), ORDER)


_CALLS = (
    with_("trace")
    + """, e AS (SELECT *, lag(event) OVER w AS before, lag(prompt_chars) OVER w AS called_chars, lag(validation_cycle) OVER w AS called_cycle,
    lead(event) OVER w AS after FROM trace WHERE event IN ('model_call', 'model_response', 'model_call_failed')
    WINDOW w AS (PARTITION BY run_id, role ORDER BY ts, event_id)),
  calls AS (SELECT run_id, role, event_id, CASE WHEN before = 'model_call' THEN called_chars END AS prompt_chars,
      CASE WHEN before = 'model_call' THEN called_cycle END AS validation_cycle, CAST(elapsed_seconds AS DOUBLE) AS seconds,
      prompt_eval_count AS in_tokens, eval_count AS out_tokens,
      CASE WHEN event = 'model_response' THEN done_reason ELSE 'failed' END AS done_reason, COALESCE(before = 'model_call', FALSE) AS paired
    FROM e WHERE event <> 'model_call'
    UNION ALL SELECT run_id, role, event_id, prompt_chars, validation_cycle, NULL, NULL, NULL, 'no_response', FALSE FROM e
    WHERE event = 'model_call' AND after IS NULL)"""
)


@query("j7_paired_calls", _CALLS + " SELECT * FROM calls")
def paired(s):
    return runs.paired_calls(events(s), ORDER, BUCKET).drop("ts")


@query(
    "a21_call_totals",
    _CALLS
    + """ SELECT run_id, role, count(*) AS calls, CAST(round(sum(COALESCE(CAST(seconds AS DECIMAL(12,2)), 0)), 1) AS DOUBLE) AS seconds,
  CAST(round(max(COALESCE(CAST(seconds AS DECIMAL(12,2)), 0)), 1) AS DOUBLE) AS max_seconds,
  CAST(sum(COALESCE(in_tokens, 0)) AS BIGINT) AS in_tokens, CAST(sum(COALESCE(out_tokens, 0)) AS BIGINT) AS out_tokens,
  max(COALESCE(out_tokens, 0)) AS max_out_tokens, count(*) FILTER (done_reason = 'length') AS length_stops,
  count(*) FILTER (done_reason IN ('failed', 'no_response')) AS failed FROM calls GROUP BY ALL""",
)
def totals(s):
    return runs.call_totals(runs.paired_calls(events(s), ORDER, BUCKET))


@query(
    "j7_call_details",
    _CALLS
    + """ SELECT run_id, role, event_id, done_reason, CASE WHEN done_reason NOT IN ('failed', 'no_response') THEN event_id % 5000 END AS response_chars,
  CASE WHEN done_reason NOT IN ('failed', 'no_response') AND event_id % 7 = 0 THEN 'repaired' END AS parse_status,
  CASE WHEN done_reason NOT IN ('failed', 'no_response') AND event_id % 3 > 0 THEN event_id % 3 END AS cache_read_tokens FROM calls""",
)
def call_details(s):
    """Answers with their size, a parse status that is not ok, and tokens read from the cache."""
    e = F.when(F.col("event") == "model_response", F.col("event_id"))
    zero = F.lit(0).cast("long")
    usage = F.struct(zero.alias("input_tokens"), zero.alias("output_tokens"), (e % 3).alias("cache_read_input_tokens"), zero.alias("cache_creation_input_tokens"))
    rows = events(s).withColumns({
        "response_chars": e % 5000, "parse_status": F.when(e % 7 == 0, F.lit("repaired")).when(e.isNotNull(), F.lit("ok")), "usage": F.when(e.isNotNull(), usage),
    })
    return runs.paired_calls(rows, ORDER, BUCKET).select("run_id", "role", "event_id", "done_reason", "response_chars", "parse_status", "cache_read_tokens")


@query(
    "x13_review_details",
    with_("trace")
    + """SELECT run_id, event_id, error_count, event_id % 9 AS cycle, CASE WHEN event_id % 4 = 1 THEN 'fail' ELSE 'pass' END AS decision,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'html:e' || event_id ELSE 'html:e' || event_id || ',none:f' || event_id END AS errors
  FROM trace WHERE event = 'validation_cycle_result'""",
)
def review_details(s):
    """Reviews with no finding, an error and a warning, or two errors, one of them without severity and category."""
    e, blank = F.col("event_id"), F.lit(None).cast("string")
    finding = lambda severity, category, message: F.struct(
        severity.alias("severity"), category.alias("category"), F.concat(message, e.cast("string")).alias("message"), blank.alias("evidence")
    )
    first = finding(F.lit("error"), F.lit("html"), F.lit("e"))
    found = F.when(e % 3 == 1, F.array(first, finding(F.lit("warning"), F.lit("html"), F.lit("w")))).when(e % 3 == 2, F.array(first, finding(blank, blank, F.lit("f"))))
    rows = events(s).withColumns({"cycle": e % 9, "decision": F.when(e % 4 == 1, F.lit("fail")).otherwise(F.lit("pass")), "findings": found})
    out = runs.review_details(rows, ORDER)
    errors = F.array_join(F.transform("errors", lambda f: F.concat_ws(":", F.coalesce(f["category"], F.lit("none")), f["message"])), ",")
    return out.select("run_id", "event_id", "error_count", "cycle", "decision", errors.alias("errors"))


@query(
    "x13_call_totals_by_role",
    _CALLS
    + """ SELECT run_id, role, count(*) AS calls, CAST(round(sum(COALESCE(CAST(seconds AS DECIMAL(12,2)), 0)), 1) AS DOUBLE) AS seconds,
  CAST(sum(COALESCE(in_tokens, 0)) AS BIGINT) AS in_tokens, max(COALESCE(out_tokens, 0)) AS max_out_tokens,
  count(*) FILTER (done_reason = 'length') AS length_stops, count(*) FILTER (done_reason IN ('failed', 'no_response')) AS failed FROM calls GROUP BY ALL""",
)
def summary_calls(s):
    """The totals inside the one-scan summary equal those of the paired calls."""
    rows = runs.run_summary(events(s), ORDER).select("run_id", F.explode("calls").alias("role", "c"))
    return rows.select("run_id", "role", *[f"c.{c}" for c in ("calls", "seconds", "in_tokens", "max_out_tokens", "length_stops", "failed")])


@query(
    "j7_neighbours",
    with_("trace")
    + """SELECT run_id, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM trace
  WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)""",
)
def near(s):
    rows = neighbours(events(s), ["run_id"], BUCKET, ORDER, ["event_id"])
    return rows.select("run_id", "event_id", F.col("prev.event_id").alias("before"), F.col("next.event_id").alias("after"))


@query("a22_tool_counts", with_("trace") + "SELECT run_id, name, count(*) AS uses FROM trace WHERE event = 'tool_call' GROUP BY ALL")
def tools(s):
    return runs.tool_counts(events(s))


@query(
    "a24_cost_from_events",
    with_("trace") + "SELECT run_id, CAST(sum(cost_usd) FILTER (event IN ('model_response', 'model_call_failed')) AS DOUBLE) "
    "AS cost_usd FROM trace GROUP BY 1",
)
def event_cost(s):
    return runs.cost_from_events(events(s))


@query(
    "w12_first_and_last_times",
    with_("trace")
    + """SELECT run_id, epoch_us(first(ts ORDER BY ts, event_id)) / 1e6 AS first_time,
  epoch_us(last(ts ORDER BY ts, event_id)) / 1e6 AS last_time FROM trace GROUP BY 1""",
)
def times(s):
    return runs.first_and_last_times(events(s), ORDER)


_REVIEWS = (
    with_("trace")
    + """, r AS (SELECT * FROM trace WHERE event = 'model_call' AND role = 'validator' AND validation_cycle IS NOT NULL
    AND (attempt IS NULL OR attempt = 1) QUALIFY row_number() OVER (PARTITION BY run_id, validation_cycle ORDER BY ts, event_id) = 1)"""
)


@query("w13_first_reviews", _REVIEWS + " SELECT run_id, validation_cycle, event_id, prompt_chars FROM r")
def reviews(s):
    return runs.first_reviews(events(s), ORDER).select("run_id", "validation_cycle", "event_id", "prompt_chars")


@query(
    "w13_last_review",
    _REVIEWS + " SELECT run_id, validation_cycle, event_id FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1",
)
def last_review(s):
    found = runs.selected_review(runs.first_reviews(events(s), ORDER), order=ORDER)
    return found.select("run_id", "validation_cycle", "event_id")


@query(
    "p17_notable_events",
    with_("trace") + "SELECT run_id, event_id, event, role, CAST(elapsed_seconds AS DOUBLE) AS elapsed_seconds, attempt, name FROM trace "
    "WHERE event IN ('model_call_failed', 'tool_error')",
)
def notable(s):
    return runs.notable_events(events(s), ORDER).drop("ts")


@query(
    "x13_run_summary",
    _CALLS
    + """, t AS (SELECT run_id, role, count(*) AS n, CAST(sum(COALESCE(out_tokens, 0)) AS BIGINT) AS out_tokens FROM calls GROUP BY ALL)
  SELECT trace.run_id, count(*) FILTER (event = 'tool_call') AS tool_calls,
  CAST(sum(cost_usd) FILTER (event IN ('model_response', 'model_call_failed')) AS DOUBLE) AS cost_usd,
  count(*) FILTER (event IN ('model_call_failed', 'tool_error')) AS notable_events,
  (SELECT n FROM t WHERE t.run_id = trace.run_id AND role = 'author') AS author_calls,
  (SELECT out_tokens FROM t WHERE t.run_id = trace.run_id AND role = 'validator') AS validator_out_tokens,
  count(*) FILTER (event = 'tool_call' AND name = 'tool_1') AS tool_1,
  last(error_count ORDER BY ts, event_id) FILTER (event = 'validation_progress') AS final_validation_errors
  FROM trace GROUP BY 1""",
)
def summary(s):
    return runs.run_summary(events(s), ORDER).select(
        "run_id", "tool_calls", "cost_usd", "notable_events",
        F.col("calls")["author"]["calls"].alias("author_calls"),
        F.col("calls")["validator"]["out_tokens"].alias("validator_out_tokens"),
        F.coalesce(F.try_element_at("tools", F.lit("tool_1")), F.lit(0)).alias("tool_1"),
        "final_validation_errors",
    )


# ----- run documents -----


def parts(s):
    """Which runs have each document, and its columns, from the runs binding."""
    blank, amount, none = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("struct<provider:string,model:string>")
    stamp = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss")
    after = F.timestamp_micros(F.unix_micros(F.col("started_at").cast("timestamp")) + (F.col("elapsed_seconds") * 1e6).cast("long"))
    role = F.struct(F.col("progress_provider").alias("provider"), F.col("progress_model").alias("model"))
    epoch = F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    one = [F.lit(1).cast("long").alias(c) for c in (
        "validation_cycles", "validator_calls", "author_format_retries", "validator_format_retries",
        "initial_validation_errors", "final_validation_errors", "validation_error_reduction",
        "validation_cycles_improved", "validation_cycles_regressed", "report_bytes")]
    return {
        "m": ("has_metrics", [
            "model", F.lit("checker").alias("validator_model"), F.col("provider").alias("author_provider"),
            F.lit("gamma").alias("validator_provider"), F.lit("agent").alias("mode"), blank.alias("guidance"),
            "status", F.lit("pass").alias("validation"), F.col("elapsed_seconds").cast("double").alias("runtime_seconds"),
            F.lit(None).cast("long").alias("agent_rounds"), F.col("tool_calls").cast("long").alias("tool_calls"), *one,
            F.col("cost_usd").cast("double").alias("anthropic_cost_usd")]),
        "p": ("has_progress", [
            "status", stamp.alias("started_at"), F.date_format(after, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"),
            F.col("elapsed_seconds").cast("double").alias("elapsed_seconds"), F.col("tool_calls").cast("long").alias("tool_calls"),
            amount.alias("anthropic_cost_usd"), F.col("progress_model").alias("model"), blank.alias("validator_model"),
            F.col("progress_provider").alias("author_provider"), blank.alias("validator_provider"), "guidance",
            none.alias("author_role"), none.alias("validator_role")]),
        "r": ("tool_calls = 3", [role.alias("author_role"), none.alias("validator_role"), blank.alias("guidance")]),
        "s": ("tool_calls = 5", [
            blank.alias("author_provider"), blank.alias("author_model"), F.lit("late").alias("validator_provider"),
            F.lit("late-checker").alias("validator_model")]),
        "t": ("tool_calls <> 7", [(epoch + 60).alias("first_time"), (epoch + 600).alias("last_time")]),
    }


def spend(s):
    return s.table("orders").where("o_orderkey % 6 = 0").select(
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), F.lit("0.5").cast("decimal(20,6)").alias("cost_usd")
    )


_INDEX = (
    with_("runs")
    + """, x AS (SELECT *, regexp_extract(run_id, '[0-9]+')::BIGINT AS k FROM runs WHERE has_metrics OR has_progress),
  t AS (SELECT *, CASE WHEN has_progress THEN started_at WHEN tool_calls <> 7 THEN started_at + INTERVAL 60 SECOND END AS start_at,
    has_progress AND status = 'running' AND NOT has_metrics AS is_running FROM x),
  u AS (SELECT *, CASE WHEN is_running THEN NULL WHEN has_progress AND status <> 'running' THEN started_at + to_microseconds(CAST(elapsed_seconds * 1000000 AS BIGINT))
    WHEN tool_calls <> 7 THEN started_at + INTERVAL 600 SECOND END AS end_at,
    CASE WHEN has_metrics THEN cost_usd END AS own_cost,
    CASE WHEN tool_calls = 3 THEN progress_model WHEN has_metrics AND model IS NOT NULL THEN model WHEN has_progress THEN progress_model ELSE '' END AS m,
    CASE WHEN tool_calls = 3 THEN progress_provider WHEN has_metrics AND model IS NOT NULL THEN
        CASE WHEN provider <> '' THEN provider WHEN has_progress AND progress_model = model THEN progress_provider ELSE '' END
      WHEN has_progress THEN progress_provider ELSE '' END AS p FROM t)
  SELECT run_id, COALESCE(strftime(start_at, '%Y-%m-%d %H:%M:%S'), '') AS start,
  CASE WHEN is_running THEN 'running' ELSE COALESCE(strftime(end_at, '%Y-%m-%d %H:%M:%S'), '') END AS "end",
  CAST(round(CAST(epoch_us(end_at) - epoch_us(start_at) AS DECIMAL(20,0)) / 1000000, 1) AS DOUBLE) AS duration_seconds,
  CASE WHEN m = '' THEN '' WHEN p = '' THEN m ELSE p || ':' || m END AS author_model,
  CASE WHEN has_metrics THEN 'gamma:checker' WHEN tool_calls = 5 THEN 'late:late-checker' ELSE '' END AS validator_model,
  COALESCE(CASE WHEN has_progress THEN guidance END, '') AS guidance, status,
  CAST(tool_calls AS BIGINT) AS tool_calls, CASE WHEN has_metrics OR has_progress THEN 'agent' END AS mode,
  '$' || format('{:.4f}', COALESCE(CAST(own_cost AS DOUBLE), CASE WHEN k % 6 = 0 THEN 0.5 END)) AS cost FROM u"""
)


_INDEXED = ("run_id", "start", "end", "duration_seconds", "author_model", "validator_model", "guidance", "status", "tool_calls", "mode", "cost")


@query("x12_j6_f33_run_index", _INDEX)
def index(s):
    """The documents of a run side by side in one row: one scan of runs and one of the ledger."""
    state = s.runs.select("run_id", *[F.when(F.expr(test), F.struct(*columns)).alias(name) for name, (test, columns) in parts(s).items()])
    # The runs lie in one small file: spread first, or one task would parse every instant.
    state = state.repartition("run_id")
    cost = runs.ledger_entries(spend(s)).select("run_id", F.struct("own", "alias").alias("l"))
    return runs.indexed(state.join(cost, "run_id", "left")).select(*_INDEXED)


@query("x12_separate_documents", _INDEX)
def index_of_documents(s):
    """The same from five tables of documents, some of which a run lacks, met in one grouping."""
    tables = [s.runs.where(test).select("run_id", *columns) for test, columns in parts(s).values()]
    return runs.run_index(*tables, spend(s)).select(*_INDEXED)


@query(
    "u5_compare_runs",
    with_("runs")
    + """, c AS (SELECT * FROM runs WHERE run_id IN ('run-4', 'run-8')),
  v AS (SELECT metric, max(value) FILTER (run_id = 'run-4') AS a, max(value) FILTER (run_id = 'run-8') AS b FROM (
    SELECT run_id, unnest(['status', 'guidance', 'tool_calls', 'has_metrics']) AS metric,
      unnest([status, COALESCE(guidance, ''), CAST(tool_calls AS VARCHAR), CAST(has_metrics AS VARCHAR)]) AS value FROM c) GROUP BY 1)
  SELECT metric, a AS "run-4", b AS "run-8", a <> b AS differs FROM v WHERE a <> '' OR b <> ''""",
)
def compared(s):
    table = s.runs.select("run_id", "status", "guidance", "tool_calls", "has_metrics")
    return runs.compare_runs(table, ["run-4", "run-8"])


@query(
    "a25_tally",
    "SELECT count(*) AS results, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0 AND toxic = 0) AS failed, "
    "count(*) FILTER (quality = 0 AND toxic = 1) AS errors, CAST(sum(CAST(doc_id AS DECIMAL(20,4)) / 10000) AS DOUBLE) AS cost FROM labels",
)
def tally(s):
    decision = F.when(F.col("quality") == 1, F.lit("pass")).when(F.col("toxic") == 0, F.lit("fail"))
    rows = s.table("labels").select(decision.alias("decision"), (F.col("doc_id") / 10000).alias("estimated_cost_usd"))
    return runs.tally(rows)


# ----- JSON lines: the trace is written to the shared scratch folder and read back -----


def _trace_folder(s) -> str:
    """Trace lines of every run in files of many runs, with broken, empty and non-object lines between them."""
    folder = scratch_dir(s.spark, "runs")
    rows = events(s).withColumn("run_id", jsonl.run_name(F.col("run_id")))
    rows = rows.withColumn("line", F.to_json(F.struct("run_id", "event", "timestamp", "role", F.col("event_id").alias("attempt"), "cost_usd", "name")))
    noise = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).when(F.col("event_id") % 9 == 1, F.lit("[1, 2]")).when(
        F.col("event_id") % 9 == 2, F.lit("")
    )
    lines = F.array_compact(F.array(F.col("line"), noise))
    rows.select("run_id", "ts", "event_id", F.explode(lines).alias("value")).repartition("run_id").sortWithinPartitions(
        "run_id", "ts", "event_id"
    ).select("value", F.lpad(F.lit("0"), 10, "0").alias("pack")).write.partitionBy("pack").text(folder)
    return folder


@query(
    "s9_w12_lenient_scan",
    with_("trace")
    + """SELECT run_id, event, count(*) AS n, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, CAST(sum(event_id) AS BIGINT) AS ids FROM trace GROUP BY ALL""",
)
def lenient(s):
    rows = jsonl.read_trace(s.spark, _trace_folder(s))
    run_id = F.regexp_replace("run_id", "^run_id=", "")
    return rows.groupBy(run_id.alias("run_id"), "event").agg(
        F.count("*").alias("n"),
        F.sum(F.col("cost_usd").cast("decimal(20,4)")).alias("cost_usd"),
        F.sum("attempt").alias("ids"),
    )


@query(
    "s9_first_and_last_line",
    with_("trace")
    + """SELECT run_id, first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id
  FROM trace GROUP BY 1""",
)
def first_and_last(s):
    rows = jsonl.read_trace(s.spark, _trace_folder(s))
    place = F.struct("block", "line")
    return rows.groupBy(F.regexp_replace("run_id", "^run_id=", "").alias("run_id")).agg(
        F.min_by("attempt", place).alias("first_id"), F.max_by("attempt", place).alias("last_id")
    )


@query(
    "s9_s13_event_order",
    with_("trace")
    + """SELECT run_id, row_number() OVER w AS seq, event_id, event, lag(event_id) OVER w AS before FROM trace
  WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)""",
)
def event_order(s):
    """Every run is written to several numbered files, shared with other runs, and read back in the order of its events."""
    folder = scratch_dir(s.spark, "ordered")
    rows = events(s).select("run_id", "ts", "event_id", "event", F.col("event_id").alias("attempt"))
    jsonl.write_runs(rows, folder, ["ts", "event_id"], parts=5, packed=True)
    read = neighbours(jsonl.sequenced(jsonl.read_trace(s.spark, folder)), ["run_id"], "block", ["line"], ["attempt"])
    return read.select(F.col("run_id").cast(s.trace.schema["run_id"].dataType).alias("run_id"), "seq", F.col("attempt").alias("event_id"), "event", F.col("prev.attempt").alias("before"))


@query(
    "s9_s13_paired_calls_over_files",
    with_("trace")
    + """, c AS (SELECT run_id, role, event, event_id, lag(event) OVER w AS prev, lag(event_id) OVER w AS call FROM trace
    WHERE event IN ('model_call', 'model_response', 'model_call_failed') WINDOW w AS (PARTITION BY run_id, role ORDER BY ts, event_id))
  SELECT run_id, role, event_id, CASE WHEN prev = 'model_call' THEN call END AS call FROM c WHERE event <> 'model_call'""",
)
def paired_over_files(s):
    """Answers with the call just before them, where a run's events lie in several files."""
    folder = scratch_dir(s.spark, "ordered")
    rows = events(s).select("run_id", "ts", "event_id", "event", "role", F.col("event_id").alias("attempt"))
    jsonl.write_runs(rows, folder, ["ts", "event_id"], parts=5, packed=True)
    read = jsonl.read_trace(s.spark, folder).where(F.col("event").isin("model_call", "model_response", "model_call_failed"))
    near = neighbours(read, ["run_id", "role"], "block", ["line"], ["event", "attempt"]).where("event <> 'model_call'")
    call = F.when(F.col("prev.event") == "model_call", F.col("prev.attempt"))
    return near.select(F.col("run_id").cast(s.trace.schema["run_id"].dataType).alias("run_id"), "role", F.col("attempt").alias("event_id"), call.alias("call"))


@query(
    "s11_s13_run_documents",
    with_("runs") + "SELECT 'group-' || CAST(tool_calls AS VARCHAR) AS run_id, count(*) AS n, min(status) AS status, "
    "CAST(sum(elapsed_seconds) AS DOUBLE) AS elapsed FROM runs WHERE has_progress GROUP BY 1",
)
def run_documents(s):
    """One document per run folder, the folder named after the run, read back as documents by folder name."""
    folder = scratch_dir(s.spark, "documents")
    docs = s.runs.where("has_progress").groupBy(F.concat(F.lit("group-"), "tool_calls").alias("run_id")).agg(
        F.count("*").alias("n"), F.min("status").alias("status"), F.sum("elapsed_seconds").alias("elapsed")
    )
    jsonl.write_runs(docs, folder)
    rows = jsonl.read_documents(s.spark, folder, "*.json", {"n": "bigint", "status": "string", "elapsed": "double"})
    return rows.withColumn("run_id", F.regexp_replace("run_id", "^run_id=", ""))


@query(
    "s12_newest_documents",
    "SELECT o_orderpriority || '.json' AS file, CAST(max(o_totalprice) AS DOUBLE) AS value FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 3",
)
def newest_documents(s):
    """The newest of five documents, one a priority, by a field of theirs."""
    folder = scratch_dir(s.spark, "side")
    best = s.table("orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("value"))
    best.repartition("o_orderpriority").write.option("maxRecordsPerFile", 1).json(folder)
    rows = jsonl.list_documents(s.spark, folder, {"o_orderpriority": "string", "value": "double"}, "o_orderpriority", 3)
    return rows.select(F.concat("o_orderpriority", F.lit(".json")).alias("file"), "value")


def _side_documents(s) -> str:
    """One document for each of 120 parts of the orders, their files named in the order of the parts."""
    folder = scratch_dir(s.spark, "side")
    part = F.col("o_orderkey") % 120
    docs = s.table("orders").groupBy(part.alias("part")).agg(F.count("*").alias("orders"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("created_at"))
    # One sorted task writes a file for each row; the files' numbers are part of their names.
    docs.coalesce(1).sortWithinPartitions("part").write.option("maxRecordsPerFile", 1).json(folder)
    return folder


_SIDE = "WITH d AS (SELECT o_orderkey % 120 AS part, count(*) AS orders, strftime(max(o_orderdate), '%Y-%m-%d') AS created_at FROM orders GROUP BY 1)"
_SIDE_FIELDS = {"part": "bigint", "orders": "bigint", "created_at": "string"}


@query("s12_replays_by_name", _SIDE + " SELECT part, orders, created_at FROM d ORDER BY part DESC LIMIT 50")
def replays(s):
    """The fifty newest by file name; the others are not opened."""
    return jsonl.list_documents(s.spark, _side_documents(s), _SIDE_FIELDS, limit=50).select(*_SIDE_FIELDS)


@query("s12_comparisons_by_time", _SIDE + " SELECT part, orders, created_at FROM d ORDER BY created_at DESC, part DESC LIMIT 30")
def comparisons(s):
    """The newest by a field of theirs, then by file name."""
    return jsonl.list_documents(s.spark, _side_documents(s), _SIDE_FIELDS, "created_at", 30).select(*_SIDE_FIELDS)


# ----- review progress -----

_DECISION = "CASE WHEN run_id % 4 = 0 AND cycle = 7 THEN 'pass' ELSE 'fail' END"


def reviews_of(s):
    """One review per supplier and line number; every fourth supplier passes in the end."""
    rows = s.findings.select("run_id", "cycle").distinct()
    passed = (F.col("run_id") % 4 == 0) & (F.col("cycle") == 7)
    return rows.withColumn("decision", F.when(passed, F.lit("pass")).otherwise(F.lit("fail")))


_ERRORS = (
    with_("findings")
    + f""", reviews AS (SELECT DISTINCT run_id, cycle, {_DECISION} AS decision FROM findings),
  err AS (SELECT *, COALESCE(category, 'uncategorized') AS named, lower(COALESCE(category, '')) AS kc,
    trim(regexp_replace(lower(message), '[^a-z0-9]+', ' ', 'g'))[1:80] AS km FROM findings WHERE severity = 'error'),
  counts AS (SELECT run_id, cycle, named AS category, count(*) AS errors FROM err GROUP BY ALL
    UNION ALL SELECT run_id, cycle, 'unclassified', 1 FROM reviews r WHERE decision <> 'pass'
      AND NOT EXISTS (SELECT 1 FROM err WHERE err.run_id = r.run_id AND err.cycle = r.cycle))"""
)


@query("a26_category_errors", _ERRORS + " SELECT run_id, cycle, category, errors FROM counts")
def category_errors(s):
    return progress.category_errors(s.findings, reviews_of(s))


@query(
    "j13_category_changes",
    _ERRORS
    + """, merged AS (SELECT COALESCE(a.run_id, b.run_id) AS run_id, COALESCE(a.cycle, b.cycle + 1) AS cycle, COALESCE(a.category, b.category) AS category,
    COALESCE(a.errors, 0) AS errors, COALESCE(b.errors, 0) AS errors_before FROM counts a FULL JOIN counts b
    ON a.run_id = b.run_id AND a.cycle = b.cycle + 1 AND a.category = b.category)
  SELECT merged.*, greatest(0, errors_before - errors) AS resolved, greatest(0, errors - errors_before) AS "new" FROM merged
  WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.run_id = merged.run_id AND r.cycle = merged.cycle)
    AND EXISTS (SELECT 1 FROM reviews r WHERE r.run_id = merged.run_id AND r.cycle + 1 = merged.cycle)""",
)
def category_changes(s):
    r = reviews_of(s)
    return progress.category_changes(progress.category_errors(s.findings, r), r)


@query(
    "x14_w14_cycle_progress",
    _ERRORS
    + """, keys AS (SELECT run_id, cycle, kc, km, count(*) AS n FROM err GROUP BY ALL),
  m AS (SELECT k.run_id, k.cycle, count(*) AS keys, count(p.km) AS shared, sum(CASE WHEN p.km IS NOT NULL THEN k.n ELSE 0 END) AS repeated
    FROM keys k LEFT JOIN keys p ON p.run_id = k.run_id AND p.cycle = k.cycle - 1 AND p.kc = k.kc AND p.km = k.km GROUP BY ALL),
  b AS (SELECT r.run_id, r.cycle, r.decision, COALESCE((SELECT sum(errors) FROM counts c WHERE c.run_id = r.run_id AND c.cycle = r.cycle), 0) AS error_count,
    (SELECT count(*) FROM findings f WHERE f.run_id = r.run_id AND f.cycle = r.cycle AND severity = 'warning') AS warning_count,
    COALESCE(m.keys, 0) AS keys, COALESCE(m.shared, 0) AS shared, COALESCE(m.repeated, 0) AS repeated
    FROM reviews r LEFT JOIN m USING (run_id, cycle))
  SELECT b.run_id, b.cycle, b.decision, CAST(b.error_count AS BIGINT) AS error_count, b.warning_count, CAST(p.error_count AS BIGINT) AS prior_error_count,
  CAST(p.error_count - b.error_count AS BIGINT) AS error_count_delta,
  CASE WHEN p.run_id IS NOT NULL THEN CAST(b.repeated AS BIGINT) END AS repeated_error_count,
  COALESCE(b.keys > 0 AND b.keys = p.keys AND b.keys = b.shared, FALSE) AS stalled
  FROM b LEFT JOIN b p ON p.run_id = b.run_id AND p.cycle = b.cycle - 1""",
)
def cycle_progress(s):
    return progress.cycle_progress(s.findings, reviews_of(s))


@query(
    "w14_unchanged_errors",
    _ERRORS
    + """, l AS (SELECT run_id, cycle, string_agg(DISTINCT kc, '|' ORDER BY kc) AS entries FROM err GROUP BY ALL)
  SELECT b.run_id, b.cycle FROM l a JOIN l b ON a.run_id = b.run_id AND b.cycle = a.cycle + 1 AND a.entries = b.entries""",
)
def unchanged(s):
    """Reviews reduced to their distinct error categories, so that some of them repeat exactly."""
    errors = s.findings.where("severity = 'error'")
    rows = errors.select("run_id", "cycle", "severity", F.lower(F.coalesce("category", F.lit(""))).alias("category"))
    rows = rows.distinct().withColumns({"message": F.lit("same"), "position": F.xxhash64("category")})
    return progress.unchanged_errors(rows)


@query(
    "w15_resolved_findings",
    _ERRORS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, named AS (SELECT run_id, cycle, position, kc || chr(31) || km AS k, named || ': ' || trim(regexp_replace(message, '\\s+', ' ', 'g')) AS label FROM err),
  seen AS (SELECT run_id, k, max(cycle) AS last_seen, first(label ORDER BY cycle, position) AS label FROM named GROUP BY ALL),
  good AS (SELECT run_id, cycle, row_number() OVER (PARTITION BY run_id ORDER BY cycle) AS n FROM reviews r
    WHERE decision = 'pass' OR EXISTS (SELECT 1 FROM err WHERE err.run_id = r.run_id AND err.cycle = r.cycle)),
  now AS (SELECT run_id, cycle, n, COALESCE(list(k ORDER BY p) FILTER (k IS NOT NULL), []) AS ks
    FROM good LEFT JOIN (SELECT run_id, cycle, k, min(position) AS p FROM named GROUP BY ALL) USING (run_id, cycle) GROUP BY ALL),
  fold AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS n, []::STRUCT(k VARCHAR, since BIGINT)[] AS held, []::VARCHAR[] AS earlier FROM good
    UNION ALL
    SELECT run_id, n, held[greatest(len(held) - 9, 1):], earlier FROM (
      SELECT run_id, n, earlier || list_filter(ks, lambda x: NOT list_contains(earlier, x)) AS earlier,
        stays || list_transform(list_filter(earlier, lambda x: NOT list_contains(ks, x) AND NOT list_contains(list_transform(stays, lambda h: h.k), x)),
          lambda x: {'k': x, 'since': cycle}) AS held FROM (
        SELECT now.run_id, now.n, now.cycle, now.ks, fold.earlier, list_filter(fold.held, lambda h: NOT list_contains(now.ks, h.k)) AS stays
        FROM fold JOIN now ON now.run_id = fold.run_id AND now.n = fold.n + 1))),
  ends AS (SELECT run_id, list_reverse(held) AS held FROM fold QUALIFY n = max(n) OVER (PARTITION BY run_id)),
  out AS (SELECT run_id, unnest(held) AS h, CAST(unnest(range(1, len(held) + 1)) AS INTEGER) AS place FROM ends)
  SELECT out.run_id, seen.label, seen.last_seen, h.since AS resolved_in, place FROM out JOIN seen ON seen.run_id = out.run_id AND seen.k = h.k""",
)
def resolved(s):
    return progress.resolved_findings(s.findings, reviews_of(s))


_RANK = "list_position(['arithmetic','completeness','evidence','history','policy','html','usability','visual_design'], category)"


@query(
    "o15_focused_errors",
    with_("findings")
    + f""", e AS (SELECT *, COALESCE({_RANK}, 9) AS r, count(*) OVER (PARTITION BY run_id, cycle) AS n FROM findings WHERE severity = 'error')
  SELECT run_id, cycle, position, category, row_number() OVER (PARTITION BY run_id, cycle ORDER BY r, position) AS place,
  n - least(n, 3) AS remaining FROM e QUALIFY place <= 3""",
)
def focused(s):
    return progress.focused_errors(s.findings).select("run_id", "cycle", "position", "category", "place", "remaining")


@query(
    "j12_mentions",
    with_("findings")
    + """SELECT run_id, cycle, position, CASE WHEN contains(message, 'shortfall') THEN 'savings_shortfall' ELSE 'mom_change_percent' END AS fields,
  CASE WHEN contains(message, 'Food & Drink') THEN 'Food & Drink' ELSE 'Travel' END AS categories FROM findings""",
)
def mentioned(s):
    """Lower-case gas is prose, capitalized Travel is a category."""
    message = F.col("message")
    return s.findings.select(
        "run_id", "cycle", "position",
        F.array_join(progress.mentioned_fields(message), ",").alias("fields"),
        F.array_join(progress.mentioned_categories(message, (*progress.CATEGORY_NAMES, "Gas")), ",").alias("categories"),
    )


@query(
    "j12_authoritative_values",
    with_("findings", "spend")
    + """, p AS (SELECT category, parent_group, sum(CASE WHEN transaction_month = DATE '2001-09-30' THEN spend ELSE 0 END) AS cur FROM spend
    WHERE transaction_month IN (DATE '2001-09-30', DATE '2001-08-31') GROUP BY ALL)
  SELECT run_id, cycle, position, CAST((SELECT sum(cur) FROM p WHERE p.category = CASE WHEN contains(message, 'Food & Drink') THEN 'Food & Drink' ELSE 'Travel' END) AS DOUBLE) AS current_spend,
  CASE WHEN contains(message, 'shortfall') THEN 0.0::DOUBLE END AS savings_shortfall FROM findings""",
)
def values(s):
    from outlay.plans import snapshot
    from outlay.queries.base import MONTH

    snap = snapshot.month_snapshot(s.frame, MONTH, 10.0e9, 0.0, savings_goal=1.0)
    rows = progress.authoritative_values(s.findings, snap.lines)
    spend = F.aggregate("categories", F.lit(0).cast("decimal(34,2)"), lambda acc, c: (acc + c["current_spend"]).cast("decimal(34,2)"))
    return rows.select("run_id", "cycle", "position", spend.alias("current_spend"), F.col("fields")["savings_shortfall"].alias("savings_shortfall"))


@query(
    "f34_finding_keys",
    with_("findings") + "SELECT run_id, cycle, position, trim(regexp_replace(lower(message), '[^a-z0-9]+', ' ', 'g'))[1:80] AS key, "
    "COALESCE(category, 'uncategorized') || ': ' || message AS label FROM findings",
)
def keys(s):
    return s.findings.select(
        "run_id", "cycle", "position", text.finding_key("message").alias("key"), text.finding_label("category", "message").alias("label")
    )


@query(
    "f32_instants",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, CAST(round(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DECIMAL(20,0)) / 1000000, 1) AS DOUBLE) AS seconds, "
    "epoch_us(ts) AS micros FROM events",
)
def instants(s):
    e = s.table("events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at, epoch = stamps.from_iso(iso), stamps.from_epoch(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    zero = stamps.from_iso(F.lit("2024-01-01T00:00:00"))
    return e.select(
        "event_id", stamps.instant_text(at).alias("shown"), stamps.seconds_between(zero, at).alias("seconds"), F.unix_micros(epoch).alias("micros")
    )


@query("f33_first_recorded", with_("runs") + "SELECT run_id, COALESCE(nullif(trim(guidance), ''), nullif(trim(provider), ''), trim(progress_provider)) AS value FROM runs")
def first_value(s):
    return s.runs.select("run_id", runs.recorded("guidance", "provider", "progress_provider").alias("value"))
