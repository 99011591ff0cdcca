"""Sources, run and review reports, budget, retrieval and streams."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from outlay.functions.text import STOP_WORDS
from outlay.operators import history
from outlay.plans import budget, progress, runs, search, search_index
from outlay.sources import cards, jsonl
from outlay.streaming.landing import land_new_exports
from outlay.streaming.live import EVENT_SCHEMA, compact, current_state, follow_runs, run_state

EVENTS = [
    {"event": "run_started", "timestamp": 100.0, "author_provider": "alpha", "author_model": "m", "validator_provider": "beta", "validator_model": "v"},
    {"event": "agent_round", "timestamp": 101.0},
    {"event": "model_call", "timestamp": 102.0, "role": "author", "prompt_chars": 10},
    {"event": "model_call", "timestamp": 103.0, "role": "author", "prompt_chars": 20},
    {"event": "model_response", "timestamp": 104.0, "role": "author", "elapsed_seconds": 1.5, "eval_count": 7, "done_reason": "length", "cost_usd": 0.25},
    {"event": "model_response", "timestamp": 105.0, "role": "author", "elapsed_seconds": 2.0, "done_reason": "stop"},
    {"event": "model_call", "timestamp": 106.0, "role": "validator", "validation_cycle": 1, "attempt": 1, "prompt_chars": 5},
    {"event": "model_call_failed", "timestamp": 107.0, "role": "validator", "elapsed_seconds": 0.5, "cost_usd": 0.05},
    {"event": "tool_call", "timestamp": 108.0, "name": "list"},
    {"event": "validation_progress", "timestamp": 109.0, "error_count": 4},
    {"event": "validation_progress", "timestamp": 110.0, "error_count": 1, "error_count_delta": 3},
    {"event": "model_call", "timestamp": 111.0, "role": "author", "prompt_chars": 30},
]


@pytest.fixture(scope="module")
def runs_folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for run in ("r1", "r2_failed", "replays"):
        folder = root / run
        folder.mkdir()
        lines = [json.dumps(e) for e in EVENTS]
        lines[3:3] = ["{broken", "", "[1, 2]", "7"]
        (folder / "trace.jsonl").write_text("\n".join(lines) + "\n")
    (root / "r1" / "metrics.json").write_text(json.dumps({"model": "m", "status": "validated", "tool_calls": 1, "runtime_seconds": 9.5}, indent=2))
    (root / "r2_failed" / "progress.json").write_text(json.dumps({"status": "running", "started_at": "2026-01-01T00:00:00", "tool_calls": 2, "guidance": "strict"}))
    (root / "replays" / "a.json").write_text('{"created_at": "2"}')
    (root / "replays" / "b.json").write_text("oops")
    (root / "replays" / "c.json").write_text('{"created_at": "1"}')
    return root


def trace(spark, root):
    return jsonl.read_trace(spark, str(root) + "/*/trace.jsonl")


def test_trace_scan(spark, runs_folder):
    rows = trace(spark, runs_folder).collect()
    assert Counter(r.run_id for r in rows) == {"r1": len(EVENTS), "r2_failed": len(EVENTS)}
    mine = sorted((r for r in rows if r.run_id == "r1"), key=lambda r: (r.block, r.line))
    assert [r.event for r in mine] == [e["event"] for e in EVENTS]


def test_small_splits_keep_line_order(spark, runs_folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = trace(spark, runs_folder).where("run_id = 'r1'").collect()
        assert len({r.block for r in rows}) > 3
        assert [r.event for r in sorted(rows, key=lambda r: (r.block, r.line))] == [e["event"] for e in EVENTS]
        calls = runs.paired_calls(trace(spark, runs_folder).where("run_id = 'r1'")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted((r.role, r.prompt_chars or 0, r.done_reason, r.paired) for r in calls)
    assert got == [
        ("author", 0, "stop", False), ("author", 20, "length", True), ("author", 30, "no_response", False),
        ("validator", 5, "failed", True),
    ]


def test_run_summary(spark, runs_folder):
    row = runs.run_summary(trace(spark, runs_folder)).where("run_id = 'r1'").first()
    assert (row.agent_rounds, row.tool_calls, row.validator_calls, row.notable_events) == (1, 1, 1, 1)
    assert (row.initial_validation_errors, row.final_validation_errors, row.validation_error_reduction) == (4, 1, 3)
    assert (row.validation_cycles_improved, float(row.cost_usd), row.first_time, row.last_time) == (1, 0.3, 100.0, 111.0)
    author = row.calls["author"]
    assert (author.calls, float(author.seconds), author.length_stops, author.failed) == (3, 3.5, 1, 1)
    assert row.tools == {"list": 1}


def test_call_and_review_details(spark, tmp_path):
    events = [
        {"event": "model_call", "timestamp": 1.0, "role": "author", "prompt_chars": 50},
        {"event": "model_response", "timestamp": 2.0, "role": "author", "parse_status": "ok", "response_chars": 900, "done_reason": "stop", "usage": {"cache_read_input_tokens": 0}},
        {"event": "model_response", "timestamp": 3.0, "role": "validator", "parse_status": "repaired", "response_chars": 30, "done_reason": "stop", "usage": {"cache_read_input_tokens": 64}},
        {"event": "model_call_failed", "timestamp": 4.0, "role": "author", "parse_status": "bad"},
        {"event": "validation_cycle_result", "timestamp": 5.0, "cycle": 1, "decision": "fail", "stage": "validator", "summary": "Fails", "error_count": 1, "warning_count": 1,
         "findings": [{"severity": "error", "category": "html", "message": "m", "evidence": "e"}, {"severity": "warning", "message": "w"}, {"message": "no severity"}]},
        {"event": "validation_progress", "timestamp": 6.0, "error_count": 2, "resolved_findings": ["a", "b"]},
        {"event": "validation_progress", "timestamp": 7.0, "error_count": 1, "resolved_findings": ["a"]},
        {"event": "validation_cycle_result", "timestamp": 8.0, "cycle": 2, "decision": "pass"},
    ]
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "trace.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
    rows = trace(spark, tmp_path)
    calls = {(r.role, r.done_reason): (r.response_chars, r.parse_status, r.cache_read_tokens) for r in runs.paired_calls(rows).collect()}
    assert calls == {("author", "stop"): (900, None, None), ("validator", "stop"): (30, "repaired", 64), ("author", "failed"): (None, None, None)}
    one, two = runs.review_details(rows).orderBy("cycle").collect()
    assert (one.decision, one.stage, one.summary, one.warning_count) == ("fail", "validator", "Fails", 1) and two.errors == []
    assert [tuple(e) for e in one.errors] == [("html", "m", "e"), (None, "no severity", None)]
    assert runs.run_summary(rows).first().resolved_findings_at_end == 1


def test_index_and_documents(spark, runs_folder):
    events, root = trace(spark, runs_folder), str(runs_folder)
    metrics = jsonl.read_documents(spark, root, "metrics.json", runs.METRIC_FIELDS)
    docs = jsonl.read_documents(spark, root, "progress.json", runs.PROGRESS_FIELDS)
    manifest = jsonl.empty_like(spark, runs.MANIFEST_FIELDS)
    spend = spark.createDataFrame([("r2", 0.75)], "run_id string, cost_usd double")
    index = runs.run_index(metrics, docs, manifest, runs.started_fields(events), runs.first_and_last_times(events), spend)
    one, two = (r for r in index.orderBy("run_id").collect())
    assert (one.run_id, one.start, one.end, one.duration_seconds) == ("r1", "1970-01-01 00:01:40", "1970-01-01 00:01:51", 11.0)
    assert (one.author_model, one.validator_model, one.cost, one.runtime_seconds) == ("alpha:m", "beta:v", None, 9.5)
    assert (two.run_id, two.end, two.guidance, two.cost, two.status) == ("r2_failed", "running", "strict", "$0.7500", "running")
    assert [r.run_id for r in index.collect()] == ["r2_failed", "r1"]
    diff = {r.metric: r.differs for r in runs.compare_runs(index, ["r1", "r2_failed"]).collect()}
    assert diff["status"] and not diff["start"] and "author_format_retries" not in diff
    side = jsonl.list_documents(spark, root + "/replays", {"created_at": "string"}, limit=2).collect()
    assert [r.file for r in side] == ["c.json"]  # the limit counts files, then the broken one drops out
    newest = jsonl.list_documents(spark, root + "/replays", {"created_at": "string"}, newest_by="created_at").collect()
    assert [r.file for r in newest] == ["a.json", "c.json"]


LEDGER = ['{"run_id": "a", "date": "2026-01-01", "cost_usd": 1.5}', '{"run_id": "b", "date": "2026-01-02", "cost_usd": 0.25, "usage": {"output_tokens": 3}}']


def test_strict_ledger(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.jsonl"
        path.write_text(text)
        return jsonl.read_ledger(spark, str(path)).orderBy("run_id").collect()

    rows = read("\n".join(LEDGER) + "\n\n[1]\n")
    assert [(r.run_id, r.cost_usd) for r in rows] == [("a", 1.5), ("b", 0.25)] and rows[1].usage.output_tokens == 3
    assert len(read("\n".join(LEDGER))) == 2
    assert len(read("\n".join(LEDGER) + '\n{"run_id": "c", "co')) == 2  # a write in progress
    for broken in (LEDGER[0] + "\n{oops\n" + LEDGER[1] + "\n", "\n".join(LEDGER) + "\n{oops\n"):
        with pytest.raises(Exception, match="not valid JSON"):
            read(broken)


def test_budget(spark):
    ledger = spark.createDataFrame([("2026-01-01", "r1", 4.9), ("2026-01-01", "r2", 5.0), ("2026-01-02", "r1", 0.01)], "date string, run_id string, cost_usd double")
    assert float(budget.spend_on(ledger, "2026-01-01").first().cost_usd) == 9.9
    assert {r.run_id: float(r.cost_usd) for r in budget.spend_by_run(ledger).collect()} == {"r1": 4.91, "r2": 5.0}
    schema = "n int, date string, run_id string, model string, prompt_chars int, max_tokens int, session_spent double"
    calls = spark.createDataFrame(
        [
            (1, "2026-01-01", "r1", "claude-opus-5", 7000, 1000, None),
            (2, "2026-01-02", "r1", "claude-opus-5", 700000, 10000, None),
            (3, "2026-01-02", "chat", "claude-opus-5", 70, 10, 4.9999999),
            (4, "2026-01-03", "new", "claude-haiku-4-5", 70, 10, None),
        ],
        schema,
    )
    got = {r.n: (r.cap, r.allowed) for r in budget.budget_check(ledger, calls, 9.92, 5.0).collect()}
    assert got == {1: ("daily", False), 2: ("run", False), 3: ("run", False), 4: (None, True)}
    assert all(r.allowed for r in budget.budget_check(ledger, calls, None, None).collect())


FINDINGS = [
    (1, 1, 0, "error", "arithmetic", "Total wrong"), (1, 1, 1, "error", "html", "Bad tag"), (1, 1, 2, "warning", "tone", "w"),
    (1, 2, 0, "error", "arithmetic", "total  WRONG!"), (1, 2, 1, "error", "html", "Bad tag"),
    (1, 4, 0, "error", "policy", "New"), (1, 4, 1, "error", None, "x"), (1, 4, 2, "error", "evidence", "y"), (1, 4, 3, "error", "usability", "z"),
]


def test_review_progress(spark):
    findings = spark.createDataFrame(FINDINGS, "run_id int, cycle int, position int, severity string, category string, message string")
    reviews = spark.createDataFrame([(1, 1, "fail"), (1, 2, "fail"), (1, 3, "fail"), (1, 4, "fail"), (1, 5, "pass")], "run_id int, cycle int, decision string")
    rows = {r.cycle: r for r in progress.cycle_progress(findings, reviews).collect()}
    assert [(rows[c].error_count, rows[c].prior_error_count, rows[c].repeated_error_count, rows[c].stalled) for c in (1, 2, 3, 4, 5)] == [
        (2, None, None, False), (2, 2, 2, True), (1, 2, 0, False), (4, 1, 0, False), (0, 4, 0, False),
    ]
    assert rows[1].warning_count == 1 and rows[5].error_count_delta == 4
    errors = {(r.cycle, r.category): r.errors for r in progress.category_errors(findings, reviews).collect()}
    assert errors[3, "unclassified"] == 1 and errors[4, "uncategorized"] == 1
    changes = {(r.cycle, r.category): (r.resolved, r.new) for r in progress.category_changes(progress.category_errors(findings, reviews), reviews).collect()}
    assert changes[3, "html"] == (1, 0) and changes[4, "policy"] == (0, 1) and changes[5, "evidence"] == (1, 0)
    gone = [(r.label, r.resolved_in) for r in progress.resolved_findings(findings, reviews).orderBy("place").collect()]
    assert gone[-2:] == [("html: Bad tag", 4), ("arithmetic: Total wrong", 4)] and {r[1] for r in gone[:4]} == {5}
    focus = [(r.category, r.remaining) for r in progress.focused_errors(findings).where("cycle = 4").orderBy("place").collect()]
    assert focus == [("evidence", 1), ("policy", 1), ("usability", 1)]
    every = [(r.category, r.remaining) for r in progress.focused_errors(findings, None).where("cycle = 4").orderBy("place").collect()]
    assert every == [("evidence", 0), ("policy", 0), ("usability", 0), (None, 0)]
    same = {r.cycle for r in progress.unchanged_errors(findings.where("message = 'Bad tag'")).collect()}
    assert same == {2}


def resolved_by_loop(reviews, keep):
    """The list kept up review by review, for one run: reviews are (passed, [(key, label), ...]) in order."""
    held, earlier = {}, {}
    for cycle, (passed, errors) in enumerate(reviews, 1):
        if not passed and not errors:
            continue
        now = {k for k, _ in errors}
        held = {k: v for k, v in held.items() if k not in now}
        held |= {k: cycle for k in earlier if k not in now and k not in held}
        held = dict(list(held.items())[-keep:])
        for k, label in errors:
            earlier.setdefault(k, label)
    return [(earlier[k], v) for k, v in reversed(held.items())]


@pytest.mark.parametrize("keep", [2, 10])
def test_resolved_findings_turn_over(spark, keep):
    rng, findings, reviews, want = random.Random(keep), [], [], {}
    for run in range(12):
        steps = []
        for cycle in range(1, rng.choice([1, 4, 9, 20])):
            passed = rng.random() < 0.2
            names = rng.sample(range(30), 0 if passed else rng.choice([0, 1, 5, 18]))
            steps.append((passed, [(n, f"html: m{n}") for n in names]))
            reviews.append((run, cycle, "pass" if passed else "fail"))
            findings += [(run, cycle, p, "error", "html", f"m{n}") for p, n in enumerate(names)]
        want[run] = resolved_by_loop(steps, keep)
    kind = "run_id int, cycle int, position int, severity string, category string, message string"
    rows = progress.resolved_findings(spark.createDataFrame(findings, kind), spark.createDataFrame(reviews, "run_id int, cycle int, decision string"), keep)
    got = {run: [] for run in want}
    for r in rows.orderBy("run_id", "place").collect():
        got[r.run_id].append((r.label, r.resolved_in))
        assert r.place == len(got[r.run_id]) and r.last_seen < r.resolved_in
    assert got == want and max(len(w) for w in want.values()) == keep


def test_a_run_in_several_files_keeps_its_order(spark, tmp_path):
    rows = [(f"r{i % 3}", i, "agent_round", float(i)) for i in range(300)]
    random.Random(1).shuffle(rows)
    events = spark.createDataFrame(rows, "run_id string, attempt long, event string, timestamp double").repartition(7)
    for parts in (None, 4):
        folder = str(tmp_path / f"runs{parts}")
        jsonl.write_runs(events, folder, ["attempt"], parts)
        read = jsonl.sequenced(jsonl.read_trace(spark, folder)).orderBy("run_id", "seq").collect()
        assert [(r.run_id, r.attempt) for r in read] == [(f"r{k}", i) for k in range(3) for i in range(k, 300, 3)]
        assert [r.seq for r in read] == [*range(1, 101)] * 3
        assert not parts or all(len({r.block.file for r in read if r.run_id == k}) == parts for k in ("r0", "r1", "r2"))
    first = {r.run_id: (r.first_time, r.last_time) for r in runs.first_and_last_times(jsonl.read_trace(spark, folder)).collect()}
    assert first["r1"] == (1.0, 298.0)


def test_packed_runs_keep_their_order_in_few_files(spark, tmp_path):
    rows = [(None if i % 40 == 7 else f"r {i % 40}", i, "agent_round", float(i)) for i in range(1200)]
    random.Random(2).shuffle(rows)
    events = spark.createDataFrame(rows, "run_id string, attempt long, event string, timestamp double").repartition(7)
    names = {k: "__HIVE_DEFAULT_PARTITION__" if k == 7 else f"r {k}" for k in range(40)}
    want = sorted((names[k], s + 1, i) for k in range(40) for s, i in enumerate(range(k, 1200, 40)))
    for parts in (None, 4):
        folder = str(tmp_path / f"packs{parts}")
        jsonl.write_runs(events, folder, ["attempt"], parts, packed=True)
        read = jsonl.sequenced(jsonl.read_trace(spark, folder)).collect()
        assert sorted((r.run_id, r.seq, r.attempt) for r in read) == want
        assert not parts or {len({r.block.file for r in read if r.run_id == k}) for k in names.values()} == {parts}
        assert len(list((tmp_path / f"packs{parts}").rglob("*.json"))) <= 4 * (parts or 1)


def bm25_by_loop(facts, query, k1=1.5, b=0.75):
    def tokens(t):
        return [x for x in re.findall(r"[^\W_]+", t.lower()) if len(x) > 1 and x not in STOP_WORDS]

    docs = [(i, tokens(f"{k} {t}")) for i, k, t in facts]
    mean = sum(len(t) for _, t in docs) / len(docs)
    out = {}
    for i, words in docs:
        score = 0.0
        for term in set(tokens(query)):
            tf, df = words.count(term), sum(term in w for _, w in docs)
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
        if score:
            out[i] = score
    return out


FACTS = [
    (1, "travel_goal", "Save for the trip to Japan"), (2, "rent", "Rent is due on the first"), (3, "trip", "Japan trip trip budget"),
    (4, "coffee", "Cut coffee spending"), (5, "empty", ""),
]


def test_stored_index_grows_by_batches(spark, tmp_path):
    """Versions are replaced, a batch without a commit is not seen, and scores equal those of the texts at every step."""
    kind, path = "id long, fact_key string, fact_text string, weight double, updated_at string", str(tmp_path / "index")
    search_index.create(spark, path, 8)
    now = {}
    batches = [FACTS[:3], [(2, "rent", "Japan"), *FACTS[3:]], [(3, "trip", ""), (9, "japan", "japan japan")], []]
    for k, batch in enumerate(batches):
        search_index.append(spark.createDataFrame([(i, a, b, 1.0, f"{i:03d}") for i, a, b in batch], kind), path)
        now |= {i: (i, a, b) for i, a, b in batch}
        facts = spark.createDataFrame([(i, a, b, 1.0, f"{i:03d}") for i, a, b in now.values()], kind)
        want = bm25_by_loop(list(now.values()), "the trip to Japan, rent")
        got = search.bm25(facts, "the trip to Japan, rent", index=path).collect()
        assert {r.id: round(r.bm25_score, 9) for r in got} == {i: round(s, 9) for i, s in want.items()}
        assert [r.id for r in got] == sorted(want, key=lambda i: (-want[i], -i))
        top = search.bm25(facts, "the trip to Japan, rent", 2, index=path).collect()
        assert [r.id for r in top] == [r.id for r in got][:2]
        assert [r.id for r in search.hybrid_search(facts, "japan", None, "m", 3, path).collect()] == [r.id for r in search.hybrid_search(facts, "japan", None, "m", 3).collect()]
        if k == 1:
            # Tables of a batch that broke off before its commit.
            broken = [("japan", 7, 5, 5, "broken", 0)]
            for bucket in {r.bucket for r in spark.read.parquet(path + "/postings").select("bucket").distinct().collect()}:
                spark.createDataFrame([(*r[:5], bucket) for r in broken], "term string, id long, tf long, length long, batch string, bucket int").write.mode("append").partitionBy("bucket").parquet(path + "/postings")
            spark.createDataFrame([(1, "none", "broken")], "id long, batch string, by string").write.mode("append").parquet(path + "/replaced")
    assert search.bm25(facts, "absent words", index=path).count() == 0


def test_tasks_of_an_index_append_do_not_grow_with_the_batch(spark, tmp_path, monkeypatch):
    """Files, one a task and bucket, hold about as many postings for four times the facts."""
    monkeypatch.setattr(search_index, "TASK_TOKENS", 1000)
    kind, most = "id long, fact_key string, fact_text string", []
    for n in (200, 800):
        path = str(tmp_path / f"index{n}")
        rows = [(i, "key", " ".join(f"word{(i * j) % 97}" for j in range(1, 20))) for i in range(n)]
        search_index.create(spark, path, 2)
        search_index.append(spark.createDataFrame(rows, kind), path)
        stored = spark.read.parquet(path + "/postings").withColumn("file", F.input_file_name())
        most.append(max(r["count"] for r in stored.groupBy("file").count().collect()))
        want = Counter((i, t) for i, k, text in rows for t in f"{k} {text}".split())
        assert {(r.id, r.term): r.tf for r in stored.collect()} == want
    assert max(most) < 1500


def test_facts_alike_in_id_and_length_are_one(spark, tmp_path):
    path = str(tmp_path / "index")
    search_index.create(spark, path, 2)
    rows = [(1, "a1", "trip trip rent"), (1, "a1", "trip rent rent"), (2, "a1", "trip"), (None, "", "rent"), (None, "", "rent"), (3, "", "")]
    search_index.append(spark.createDataFrame(rows, "id long, fact_key string, fact_text string"), path)
    got = {(r.term, r.id, r.tf, r.length) for r in spark.read.parquet(path + "/postings").collect()}
    assert got == {("a1", 1, 2, 4), ("trip", 1, 3, 4), ("rent", 1, 3, 4), ("a1", 2, 1, 2), ("trip", 2, 1, 2), ("rent", None, 2, 1)}


def test_search(spark):
    vectors = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8], 4: None, 5: [1.0, 0.0, 0.0]}
    rows = [(i, k, t, 1.0, f"2026-01-0{i}", vectors[i], "m" if i != 2 else "old") for i, k, t in FACTS]
    schema = "id long, fact_key string, fact_text string, weight double, updated_at string, embedding array<double>, embedding_model string"
    facts = spark.createDataFrame(rows, schema)
    want = bm25_by_loop(FACTS, "What is the trip goal in Japan?")
    got = search.bm25(facts, "What is the trip goal in Japan?").collect()
    assert {r.id: round(r.bm25_score, 9) for r in got} == {i: round(s, 9) for i, s in want.items()}
    assert [r.id for r in got] == sorted(want, key=lambda i: -want[i]) and got[0].matched_terms == sorted(got[0].matched_terms)
    assert search.bm25(facts, "the of and").count() == 0
    near = search.vector_search(facts, [1.0, 0.0], "m").collect()
    assert [(r.id, round(r.similarity, 6)) for r in near] == [(1, 1.0), (3, 0.6)]
    mixed = search.hybrid_search(facts, "Japan trip", [1.0, 0.0], "m").collect()
    assert {r.id for r in mixed} == {1, 3} and mixed[0].retrieval_sources == ["vector", "bm25"]
    assert [r.id for r in search.hybrid_search(facts, "coffee", None, "m").collect()] == [4]
    assert search.bm25(facts.where("false"), "trip").count() == 0
    for bad in ([], [0.0, 0.0], [float("nan")]):
        with pytest.raises(ValueError):
            search.vector_search(facts, bad, "m")
    pending = [r.id for r in history.needing_embedding(facts, "m").collect()]
    assert pending == [4, 2]


def test_facts_and_threads(spark):
    schema = "id long, fact_key string, fact_text string, source_short_term_id long, weight double, updated_at string, embedding array<double>, embedding_model string"
    old = spark.createDataFrame([(1, "a", "x", 7, 1.0, "1", [1.0], "m"), (2, "b", "y", 7, 3.0, "1", None, None)], schema)
    new = spark.createDataFrame([(None, "a", "x1", 8, 2.0, "2", None, None), (None, "a", "x2", 8, 2.0, "3", None, None), (None, "c", "z", 8, 1.0, "2", None, None)], schema).drop("id")
    rows = {r.fact_key: r for r in history.upsert_facts(old, new).collect()}
    assert (rows["a"].id, rows["a"].fact_text, rows["a"].embedding) == (1, "x2", None) and rows["c"].id is None
    assert [r.fact_key for r in history.top_facts(old).collect()] == ["b", "a"]
    asked = spark.createDataFrame([("email", "k", 5), ("email", "k", 3), ("email", "z", 1)], "channel string, external_key string, created_at int")
    first = history.new_threads(asked, spark.createDataFrame([], "internal_id string"))
    assert sorted(r.created_at for r in first.collect()) == [1, 3]
    assert history.new_threads(asked, first).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame(
        [(f"r{i % 3}", i, ("model_call", "model_response", "tool_call", "agent_round")[i % 4], "author", None, i, None, None, None, None, 0.5) for i in range(60)],
        EVENT_SCHEMA,
    )
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in (0, 1):
        events.where(F.col("seq") % 2 == part).repartition(3).write.mode("append").json(source)
        follow_runs(spark, source, target, check, files_per_batch=2).awaitTermination()
    # The second run only saw the new files, and the state still covers all events.
    assert sorted(current_state(spark, target).collect()) == sorted(run_state(events).collect())


def test_live_state_is_compacted(spark, tmp_path):
    """Readers open one version and the batches after it; events that come late and twice-run batches change nothing."""
    source, target, check = (str(tmp_path / n) for n in ("events", "state", "check"))
    kinds = ["agent_round", "tool_call", "validation_cycle_result", "model_response", "run_completed", "validation_stalled"]
    rows = [(f"r{i % 7}", i, kinds[i * 5 % 6], "author", i % 3, i % 4, i % 9, i % 2, None, None, i / 8) for i in range(400)]
    random.Random(3).shuffle(rows)
    for step in range(4):
        seen = spark.createDataFrame(rows[: 100 * (step + 1)], EVENT_SCHEMA)
        spark.createDataFrame(rows[100 * step : 100 * (step + 1)], EVENT_SCHEMA).coalesce(1).write.mode("append").json(source)
        query = follow_runs(spark, source, target, check)
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
        want = sorted(run_state(seen).collect())
        assert sorted(current_state(spark, target).collect()) == want
        if step in (1, 3):
            assert compact(spark, target) == step and compact(spark, target) == step
            # What lies in batches of the version is not read again.
            old = spark.read.parquet(f"{target}/batches/batch=0")
            old.write.mode("append").parquet(f"{target}/batches/batch=0")
            assert sorted(current_state(spark, target).collect()) == want
            filters = [t.split("PushedFilters")[0] for t in current_state(spark, target)._jdf.queryExecution().toString().split("PartitionFilters")[1:]]
            assert len(filters) == 2 and any(f"> {step}" in f for f in filters) and any(f"= {step}" in f for f in filters)
    assert current_state(spark, target).count() == 7


def test_landing_once_and_archive(spark, tmp_path):
    source, target, check, archive = (tmp_path / n for n in ("in", "out", "check", "archive"))
    source.mkdir()
    header = ",".join(cards.CHASE.columns)
    (source / "a.csv").write_text(f'{header}\n08/01/2026,08/02/2026,"SHOP, A",Gas,Sale,-5.00,\n')

    def land():
        land_new_exports(spark, str(source), str(target), str(check), cards.CHASE, ("Memo",), str(archive)).awaitTermination()

    land()
    land()
    (source / "b.csv").write_text(f"{header}\n08/03/2026,08/03/2026,SHOP B,Gas,Sale,-6.00,m\n")
    land()
    rows = cards.read_exports(spark, str(target), cards.CHASE, ("Memo",))
    assert sorted(r.Description for r in rows.collect()) == ["SHOP B", "SHOP, A"] and "Memo" not in rows.columns
    assert not (source / "a.csv").exists() and list(archive.rglob("a.csv"))


def test_wrong_header_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Other\n1,2\n")
    with pytest.raises(Exception):
        cards.read_exports(spark, str(tmp_path), cards.CHASE).collect()


def test_passage_search(spark):
    vectors = {0: [1.0, 0.0], 1: [0.6, 0.8], 2: [0.0, 0.0], 3: [1.0], 4: [-1.0, 0.1], 5: [0.9, 0.1]}
    rows = [(1, i, f"p{i}", v) for i, v in vectors.items()]
    passages = spark.createDataFrame(rows, "doc_id int, passage_no int, passage string, embedding array<double>")

    def score(v):
        size = math.sqrt(sum(x * x for x in v))
        return v[0] / size if len(v) == 2 and size else -1.0

    want = sorted(vectors, key=lambda i: (-score(vectors[i]), i))
    got = search.passage_search(passages, [2.0, 0.0], 6).collect()
    assert [r.passage_no for r in got] == want
    assert [round(r.similarity, 9) for r in got] == [round(score(vectors[i]), 9) for i in want]
