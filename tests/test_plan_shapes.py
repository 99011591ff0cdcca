"""What the planner makes of the main paths: pushed filters, pruned columns, bounded ranks, no products."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from outlay.operators import claims, gold, history
from outlay.operators.ordered import keep_largest_copies, neighbours
from outlay.plans import catalog, profile, progress, runs, search, search_index, snapshot
from outlay.plans.analyze import Context, analyze
from outlay.plans.spec import AnalysisSpec
from outlay.queries import registry
from outlay.sources import cards as exports, tables
from outlay.sources.sample import Sample
from tests import cards


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gold") / "frame")
    tables.write_table(cards.frame(spark), path, "month")
    return path


def test_fact_scan_pushes_the_date_and_prunes(spark, stored):
    text = plan(tables.read_facts(spark, stored, start=date(2026, 9, 1)).select("amount"))
    assert "GreaterThanOrEqual(transaction_date,2026-09-01)" in text
    assert "ReadSchema: struct<transaction_date:date,amount:decimal(38,9)>" in text


def test_analysis_filters_are_literal(spark, stored):
    frame = spark.read.parquet(stored)
    context = Context(cards.TODAY, date(2026, 6, 15), date(2026, 10, 3))
    done = analyze(frame, AnalysisSpec(group_by="month", period="last_month", filters={"issuer": "Amex"}), context)
    text = plan(done.grouped)
    assert "EqualTo(issuer,Amex)" in text and "GreaterThanOrEqual(transaction_date,2026-09-01)" in text
    assert "merchant" not in text.split("ReadSchema")[1]
    done.release()


def test_facts_need_one_shuffle(spark, stored):
    rows = spark.read.parquet(stored).withColumn("transaction_month", F.last_day("transaction_date"))
    text = plan(gold.fact_monthly_spending(rows))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_ranks_are_cut_before_the_shuffle(spark):
    turns = spark.range(100).select((F.col("id") % 3).alias("thread_id"), "id", F.col("id").alias("created_at"))
    text = plan(history.newest_turns(turns))
    assert text.count("WindowGroupLimit") == 2


def test_no_products(spark):
    rows = spark.range(10).select(F.lit("f").alias("file"), F.col("id").alias("key"), F.lit("m").alias("memo"))
    near = spark.range(10).select(F.lit("r").alias("run"), "id", F.lit(0).alias("b"))
    for df in (keep_largest_copies(rows, "file", ["key"]), neighbours(near, ["run"], "b", ["id"], ["id"])):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_kept_copies_are_joined_before_they_are_read(spark):
    """Shuffles of all rows are over, and removed, when the plan is made; only rows with copies are spread."""
    rows = spark.range(10).select(F.lit("f").alias("file"), F.col("id").alias("key"), F.lit("m").alias("memo"))
    text = plan(keep_largest_copies(rows, "file", ["key"]))
    assert text.count("Exchange") == 1 and "Join" not in text and "Window" not in text


def test_snapshot_reads_the_facts_once(spark, stored):
    done = snapshot.month_snapshot(spark.read.parquet(stored), "2026-09-01", 3000, 1500, savings_goal=500, category_goals={"Travel": 10})
    for df in (done.header, done.categories, done.notable, snapshot.shown_categories(done), snapshot.category_lines(done)):
        text = plan(df)
        assert text.count("FileScan") == 1 and text.count("Exchange") <= 3 and "Subquery" not in text
    assert plan(snapshot.group_lines(done)).count("FileScan") == 1


def test_run_reports_read_events_and_findings_once(spark, tmp_path):
    kind = ("run_id string, block long, line long, event string, timestamp double, role string, name string, elapsed_seconds double, prompt_eval_count long, "
            "eval_count long, done_reason string, cost_usd double, error_count long, error_count_delta long")  # fmt: skip
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "events"))
    assert plan(runs.run_summary(spark.read.parquet(str(tmp_path / "events")))).count("FileScan") == 1
    spark.createDataFrame([], "run_id int, cycle int, position int, severity string, category string, message string").write.parquet(str(tmp_path / "findings"))
    spark.createDataFrame([], "run_id int, cycle int, decision string").write.parquet(str(tmp_path / "reviews"))
    text = plan(progress.cycle_progress(spark.read.parquet(str(tmp_path / "findings")), spark.read.parquet(str(tmp_path / "reviews"))))
    assert text.count("FileScan") == 2 and "Join" not in text
    spark.createDataFrame([], "run_id string, cost_usd double").write.parquet(str(tmp_path / "spend"))
    assert plan(runs.ledger_entries(spark.read.parquet(str(tmp_path / "spend")))).count("FileScan") == 1


FACT = "id long, fact_key string, fact_text string, weight double, updated_at string"


def test_a_question_tokenizes_each_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "k", "some text", 1.0, "1")], FACT).write.parquet(str(tmp_path / "f"))
    found = search.bm25(spark.read.parquet(str(tmp_path / "f")), "some words")
    # The one pass is over when the plan is made: it wrote lengths and hits, which the plan reads instead of texts.
    assert "regexp_extract_all" not in plan(found) and found.count() == 1


def test_a_question_opens_the_buckets_of_its_terms(spark, tmp_path):
    rows = [(i, f"k{i}", " ".join(f"word{(i * j) % 97}" for j in range(1, 9)), 1.0, str(i)) for i in range(200)]
    facts, index = spark.createDataFrame(rows, FACT), str(tmp_path / "index")
    search_index.create(spark, index)
    search_index.append(facts, index)
    found = search_index.postings(spark, index, ["word5", "absent"])
    text = plan(found)
    assert "bucket" in text.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in text
    scan = spark.read.parquet(index + "/postings")
    opened = {r.bucket for r in scan.where(scan.term == "word5").select("bucket").distinct().collect()}
    assert len(opened) == 1 and scan.select("bucket").distinct().count() > 50
    assert {r.id for r in found.collect()} == {i for i, _, t, _, _ in rows if "word5" in t.split()}


def test_months_outside_the_dates_are_not_opened(spark, stored, tmp_path):
    rows = spark.read.parquet(stored)
    facts, frame = str(tmp_path / "facts"), str(tmp_path / "frame")
    tables.write_table(rows.withColumn("transaction_month", F.last_day("transaction_date")), facts, "transaction_month")
    tables.write_table(rows.withColumn("month", F.trunc("transaction_date", "MM")), frame, "month")
    text = plan(tables.read_facts(spark, facts, start=date(2026, 9, 1)))
    assert "2026-09-30" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    context = Context(cards.TODAY, date(2026, 6, 15), date(2026, 10, 3))
    done = analyze(spark.read.parquet(frame), AnalysisSpec(group_by="category", period="last_month"), context)
    assert "month" in plan(done.grouped).split("PartitionFilters")[1].split("PushedFilters")[0]
    done.release()


def test_claims_are_not_sent_to_the_driver(spark, tmp_path):
    """Files of compressed texts say nothing about the number of claims in them."""
    spark.createDataFrame([(1, "$5 and 3%")], "report_id int, text string").write.parquet(str(tmp_path / "texts"))
    spark.createDataFrame([(1, 5.0)], "report_id int, number double").write.parquet(str(tmp_path / "known"))
    texts, known = (spark.read.parquet(str(tmp_path / n)) for n in ("texts", "known"))
    bad = claims.unmatched_claims(claims.written_claims(texts), known)
    assert "Broadcast" not in plan(bad) and [r.claim for r in bad.collect()] == ["3%"]


def test_profile_and_catalog_are_made_of_written_sums(spark, stored):
    """Each frame is read by the one pass that is over when the plan is made."""
    frame = spark.read.parquet(stored)
    for df in (profile.profile(frame, cards.TODAY), catalog.catalog(frame), catalog.list_values(frame, "merchant")):
        assert stored not in plan(df) and df.count() > 0


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Four lines of two orders and two parts."""
    root = str(tmp_path_factory.mktemp("tiny"))
    lines = [(1, 1, 7, 1, 5.0, 100.0, 0.01, "N", "O"), (1, 2, 8, 2, 6.0, 50.5, 0.02, "A", "F"), (2, 1, 7, 1, 7.0, 20.0, 0.0, "R", "O"), (2, 2, 7, 2, 8.0, 30.0, 0.08, "N", "F")]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, kind).withColumn("l_shipdate", F.to_date(F.lit("2001-09-03"))).write.parquet(root + "/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, "2-HIGH")], "o_orderkey long, o_orderpriority string").write.parquet(root + "/orders.parquet")
    spark.createDataFrame([(1, "blue anvil"), (2, "hot rod")], "p_partkey long, p_name string").write.parquet(root + "/part.parquet")
    return root


def test_names_are_read_from_a_written_dictionary(spark, tiny):
    s = Sample(spark, tiny)
    assert "lineitem" not in plan(s.merchant_names)
    assert {r.value for r in s.merchant_names.collect()} == {"Blue Anvil", "Hot Rod"}
    assert s.named_frame.exceptAll(s.frame).count() == s.frame.exceptAll(s.named_frame).count() == 0


def test_a_percent_text_computes_its_percent_once(spark, tiny):
    shown = registry()["f19_percent_text"].build(Sample(spark, tiny))
    assert plan(shown).count(" div ") == 1
    assert sorted(r.shown for r in shown.collect())[-1] == "no percentage (previous amount was $0.00)"


def test_exports_are_written_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'two\nlines, "quoted"')], "a string, b string")
    exports.write_export(rows, str(tmp_path / "out"))
    names = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert names and all(n.endswith(".csv.gz") for n in names)
