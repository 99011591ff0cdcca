import random
from datetime import date
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from outlay.operators import periods
from outlay.operators.resolve import closest, match_values, name_index
from outlay.plans import catalog, change, profile, snapshot
from outlay.plans.repair import SpecError, regrouped, repair
from outlay.plans.spec import AnalysisSpec
from tests import cards

LATEST, PREVIOUS = date(2026, 8, 1), date(2026, 7, 1)
CATEGORIES = ("Groceries", "Food & Drink", "Shopping", "Entertainment", "Travel")
NOW, BEFORE = (600, 300, 200, 100, 50), (500, 250, 260, 100, None)


def month_rows(spark, extra=()):
    rows = []
    for name, now, before in zip(CATEGORIES, NOW, BEFORE):
        group = "Needs" if name == "Groceries" else "Wants"
        rows.append((LATEST, name, group, float(now)))
        if before is not None:
            rows.append((PREVIOUS, name, group, float(before)))
    rows += list(extra)
    schema = "transaction_month date, category string, parent_group string, net_real_expense double"
    return spark.createDataFrame(rows, schema)


def snap(spark, deposit, fixed, goal=None, goals=None, extra=()):
    s = snapshot.monthly_snapshot(month_rows(spark, extra), deposit, fixed, goal, goals)
    return s.header.first(), {r.category: r for r in s.categories.collect()}, s


def test_shortfall_is_shared(spark):
    h, c, s = snap(spark, 3000, 1500, 500)
    assert (h.projected_savings, h.savings_shortfall, h.eligible_discretionary_total) == (250, 250, 650)
    assert (h.goal_method, h.discretionary_cuts_insufficient, h.remaining_gap_after_cuts) == (
        "shortfall_allocation", False, 0,
    )
    food = c["Food & Drink"]
    assert float(food.suggested_cap) == round(300 - 250 * 300 / 650, 2)
    assert food.percent_of_cap == round(300 / float(food.suggested_cap) * 100, 2)
    assert abs(sum(r.suggested_cap for r in c.values() if r.is_discretionary) - 400) < 1
    assert c["Groceries"].suggested_cap is None
    assert h.top_discretionary_categories == ["Food & Drink", "Shopping", "Entertainment"]
    assert [r.category for r in s.notable.collect()] == []


def test_shortfall_beyond_spending(spark):
    h, c, _ = snap(spark, 2000, 1500, 1000)
    assert (h.savings_shortfall, h.discretionary_cuts_insufficient, h.remaining_gap_after_cuts) == (1750, True, 1100)
    assert all(r.suggested_cap == 0 and r.percent_of_cap is None for r in c.values() if r.is_discretionary)


def test_target_met(spark):
    h, c, _ = snap(spark, 6000, 1500, 500)
    assert h.goal_method == "trend_maintenance"
    caps = {k: (r.suggested_cap, r.mom_direction) for k, r in c.items()}
    assert caps["Food & Drink"] == (250, "increase") and caps["Shopping"] == (200, "decrease")
    assert caps["Entertainment"] == (100, "flat") and caps["Travel"][0] == 50


def test_goals_and_refunds(spark):
    h, c, _ = snap(spark, 3000, 1500, 500, {"Shopping": 160})
    assert (c["Shopping"].cap_source, c["Shopping"].percent_of_cap, c["Shopping"].goal_percent) == ("configured", 125, 125)
    goals = {"Food & Drink": 280, "Shopping": 180, "Entertainment": 90, "Travel": 40}
    assert snap(spark, 3000, 1500, 500, goals)[0].goal_method == "configured"
    h, c, s = snap(spark, 3000, 1500, extra=[(LATEST, "Payments", "Payments & Others", -900.0)])
    assert h.goal_method == "no_savings_target" and h.savings_shortfall is None
    assert c["Payments"].is_refund and c["Payments"].bar_width_percent == 0 and c["Food & Drink"].bar_width_percent == 50
    # A refund without any positive spend in either month is no notable change.
    assert s.notable.count() == 0
    lines = {r.category: r.line for r in snapshot.category_lines(s).collect()}
    assert lines["Payments"].startswith("Payments: current -$900.00; previous $0.00; MoM no percentage")
    groups = [r.line for r in snapshot.group_lines(s).collect()]
    assert groups[-1].startswith("Wants: ") and "Payments -$900.00 (label as refund/credit)." in groups[1]


def test_empty_snapshot(spark):
    s = snapshot.monthly_snapshot(month_rows(spark).where("false"), 1, 1)
    assert s.header.count() == 0 and s.categories.count() == 0


def tx(month, day, text, spend, kind="Sale"):
    return (date(2026, month, day), text, -float(spend), kind, "Groceries", "Needs")


CHANGES = [
    tx(8, 3, "  whole foods  #12 ", 80), tx(8, 10, "WHOLE FOODS #12", 70), tx(8, 12, "Corner Market", 100),
    tx(8, 20, "Farm Stand", 30), tx(9, 2, "Whole Foods #12", 120), tx(9, 9, "whole foods #12", 110),
    tx(9, 15, "Whole Foods #12", 90), tx(9, 18, "Bulk Club", 250), tx(9, 21, "Corner Market", 40),
    tx(9, 25, "Bulk Club", -50, "Return"), tx(9, 26, "Card payment", 999, "Payment"), tx(7, 5, "Whole Foods #12", 500),
]
FACT = "transaction_date date, description string, amount double, transaction_type string, category string, parent_group string"


def explained(spark, rows, top=5):
    facts = spark.createDataFrame(rows, FACT).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return change.explain_change(facts, "Groceries", date(2026, 9, 1), top)


def test_change(spark):
    r = explained(spark, CHANGES)
    h = r.header.first()
    assert (h.current_count, h.current_net, h.current_average, h.current_largest) == (6, 560, 93.33, 250)
    assert (h.previous_count, h.previous_net, h.previous_average, h.previous_largest) == (4, 280, 70, 100)
    assert (h.change_usd, h.from_transaction_count, h.from_average_amount) == (280, 140, 140)
    up = [(x.description, x.change) for x in r.increases.collect()]
    assert up == [("BULK CLUB", 200), ("WHOLE FOODS #12", 170)]
    assert [(x.description, x.change) for x in r.decreases.collect()] == [("CORNER MARKET", -60), ("FARM STAND", -30)]
    assert [x.description for x in r.new.collect()] == ["BULK CLUB"]
    assert [x.amount for x in r.largest.collect()] == [250, 120, 110]
    assert not h.limited
    one = explained(spark, CHANGES, 1)
    assert one.increases.count() == one.largest.count() == 1


def test_change_edges(spark):
    rows = [tx(9, d, f"POS {d}", 10 + d) for d in range(1, 11)] + [tx(8, d, f"OLD {d}", 5) for d in range(1, 4)]
    assert explained(spark, rows).header.first().limited
    only = explained(spark, [tx(9, 1, "A", 25), tx(9, 2, "B", 75)]).header.first()
    assert (only.from_transaction_count, only.from_average_amount, only.previous_average) == (100, 0, None)
    assert explained(spark, [tx(7, 1, "A", 1)]).header.count() == 0


def test_profile(spark):
    frame = cards.frame(spark)
    p = {r.dimension: r for r in profile.profile(frame, cards.TODAY).collect()}
    assert p["issuer"].status == "usable" and p["issuer"].reason.startswith("2 cards, a median of")
    assert p["month"].reason == "3 complete months of data" and p["day_of_month"].status == "limited"
    assert p["category"].distinct == 6 and len(p["category"].top_values) == 5
    c = profile.coverage(frame, cards.TODAY).first()
    assert c.complete_months == ["2026-07", "2026-08", "2026-09"] and c.partial_months == ["2026-06", "2026-10"]
    assert (c.latest_complete_month, c.data_end_lag_days, c.transactions) == ("2026-09", 2, 32)
    chase = {r.dimension: r for r in profile.profile(frame.where("issuer = 'Chase'"), cards.TODAY).collect()}
    assert (chase["issuer"].status, chase["issuer"].reason) == ("unusable", "only 1 card in the data")
    empty = profile.profile(frame.where("false"), cards.TODAY).collect()
    assert len(empty) == 9 and {r.status for r in empty} == {"unusable"}


def test_catalog(spark):
    row = catalog.catalog(cards.frame(spark)).first()
    assert (row.date_min, row.date_max, row.months, row.transactions) == ("2026-06-15", "2026-10-03", 5, 32)
    assert row.categories["Groceries"] == ["Needs"] and row.issuers == ["Amex", "Chase"]
    assert row.merchants[0] == "Amazon" and row.merchant_count == len(row.merchants)
    found = catalog.list_values(cards.frame(spark), "merchant", "s", 3).collect()
    assert len(found) == 3 and found[0].total_matches > 3


OPTIONS = ["Groceries", "Food & Drink", "Shopping", "Automotive", "Other", "Payments"]


def test_matching_agrees_with_difflib(spark):
    options = spark.createDataFrame([(o,) for o in OPTIONS], "value string")
    wanted = ["groceries", "shop", "Grocerys", "autmotive", "zzzz", "o"]
    got = {r.wanted: (r.resolved, r.how) for r in match_values(wanted, options).collect()}
    assert got["groceries"] == ("Groceries", "exact") and got["shop"] == ("Shopping", "contains")
    assert got["Grocerys"] == ("Groceries", "close") and got["autmotive"] == ("Automotive", "close")
    assert got["zzzz"] == (None, None)
    low = {o.lower(): o for o in OPTIONS}
    rows = closest(wanted, options).collect()
    for w in wanted:
        want = [low[x] for x in get_close_matches(w.lower(), list(low), n=5, cutoff=0.0)]
        mine = sorted((r for r in rows if r.wanted == w), key=lambda r: r.place)
        assert [r.value for r in mine] == want
        assert all(r.ratio == SequenceMatcher(None, r.value.lower(), w.lower()).ratio() for r in mine)


def test_closest_equals_difflib_over_many_names(spark):
    rng = random.Random(4)
    parts = ["blue", "red", "anvil", "gizmo", "ring", "shop", "cafe", "é", "store", "x"]
    options = {" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)} | {"", "Zz"}
    options |= {"".join(rng.choice("abcdr ") for _ in range(rng.randint(1, 9))).strip() for _ in range(200)}
    low = {o.lower(): o for o in sorted(options, reverse=True)}
    table = spark.createDataFrame([(o,) for o in [*options, None]], "value string")
    wanted = ["blu anvl", "shop shop", "caf", "qqqq", "", "rng redd", "é é x", "abcabc", "gizmo"]
    plan = closest(wanted, table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    index = name_index(table).cache()
    for limit, cutoff, given in ((5, 0.0, None), (2, 0.5, index)):
        got = {w: [] for w in wanted}
        for r in closest(wanted, table, limit, cutoff, given).collect():
            got[r.wanted].append((r.place, r.value, r.ratio))
        for w in wanted:
            want = [low[x] for x in get_close_matches(w, list(low), n=limit, cutoff=cutoff)]
            assert [v for _, v, _ in sorted(got[w])] == want, (w, limit, cutoff)
            assert all(r == SequenceMatcher(None, v.lower(), w).ratio() for _, v, r in got[w])
    index.unpersist()


def test_repair(spark):
    frame = cards.frame(spark).cache()
    spec = AnalysisSpec(group_by="merchant", filters={"category": "grocerys", "issuer": "chase"}, date_from="2020-01", date_to="2026-08")
    fixed, notes = repair(spec, frame, cards.TODAY)
    assert fixed.filters.category == ("Groceries",) and fixed.filters.issuer == ("Chase",) and fixed.top_n == 10
    assert (fixed.period, fixed.date_from, fixed.date_to) == ("custom", "2026-06-15", "2026-08-31")
    assert any("cut to the days with data" in n for n in notes)
    with pytest.raises(SpecError, match="Nearest category values: "):
        repair(AnalysisSpec(filters={"category": "zzzz"}), frame, cards.TODAY)
    with pytest.raises(SpecError, match="outside"):
        repair(AnalysisSpec(date_from="2020-01", date_to="2020-02"), frame, cards.TODAY)
    many, notes = repair(AnalysisSpec(filters={"merchant": "tar"}), frame, cards.TODAY)  # Starbucks and Target
    assert many.filters.merchant_contains == "tar" and many.filters.merchant == () and "Starbucks, Target" in notes[0]
    raw, _ = repair(AnalysisSpec(filters={"merchant": "STARBUCKS STORE 9999"}), frame, cards.TODAY)
    assert raw.filters.merchant == ("Starbucks",)
    dropped, notes = repair(AnalysisSpec(group_by="month", transform="cumulative", compare_to="previous_period"), frame, cards.TODAY)
    assert dropped.transform == "none" and "comparisons take no transform" in notes[0]
    p = profile.profile(frame, cards.TODAY)
    swapped, notes = repair(AnalysisSpec(group_by="day_of_month"), frame, cards.TODAY, p)
    assert swapped.group_by == ("weekday",) and "tells little" in notes[0]
    status = {"merchant": ("unusable", "one each"), "category": ("limited", "few"), "month": ("unusable", "short")}
    assert regrouped(("merchant", "category"), status, False)[0] == ("parent_group", "category")
    assert regrouped(("category", "merchant"), status, False)[0] == ("parent_group",)
    assert regrouped(("merchant", "month"), status, True)[0] == ("merchant", "month")


def resolved(spark, ask, today=cards.TODAY, lo=date(2024, 10, 1), hi=date(2026, 10, 3)):
    bounds = spark.createDataFrame([(lo, hi)], "data_min date, data_max date")
    return periods.resolve(bounds, today, [ask]).first()


def test_periods(spark):
    ask = periods.Ask
    r = resolved(spark, ask("last_12_months"))
    assert (r.start, r.end, r.label) == (date(2025, 10, 1), date(2026, 9, 30), "Oct 2025–Sep 2026 (last 12 months)")
    r = resolved(spark, ask("last_quarter"), date(2026, 2, 10))
    assert (r.start, r.end) == (date(2025, 10, 1), date(2025, 12, 31))
    r = resolved(spark, ask("focus_month", focus_month=date(2026, 8, 17)))
    assert (r.start, r.end) == (date(2026, 8, 1), date(2026, 8, 31))
    r = resolved(spark, ask("custom", "2026-05", "2026-03"))
    assert (r.start, r.end) == (date(2026, 3, 1), date(2026, 5, 31)) and "swapped" in r.notes[0]
    r = resolved(spark, ask("last_month"), hi=date(2026, 8, 20))
    assert (r.start, r.end) == (date(2026, 7, 1), date(2026, 7, 31))
    assert r.notes[0] == "Data ends Aug 20, 2026; 'last month' = Jul 2026 (the latest complete month)."
    r = resolved(spark, ask("last_year"), lo=date(2026, 6, 15), hi=date(2026, 8, 20))
    assert "No data" in r.notes[0]


def test_comparison_windows(spark):
    def window(start, end, kind):
        c = periods.comparison(F.lit(start), F.lit(end), kind)
        return tuple(spark.range(1).select(c.start.alias("a"), c.end.alias("b"), c.months.alias("m"), c.days.alias("d")).first())

    q = (date(2026, 7, 1), date(2026, 9, 30))
    assert window(*q, "previous_period") == (date(2026, 4, 1), date(2026, 6, 30), 3, 0)
    assert window(*q, "same_period_last_year")[:3] == (date(2025, 7, 1), date(2025, 9, 30), 12)
    assert window(date(2026, 10, 1), date(2026, 10, 5), "previous_period")[:3] == (date(2026, 9, 1), date(2026, 9, 5), 1)
    days = window(date(2026, 2, 10), date(2026, 2, 20), "previous_period")
    assert days == (date(2026, 1, 30), date(2026, 2, 9), 0, 11)
