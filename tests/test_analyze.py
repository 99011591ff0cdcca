from datetime import date

import pytest

from outlay.plans.analyze import Context, analyze, display_table
from outlay.plans.spec import AnalysisSpec
from tests import cards

LABELS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


@pytest.fixture(scope="module")
def frame(spark):
    return cards.frame(spark).cache()


def run(frame, **spec):
    return analyze(frame, AnalysisSpec(**spec), Context(cards.TODAY))


def rows(done, *columns):
    return [tuple(r) for r in (done.table.select(*columns) if columns else done.table).collect()]


def one(done):
    return done.summary.collect()[0]


def test_net_by_month(frame):
    done = run(frame, group_by="month", period="last_quarter")
    assert rows(done) == [("2026-07", 301.5), ("2026-08", 490.5), ("2026-09", 470.0)]
    s = one(done)
    assert (s.total, s.transactions, s.period) == (1262.0, 29, "Jul–Sep 2026 (last quarter)")
    assert s.largest_change.change == 189.0
    assert s.caption.startswith("Net spend by month, Jul–Sep 2026 (last quarter).")


@pytest.mark.parametrize(
    "metric,expected,total",
    [
        ("net_spend", [490.0, 410.0, 202.0, 170.0, -15.0, 5.0], 1262.0),
        ("gross_spend", [490.0, 490.0, 202.0, 170.0, 0.0, 5.0], 1357.0),
        ("refunds", [0.0, 80.0, 0.0, 0.0, 15.0, 0.0], 95.0),
        ("transaction_count", [8, 6, 9, 4, 1, 1], 29),
        ("avg_transaction", [61.25, 68.33, 22.44, 42.5, -15.0, 5.0], 43.52),
    ],
)
def test_metrics_by_category(frame, metric, expected, total):
    done = run(frame, metric=metric, group_by="category", period="last_quarter")
    names = ("Groceries", "Shopping", "Food & Drink", "Automotive", "Payments", "Other")
    assert dict(rows(done)) == dict(zip(names, expected))
    assert one(done).total == total


def test_sorts(frame):
    done = run(frame, group_by="category", period="last_quarter")
    # The literal category Other sorts last whatever its value.
    assert [r[0] for r in rows(done)] == ["Groceries", "Shopping", "Food & Drink", "Automotive", "Payments", "Other"]
    assert rows(run(frame, group_by="category", period="last_quarter", sort="asc"))[0] == ("Payments", -15.0)
    by_label = rows(run(frame, group_by="category", period="last_quarter", sort="label"))
    assert [r[0] for r in by_label] == sorted(r[0] for r in by_label)


def test_share(frame):
    done = run(frame, metric="share_of_total", group_by="parent_group", period="last_quarter")
    assert rows(done) == [("Needs", 52.3), ("Wants", 48.5), ("Payments & Others", -0.8)]
    assert done.unit == "pct" and one(done).total == 100.0


def test_no_dimension(frame):
    done = run(frame, metric="avg_transaction", period="last_quarter", filters={"category": ["Groceries"]})
    assert rows(done) == [(61.25,)]


def test_grids(frame):
    done = run(frame, group_by="month", period="last_6_months", filters={"category": ["Automotive"]})
    assert [v for _, v in rows(done)] == [0, 0, 0, 40, 45, 85]
    done = run(frame, metric="transaction_count", group_by="weekday", period="last_month")
    assert rows(done) == list(zip(LABELS, (2, 3, 1, 0, 2, 2, 2)))
    done = run(frame, metric="gross_spend", group_by=("month", "category"), period="last_quarter")
    got = {(m, c): v for m, c, v in rows(done)}
    assert len(got) == 18 and got["2026-07", "Other"] == 0 and got["2026-09", "Shopping"] == 210
    done = run(frame, metric="transaction_count", group_by=("month", "weekday"), period="last_quarter")
    assert len(rows(done)) == 21 and sum(r[2] for r in rows(done)) == 29
    done = run(frame, group_by="quarter", period="custom", date_from="2026-06", date_to="2026-09")
    assert rows(done) == [("2026-Q2", 70.0), ("2026-Q3", 1262.0)]
    done = run(frame, group_by="week", period="last_month")
    assert rows(done)[0][0] == "2026-08-31" and sum(r[1] for r in rows(done)) == 470
    assert [r[0] for r in rows(run(frame, group_by="day_of_month", period="last_month"))] == list(range(1, 31))


def test_folding(frame):
    done = run(frame, group_by="merchant", period="last_quarter", top_n=3)
    assert rows(done) == [("Amazon", 410.0), ("Wholefds Mkt", 310.0), ("Sushi Zen", 155.0), ("Other", 387.0)]
    assert "Top 3 shown" in one(done).caption
    done = run(frame, group_by=("month", "category"), period="last_quarter", top_n=2)
    assert {r[1] for r in rows(done)} == {"Groceries", "Other", "Shopping"}
    assert sum(r[2] for r in rows(done)) == 1262
    done = run(frame, group_by=("month", "merchant"), period="last_quarter")
    assert len({r[1] for r in rows(done)}) == 8  # seven merchants and Other
    top = run(frame, group_by="month", period="last_6_months", top_n=2)
    assert rows(top) == [("2026-08", 490.5), ("2026-09", 470.0)]


def test_payments_are_left_out(frame):
    names = [r[0] for r in rows(run(frame, group_by="merchant", period="all", top_n=25))]
    assert "Card Payment" not in names
    done = run(frame, period="all", filters={"merchant": ["Card Payment"]})
    s = one(done)
    assert s.total == 0 and "No matching transactions in this period." in s.notes


@pytest.mark.parametrize(
    "filters,metric,total",
    [
        ({"merchant_contains": "star"}, "net_spend", 21.5),
        ({"issuer": ["Amex"]}, "net_spend", 430.0),
        ({"exclude_category": ["Groceries", "Shopping"]}, "net_spend", 362.0),
        ({"min_amount": 100}, "transaction_count", 4),
        ({"max_amount": 9}, "transaction_count", 6),
        ({"merchant": ["sushi zen"]}, "net_spend", 155.0),
    ],
)
def test_filters(frame, filters, metric, total):
    assert one(run(frame, metric=metric, period="last_quarter", filters=filters)).total == total


def test_transforms(frame):
    done = run(frame, group_by="month", period="last_quarter", transform="cumulative")
    assert rows(done, "net_spend_cumulative") == [(301.5,), (792.0,), (1262.0,)]
    done = run(frame, group_by="month", period="last_6_months", transform="rolling_3")
    assert [r[0] for r in rows(done, "net_spend_rolling_3")] == [None, None, 23.33, 123.83, 287.33, 420.67]
    done = run(frame, group_by="month", period="last_6_months", transform="pct_change")
    assert [r[0] for r in rows(done, "net_spend_pct_change")] == [None, None, None, 330.7, 62.7, -4.2]
    assert one(done).latest.value == -4.2
    done = run(frame, group_by="category", period="last_quarter", transform="cumulative")
    assert done.value_column == "net_spend" and done.notes


def test_comparisons(frame):
    done = run(frame, group_by="category", period="last_month", compare_to="previous_period")
    got = {r[0]: r[1:] for r in rows(done)}
    assert got["Shopping"] == (150, 200, -50, -25) and got["Payments"] == (0, -15, 15, 100)
    s = one(done)
    assert tuple(s.comparison) == ("August 2026 (previous period)", 490.5, -20.5, -4.2)
    assert s.largest_change.label == "Shopping"
    done = run(
        frame, group_by="month", period="custom", date_from="2026-08", date_to="2026-09", compare_to="previous_period"
    )
    assert rows(done, "month", "net_spend", "comparison") == [("2026-08", 490.5, 70.0), ("2026-09", 470.0, 301.5)]


def test_known_dates_give_the_same_table(frame):
    spec = AnalysisSpec(group_by=("month", "category"), period="last_3_months")
    fixed = Context(cards.TODAY, date(2026, 6, 15), date(2026, 10, 3))
    assert rows(analyze(frame, spec, fixed)) == rows(analyze(frame, spec, Context(cards.TODAY)))


def test_display(frame):
    shown = display_table(run(frame, group_by=("month", "weekday"), period="last_month"))
    assert shown.columns == ["Month", "Weekday", "Net spend ($)"]
    assert tuple(shown.first())[:2] == ("Sep 2026", "Monday")


@pytest.mark.parametrize(
    "bad",
    [
        {"metric": "sum"}, {"group_by": ("month", "month")}, {"top_n": 26}, {"date_from": "2026-13"},
        {"filters": {"min_amount": 5, "max_amount": 1}},
    ],
)
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        AnalysisSpec(**bad)
