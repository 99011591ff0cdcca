"""A small hand-checked set of card transactions: (date, issuer, description, amount, type, category, group)."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

TODAY = date(2026, 10, 5)
SCHEMA = (
    "transaction_date date, issuer string, description string, amount decimal(38,9), transaction_type string, "
    "category string, parent_group string"
)
WHOLEFDS, JOE = "WHOLEFDS MKT #10234", "TRADER JOE S #552         800-555-0199        CA"
BOTTLE, SUSHI, STAR = "SQ *BLUE BOTTLE COFFEE", "TST* SUSHI ZEN", "STARBUCKS STORE 12345"
GROUPS = {
    "Groceries": "Needs", "Automotive": "Needs", "Food & Drink": "Wants", "Shopping": "Wants",
    "Payments": "Payments & Others", "Other": "Payments & Others",
}
# month: (day, issuer initial, description, cents, type, category)
MONTHS = {
    "2026-06": [(15, "C", WHOLEFDS, -7000, "Sale", "Groceries")],
    "2026-07": [
        (1, "C", WHOLEFDS, -10000, "Sale", "Groceries"),
        (3, "A", JOE, -5000, "Sale", "Groceries"),
        (5, "C", BOTTLE, -650, "Sale", "Food & Drink"),
        (10, "A", SUSHI, -4500, "Sale", "Food & Drink"),
        (12, "C", "AMZN Mktp US*2K3LM1", -8000, "Sale", "Shopping"),
        (15, "C", "AMZN Mktp US*9Q8RT", 2000, "Return", "Shopping"),
        (20, "A", "SHELL OIL 57444", -4000, "Sale", "Automotive"),
        (25, "C", "AUTOMATIC PAYMENT - THANK", 50000, "Payment", "Payments"),
        (28, "A", "AUTOPAY PAYMENT - THANK YOU", 30000, "Payment", "Payments"),
    ],
    "2026-08": [
        (1, "C", WHOLEFDS, -12000, "Sale", "Groceries"),
        (4, "A", JOE, -3000, "Sale", "Groceries"),
        (8, "C", "COSTCO WHSE #0123", -2500, "Sale", "Groceries"),
        (9, "C", BOTTLE, -1200, "Sale", "Food & Drink"),
        (14, "A", SUSHI, -6000, "Sale", "Food & Drink"),
        (16, "C", STAR, -850, "Sale", "Food & Drink"),
        (18, "C", "AMAZON.COM*AB12CD", -20000, "Sale", "Shopping"),
        (20, "A", "Platinum Shopping Credit", 1500, "Return", "Payments"),
        (22, "A", "SHELL OIL 57444", -4500, "Sale", "Automotive"),
        (25, "C", "PURCHASE INTEREST CHARGE", -500, "Adjustment", "Other"),
        (26, "C", "AUTOMATIC PAYMENT - THANK", 60000, "Payment", "Payments"),
    ],
    "2026-09": [
        (1, "C", WHOLEFDS, -9000, "Sale", "Groceries"),
        (2, "A", JOE, -4000, "Sale", "Groceries"),
        (5, "C", "COSTCO WHSE #0123", -3500, "Sale", "Groceries"),
        (6, "C", BOTTLE, -700, "Sale", "Food & Drink"),
        (11, "A", SUSHI, -5000, "Sale", "Food & Drink"),
        (13, "C", STAR, -900, "Sale", "Food & Drink"),
        (14, "C", STAR, -400, "Sale", "Food & Drink"),
        (15, "C", "AMZN Mktp US*7Y6TR", -15000, "Sale", "Shopping"),
        (18, "C", "TARGET 00012345", -6000, "Sale", "Shopping"),
        (21, "C", "TARGET 00012345", 6000, "Return", "Shopping"),
        (22, "A", "SHELL OIL 57444", -5500, "Sale", "Automotive"),
        (26, "A", "CHEVRON 0012", -3000, "Sale", "Automotive"),
        (27, "C", "AUTOMATIC PAYMENT - THANK", 70000, "Payment", "Payments"),
        (30, "A", "AUTOPAY PAYMENT - THANK YOU", 40000, "Payment", "Payments"),
    ],
    "2026-10": [
        (2, "C", STAR, -1000, "Sale", "Food & Drink"),
        (3, "A", SUSHI, -3500, "Sale", "Food & Drink"),
    ],
}


def rows():
    return [
        (
            date.fromisoformat(f"{month}-{day:02d}"),
            "Chase" if issuer == "C" else "Amex",
            description,
            Decimal(cents) / 100,
            kind,
            category,
            GROUPS[category],
        )
        for month, items in MONTHS.items()
        for day, issuer, description, cents, kind, category in items
    ]


def frame(spark):
    from outlay.sources.tables import analysis_frame

    return analysis_frame(spark.createDataFrame(rows(), SCHEMA))
