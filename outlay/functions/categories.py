"""Raw issuer category to standard category and budget group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import col

# First matching row wins. (category, name prefixes, exact names)
CATEGORY_RULES = (
    ("Groceries", (), ("Groceries", "Merchandise & Supplies-Groceries", "Merchandise & Supplies-Wholesale Stores")),
    ("Food & Drink", ("Restaurant",), ("Food & Drink",)),
    ("Automotive", ("Transportation",), ("Automotive", "Gas")),
    ("Travel", ("Travel",), ()),
    (
        "Bills & Utilities",
        (),
        ("Bills & Utilities", "Communications-Mobile Telecom", "Business Services-Internet Services"),
    ),
    ("Health & Wellness", (), ("Health & Wellness", "Merchandise & Supplies-Pharmacies", "Personal")),
    ("Shopping", ("Merchandise & Supplies",), ("Shopping", "Home")),
    ("Entertainment", ("Entertainment",), ("Entertainment",)),
    ("Professional & Business Services", ("Business Services",), ("Professional Services", "Education")),
    ("Gifts & Donations", (), ("Gifts & Donations", "Other-Charities")),
    ("Payments", (), ("Payment", "Fees & Adjustments-Fees & Adjustments")),
)
CATEGORY_DEFAULT = "Other"

# Budget groups, first matching row wins.
GROUP_RULES = (
    (
        "Needs",
        ("Transportation",),
        (
            "Groceries",
            "Merchandise & Supplies-Groceries",
            "Merchandise & Supplies-Wholesale Stores",
            "Bills & Utilities",
            "Communications-Mobile Telecom",
            "Business Services-Internet Services",
            "Automotive",
            "Gas",
            "Health & Wellness",
            "Merchandise & Supplies-Pharmacies",
        ),
    ),
    (
        "Wants",
        ("Entertainment", "Merchandise & Supplies", "Restaurant", "Travel"),
        ("Shopping", "Home", "Food & Drink", "Personal", "Gifts & Donations", "Other-Charities"),
    ),
)
GROUP_DEFAULT = "Payments & Others"

# The types that count as spending, and the groups that can be cut.
ANALYZED_TYPES = ("Sale", "Return", "Adjustment")
DISCRETIONARY_GROUPS = ("wants", "discretionary", "wants/discretionary")

CATEGORY_NAMES = tuple(name for name, _, _ in CATEGORY_RULES) + (CATEGORY_DEFAULT,)


def _first_match(raw: Column, rules, default: str) -> Column:
    out = None
    for name, prefixes, names in rules:
        test = F.lit(False)
        if names:
            test = raw.isin(*names)
        for prefix in prefixes:
            test = test | raw.startswith(prefix)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(default))


def standard_category(raw: Column | str = "raw_category") -> Column:
    return _first_match(col(raw), CATEGORY_RULES, CATEGORY_DEFAULT)


def budget_group(raw: Column | str = "raw_category") -> Column:
    return _first_match(col(raw), GROUP_RULES, GROUP_DEFAULT)


def is_analyzed(kind: Column | str = "transaction_type") -> Column:
    """Only sales, returns and adjustments count as spending; card payments do not."""
    return col(kind).isin(*ANALYZED_TYPES)


def is_discretionary(group: Column | str = "parent_group") -> Column:
    return F.lower(F.trim(col(group))).isin(*DISCRETIONARY_GROUPS)
