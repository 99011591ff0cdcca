"""Column functions: every one is built from Spark expressions unless its docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    """A Column from a Column or a column name."""
    return F.col(value) if isinstance(value, str) else value


def lit_or_col(value) -> Column:
    """A Column from a Column or any literal (dates and strings included)."""
    return value if isinstance(value, Column) else F.lit(value)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)
