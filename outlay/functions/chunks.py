"""Overlapping passages of a text, cut by built-in functions.

Each passage starts where the one before it ended, less the overlap, so starts are a fold over the text. The text is cut
into blocks of the passage size first: a passage lies in two neighbouring blocks, so that a step costs the same anywhere
in a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions import col

# Fixed values.
PASSAGE_CHARS = 900
PASSAGE_OVERLAP = 120


def passages(text: Column | str, size: int = PASSAGE_CHARS, overlap: int = PASSAGE_OVERLAP) -> Column:
    """Array of passages of the whole text, whitespace collapsed first; null and blank texts have none.

    A passage has ``size`` characters, or ends before the last blank of its second half if there is one.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))
    half = max(size // 2, 1)
    full = rf"(?s)^(?:.{{{half},{size - 1}}}(?= )|.{{{size}}})" if size > half else rf"(?s)^.{{{size}}}"
    steps = (F.length(flat) / F.lit(max(half - overlap, 1))).cast("int")

    def step(blocks: Column, total: Column, state: Column) -> Column:
        at = state["at"]
        block = F.floor(at / size).cast("int")
        window = F.substr(F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit(""))), at % size + 1, F.lit(size))
        last = total - at <= size
        passage = F.when(last, window).otherwise(F.regexp_extract(window, full, 0))
        after = F.when(last, total).otherwise(F.greatest(at + 1, at + F.length(passage) - overlap))
        return F.when(at >= total, state).otherwise(F.struct(after.alias("at"), F.array_append(state["out"], F.trim(passage)).alias("out")))

    # An array of one row stands for a name: text, blocks and length are worked out once, not at each step.
    blocks = F.regexp_extract_all(flat, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    named = F.array(F.struct(blocks.alias("blocks"), F.length(flat).alias("total"), F.sequence(F.lit(0), steps).alias("steps")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def fold(row: Column) -> Column:
        return F.aggregate(row["steps"], none, lambda s, _: step(row["blocks"], row["total"], s), lambda s: s["out"])

    return F.get(F.transform(named, fold), F.lit(0))


def passage_rows(df: DataFrame, text: str, size: int = PASSAGE_CHARS, overlap: int = PASSAGE_OVERLAP) -> DataFrame:
    """One row per passage: the other columns, ``passage_no`` from 0, ``passage``."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(passages(text, size, overlap)).alias("passage_no", "passage"))
