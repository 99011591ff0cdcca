"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then a hash of all.

Texts are equal when they are identical after each run of the six ASCII blanks became one blank. Lengths are counted
first; first characters are hashed only where a length occurs twice; the whole text is hashed only where length and
first characters occur twice. Counts are summed before they are shuffled, so a text that a third of all rows share is
one row of each table of groups. Those tables hold no texts; the planner broadcasts them while they are small. Beyond
that size the rows meet them by a sort-merge join on (length, head), which the adaptive planner splits where it is skewed.

Two texts count as equal when all three agree, so two unequal ones would have to share a SHA-256. The row that stays is
the one of the least id; null ids come last, and of rows that share an id the first one read stays. Null and empty texts are
one group; a text of blanks alone is a group of its own (one blank). Empty tables give empty results; other columns may
have any name and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import BLANKS, stored, table

#: Characters of the normalised text that the second step hashes.
HEAD = 256
# A single blank stays as it is, so only other runs need to be rewritten.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """``text`` with one blank in place of each run of blanks; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), _RUNS, " ")


def refined(docs: DataFrame, columns: list[str], text: str = "text", head: int = HEAD) -> DataFrame:
    """``row`` (a struct of ``columns``), ``norm``, and ``full``: SHA-256 of texts that share length and head, else null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), normalised(text).alias("norm"))
    sized = rows.withColumn("length", F.octet_length("norm"))
    twice = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    lengths = stored(twice(sized, "length"), "lengths")
    headed = lambda df: df.withColumn("head", F.xxhash64(F.substring("norm", 1, head)))
    heads = stored(twice(headed(sized.join(lengths, "length", "left_semi")), "length", "head"), "heads")
    met = headed(sized).join(heads.withColumn("shared", F.lit(True)), ["length", "head"], "left")
    return met.select("row", "norm", F.when(F.col("shared"), F.sha2("norm", 256)).alias("full"))


def judged(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with ``row`` and ``full``, each with keep_id, group_size and kept."""
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "refined")
    own = F.col("row")[key]
    first = F.min(F.struct(own.isNull().alias("none"), own.alias("id"), F.col("at").alias("at")))
    # Written before the join, so that the planner knows its size and can split the rows of a hot group.
    groups = stored(rows.where("full IS NOT NULL").groupBy("full").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    # Rows without a hash are alone; they take no part in the join, so no null key gathers them.
    alone = rows.where("full IS NULL").select(*rows.columns, own.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    met = rows.where("full IS NOT NULL").join(groups, "full", "left").select(
        *rows.columns, F.when(F.col("n").isNull(), own).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("n").isNull() | (F.col("first.at") == F.col("at"))).alias("kept"),
    )
    return alone.unionByName(met).drop("at")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return judged(refined(docs, docs.columns, text).drop("norm"), key).where("kept").select("row.*")


def op12(spark, sf_dir: str) -> DataFrame:
    rows = refined(table(spark, sf_dir, "documents"), ["doc_id"])
    # The digest names every text; the operator itself hashes whole texts of surviving groups only.
    rows = rows.select("row", "full", F.coalesce("full", F.sha2("norm", 256)).alias("text_sha256"))
    return judged(rows).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{BLANKS}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""
