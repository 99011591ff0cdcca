"""Corpus pipeline: five stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the pieces of each text. Later stages see the text as line removal left it;
``n_chars`` is brought up to date there. Empty tables, null texts and repeated rows behave as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import decontaminate, line_dedup, pieces, simhash, toxicity
from outlay.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier line."""
    out = line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at three bits or fewer."""
    return simhash.keep_one(docs, size=3, radius=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document left."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("sentencepiece", to_pieces),
]

#: No stage but the first filter's threshold can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
