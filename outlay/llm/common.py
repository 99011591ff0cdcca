"""What the operators share: reading a table, cutting lineage, walking over texts in bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from outlay.session import scratch_dir

#: Characters of text that a Python worker handles at once; one longer text is a batch of its own.
BATCH_CHARS = 4_000_000
#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
BLANKS = BLANK + "+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: cuts lineage and outlives a lost executor.

    Shuffle files of the finished write are removed at once, not when the driver collects its garbage.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of bounded length from batches whose first two columns are an id and a text; null text is empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        keys, column = batch.column(0).to_pylist(), batch.column(1)
        for i, key in enumerate(keys):
            text = column[i].as_py() or ""
            if texts and size + len(text) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts
