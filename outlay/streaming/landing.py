"""Incremental landing of card exports: every file once, personal columns dropped, read files archived."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from outlay.sources.cards import EXPORT_OPTIONS, Layout, csv_options, without_personal


def land_new_exports(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    layout: Layout,
    personal: Iterable[str] = (),
    archive: str | None = None,
):
    """Start the stream over the files at hand. Its checkpoint remembers what was read, so a file lands once.

    With ``archive`` a file is moved there by the run after the one that read it. Each batch has its own folder, so
    a repeated batch overwrites itself.
    """
    reader = spark.readStream.schema(layout.schema()).options(**csv_options(layout))
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.csv(source)
    dropped = tuple(personal)

    def save(batch: DataFrame, number: int) -> None:
        landed = without_personal(batch, dropped)
        landed.write.mode("overwrite").options(**EXPORT_OPTIONS).csv(f"{target}/batch={number}")

    return (
        rows.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
