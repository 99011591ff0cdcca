"""Raw card exports: layouts, CSV scan, landing without personal columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """One issuer's export: header names in file order, and whether cells may contain line breaks."""

    issuer: str
    columns: tuple[str, ...]
    multiline: bool = False

    def schema(self, dropped: Iterable[str] = ()) -> T.StructType:
        gone = set(dropped)
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns if c not in gone])


# Header names of the two export formats.
CHASE = Layout("Chase", ("Transaction Date", "Post Date", "Description", "Category", "Type", "Amount", "Memo"))
AMEX = Layout(
    "Amex",
    (
        "Date", "Description", "Card Member", "Account #", "Amount", "Extended Details",
        "Appears On Your Statement As", "Address", "City/State", "Zip Code", "Country", "Reference", "Category",
    ),
    multiline=True,
)
LAYOUTS = {layout.issuer: layout for layout in (CHASE, AMEX)}


#: How exports are written: texts of many rows shrink to a tenth, and readers tell by the file name.
EXPORT_OPTIONS = {"header": "true", "escape": '"', "compression": "gzip"}


def column_name(header: str) -> str:
    """A header as a column name: every other character becomes an underscore."""
    return "".join(c if c.isalnum() else "_" for c in header)


def csv_options(layout: Layout) -> dict[str, str]:
    """Reader options shared by the batch and the stream reader; a header that differs from the layout fails."""
    return {
        "header": "true",
        "enforceSchema": "false",
        "multiLine": str(layout.multiline).lower(),
        "quote": '"',
        "escape": '"',
    }


def as_raw(df: DataFrame) -> DataFrame:
    """Underscored names plus ``file_source``, the file each row came from."""
    named = [F.col(f"`{c}`").alias(column_name(c)) for c in df.columns]
    return df.select(*named, F.col("_metadata.file_path").alias("file_source"))


def read_exports(spark: SparkSession, path: str, layout: Layout, dropped: Iterable[str] = ()) -> DataFrame:
    """Every export of one issuer under ``path``; ``dropped`` names the columns landing removed."""
    reader = spark.read.schema(layout.schema(dropped)).options(**csv_options(layout))
    return as_raw(reader.option("recursiveFileLookup", "true").csv(path))


def without_personal(df: DataFrame, personal: Iterable[str]) -> DataFrame:
    """The table without the personal columns it has; names it lacks are ignored."""
    return df.drop(*[c for c in personal if c in df.columns])


def write_export(df: DataFrame, path: str) -> None:
    """Write a landed export as compressed CSV that ``read_exports`` reads back unchanged."""
    df.write.mode("append").options(**EXPORT_OPTIONS).csv(path)


def land_exports(spark: SparkSession, source: str, target: str, layout: Layout, personal: Iterable[str]) -> None:
    """Copy an issuer's exports to the landing folder without the personal columns."""
    raw = spark.read.schema(layout.schema()).options(**csv_options(layout)).csv(source)
    write_export(without_personal(raw, personal), target)


def read_all_issuers(spark: SparkSession, config: Mapping[str, Mapping]) -> DataFrame:
    """All configured issuers in one table; ``config`` maps an issuer to its path and personal columns."""
    if not config:
        raise ValueError("no issuers configured")
    out = None
    for issuer, entry in config.items():
        one = read_exports(spark, entry["path"], LAYOUTS[issuer], entry.get("personal", ()))
        one = one.withColumn("issuer", F.lit(issuer))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
