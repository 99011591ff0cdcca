"""JSON-lines scans and sinks that keep the order of a run's lines, also over several files.

The sink sorts a run's lines into numbered files. A line's place is the file's number, its split's offset in the file, and its
line number in that split: the first two form ``block``, so (block, line) orders a run however its splits were scheduled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.operators.ordered import numbered

LEDGER_FIELDS = {
    "timestamp": "string", "date": "string", "run_id": "string", "role": "string", "model": "string",
    "outcome": "string", "usage": "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,"
    "cache_creation_input_tokens:bigint>", "cost_usd": "double", "estimated": "boolean",
}
TRACE_FIELDS = {
    "event": "string", "timestamp": "double", "role": "string", "model": "string", "prompt_chars": "bigint",
    "validation_cycle": "bigint", "cycle": "bigint", "attempt": "bigint", "parse_status": "string",
    "response_chars": "bigint", "elapsed_seconds": "double", "done_reason": "string", "eval_count": "bigint",
    "prompt_eval_count": "bigint", "cost_usd": "double", "decision": "string", "stage": "string",
    "error_count": "bigint", "warning_count": "bigint", "error_count_delta": "bigint", "name": "string",
    "phase": "string", "error_type": "string", "exception_type": "string", "error": "string", "reason": "string",
    "repeated_error_count": "bigint", "rebuttal_count": "bigint", "limit_seconds": "double", "category": "string",
    "author_provider": "string", "author_model": "string", "validator_provider": "string",
    "validator_model": "string", "guidance": "string", "provider": "string", "summary": "string",
    "resolved_finding_count": "bigint", "resolved_findings": "array<string>", "responding_to_cycle": "bigint",
    "max_agent_rounds": "bigint", "usage": "struct<input_tokens:bigint,output_tokens:bigint,"
    "cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>",
    "findings": "array<struct<severity:string,category:string,message:string,evidence:string>>",
}
# Folders beside the runs that hold tool output.
NON_RUN_FOLDERS = ("comparisons", "replays")


#: A numbered file lies in a folder of its own: ``<run>/file=0000000012/part-...json``.
_FILE_FOLDER = r"/file=(\d+)/[^/]+$"
#: A numbered file of many runs, whose lines name their run: ``<root>/pack=0000000012/part-...json``.
_PACK_FOLDER = r"/pack=\d+/[^/]+$"
# Fixed value: the name that a folder of a run without a name gets.
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, value, file_size): non-blank lines with their order inside a run.

    ``block`` is (file, start): the number that the sink gave the file, 0 for others, and the offset of the split. Files of
    one folder without numbers follow each other by name. ``line`` is increasing inside one split.
    """
    raw = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    file = F.col("_metadata.file_path")
    number = F.regexp_extract(file, r"/(?:file|pack)=(\d+)/[^/]+$", 1)
    block = F.struct(
        F.when(number == "", 0).otherwise(number.cast("long")).alias("file"),
        F.element_at(F.split(file, "/"), -1).alias("name"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    return raw.select(file.alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("line"), "value", F.col("_metadata.file_size").alias("file_size"))


def _object(value: Column) -> Column:
    """The line as a JSON object, or null. Arrays and bare values are not objects."""
    return F.when(F.ltrim(value).startswith("{"), F.try_parse_json(value))


def _fields(parsed: str, fields: dict[str, str]) -> list[Column]:
    """Named fields of a parsed line; a field of another type is null, the rest of the line stays."""
    return [F.try_variant_get(F.col(parsed), f"$.{name}", kind).alias(name) for name, kind in fields.items()]


def run_folder(path: Column) -> Column:
    """The folder that names the run a file lies in: its own, or the one around the folder of a numbered file."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(F.regexp_replace(path, _FILE_FOLDER, "/file"), "/"), -2)), "^run_id=", "")


def read_trace(spark: SparkSession, path: str, fields: dict[str, str] = TRACE_FIELDS) -> DataFrame:
    """Trace events under a runs folder; lines that are not JSON objects are skipped."""
    rows = read_lines(spark, path).withColumn("_v", _object(F.col("value"))).where(F.col("_v").isNotNull())
    # Lines of a packed file name their run, other lines lie in its folder.
    said = F.when(F.col("path").rlike(_PACK_FOLDER), F.coalesce(F.try_variant_get("_v", "$.run_id", "string"), F.lit(_NO_NAME)))
    rows = rows.withColumn("run_id", F.coalesce(said, run_folder(F.col("path")))).where(~F.col("run_id").isin(*NON_RUN_FOLDERS))
    return rows.select("run_id", "block", "line", *_fields("_v", fields))


def read_ledger(spark: SparkSession, path: str, fields: dict[str, str] = LEDGER_FIELDS) -> DataFrame:
    """Ledger records. A complete line that is not JSON fails the read; an unfinished last line is ignored.

    Whether a file's last line is finished follows from sizes: with a closing line break, line lengths plus one
    each add up to the file's size. So no file is ever read whole.
    """
    rows = read_lines(spark, path).withColumn("_v", F.try_parse_json("value"))
    bad = (F.trim("value") != "") & F.col("_v").isNull()
    place = F.struct("block", "line")
    files = rows.groupBy("path").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max("file_size").alias("size"),
        F.count_if(bad).alias("bad"),
        F.max_by(bad, place).alias("last_is_bad"),
    )
    broken = files.where((F.col("bad") > 1) | ((F.col("bad") == 1) & ~(F.col("last_is_bad") & (F.col("bytes") > F.col("size")))))
    count = broken.agg(F.count(F.lit(1)).alias("n")).scalar()
    fail = F.raise_error(F.lit("a complete ledger line is not valid JSON; fix or move the file")).cast("boolean")
    good = rows.where(F.col("_v").isNotNull() & F.ltrim("value").startswith("{"))
    return good.where(F.when(count > 0, fail).otherwise(F.lit(True))).select("path", "block", "line", *_fields("_v", fields))


def read_documents(spark: SparkSession, root: str, name: str, fields: dict[str, str]) -> DataFrame:
    """One JSON document per run folder (run.json, metrics.json, progress.json); unreadable ones are left out."""
    raw = (
        spark.read.option("pathGlobFilter", name)
        .text(root, wholetext=True, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    rows = raw.withColumn("_v", _object(F.col("value"))).where(F.col("_v").isNotNull())
    rows = rows.withColumn("run_id", run_folder(F.col("path"))).where(~F.col("run_id").isin(*NON_RUN_FOLDERS))
    return rows.select("run_id", *_fields("_v", fields))


def list_documents(
    spark: SparkSession, folder: str, fields: dict[str, str], newest_by: str | None = None, limit: int | None = None
) -> DataFrame:
    """Side documents of one folder, newest first.

    With ``newest_by`` the order is that field, the file name where it is missing. Without, it is the file name, and
    ``limit`` counts files before unreadable ones are left out: names are listed first, without reading a file, and
    only the chosen files are opened. The limit bounds what is listed to the driver.
    """
    if newest_by is None and limit is not None:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
        chosen = [r.path for r in names.orderBy(F.desc(F.element_at(F.split("path", "/"), -1))).limit(limit).collect()]
        if not chosen:
            return spark.createDataFrame([], ", ".join(["file string", *[f"`{name}` {kind}" for name, kind in fields.items()]]))
        raw = spark.read.text(chosen, wholetext=True)
    else:
        raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    raw = raw.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    rows = raw.withColumn("_v", _object(F.col("value"))).where(F.col("_v").isNotNull())
    rows = rows.select("file", *_fields("_v", fields))
    if newest_by is None:
        return rows.orderBy(F.desc("file"))
    stem = F.regexp_replace("file", r"\.json$", "")
    order = F.coalesce(F.nullif(F.col(newest_by), F.lit("")), stem)
    out = rows.orderBy(F.desc(order), F.desc("file"))
    return out.limit(limit) if limit is not None else out


def run_name(run_id: Column) -> Column:
    """The name a run is read back under: its id, or the name of the folder of runs without one."""
    return F.coalesce(F.nullif(run_id.cast("string"), F.lit("")), F.lit(_NO_NAME))


def write_runs(df: DataFrame, path: str, order: list[str] | None = None, parts: int | None = None, packed: bool = False) -> None:
    """One folder per run, JSON lines inside; a large run takes several files.

    With ``packed``, files hold many runs and each line names its run, so the number of files follows the size of the data
    and not the number of runs; ``read_trace`` reads both. It needs ``order``, and a part's rows of one run lie in one file.

    With ``order``, rows are sorted by run and those columns over all tasks, and every task numbers its file, so
    the files of a run follow each other in order. With ``parts``, rows are cut into so many parts by the columns alone,
    as a log is cut by time, and a run has a file in each part it takes part in.
    """
    if order is None:
        df.hint("rebalance", "run_id").write.mode("append").partitionBy("run_id").json(path)
        return
    rows = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange("run_id", *order)
    if packed:
        rows = rows.withColumn("pack", F.lpad(F.spark_partition_id().cast("string"), 10, "0")).withColumn("run_id", run_name(F.col("run_id")))
        if parts:
            # A part is cut among tasks by its runs.
            rows = rows.repartition("pack", "run_id")
        rows.sortWithinPartitions("pack", "run_id", *order).write.partitionBy("pack").json(path)
        return
    rows = rows.sortWithinPartitions("run_id", *order)
    rows.withColumn("file", F.lpad(F.spark_partition_id().cast("string"), 10, "0")).write.partitionBy("run_id", "file").json(path)


def sequenced(rows: DataFrame, out: str = "seq") -> DataFrame:
    """Add ``out``: the place of a line in its run, from 1. Lines are counted inside blocks, and sizes of blocks are added up."""
    return numbered(rows, ["run_id"], F.col("block"), ["line"], out)


def empty_like(spark: SparkSession, fields: dict[str, str]) -> DataFrame:
    """An empty table with a run_id and the given fields, for documents that do not exist."""
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in {"run_id": "string", **fields}.items())
    return spark.createDataFrame([], T.StructType.fromDDL(kinds))
