"""Order-dependent work inside groups that may be huge.

A plain window sends one group to one task. These helpers cut a group into ordered buckets, solve each bucket on
its own, and carry only one summary row per bucket across bucket borders, so a group holding a third of all rows
still spreads over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.session import scratch_dir, write_scratch

COPY_BLOCK = 100_000
#: Overlapping files are solved in up to so many slices (a power of two), of about so many rows or more.
COPY_SLICES, SLICE_ROWS = 16, 1_000_000


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Join condition that treats two nulls as equal."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, buckets: int = 64
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys before this one.

    Rows go by hash bucket of the ``order`` columns, then by those columns, which must tell rows of a key apart.
    Any fixed order serves the callers, and a hash spreads every group evenly.
    """
    work = df.withColumn("_value", value).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = work.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    )
    pairs = [(k, f"_k{i}") for i, k in enumerate(keys)] + [("_bucket", "_b")]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        work.join(offsets, null_safe(work, offsets, pairs))
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_bucket", "_b", "_offset", *[f"_k{i}" for i in range(len(keys))])
    )


def neighbours(df: DataFrame, keys: list[str], bucket: str, order: list[str], payload: list[str]) -> DataFrame:
    """Add ``prev`` and ``next``: structs of ``payload`` from the rows just before and after within the keys.

    ``bucket`` must never fall as ``order`` rises within a key (a file block, an hour); it bounds one task's share.
    """
    row, key = F.struct(*payload), F.struct(*order)
    edges = df.groupBy(*keys, bucket).agg(F.min_by(row, key).alias("_first"), F.max_by(row, key).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(bucket)
    # The neighbours beyond a bucket's borders join it as two extra rows, so one sort solves inside and border alike.
    beyond = F.array(
        F.struct(F.lit(0).alias("_side"), F.lag("_last").over(across).alias("_row")),
        F.struct(F.lit(2).alias("_side"), F.lead("_first").over(across).alias("_row")),
    )
    extra = edges.select(*keys, bucket, beyond.alias("_b")).select(*keys, bucket, F.inline("_b"))
    rows = df.withColumn("_side", F.lit(1)).withColumn("_row", row)
    both = rows.unionByName(extra.where(F.col("_row").isNotNull()), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, bucket).orderBy("_side", *order)
    near = both.withColumn("prev", F.lag("_row").over(inside)).withColumn("next", F.lead("_row").over(inside))
    return near.where(F.col("_side") == 1).drop("_side", "_row")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the place of a row, from 1, among the rows of its keys in ``order``.

    ``bucket`` must never fall as ``order`` rises within a key; only sizes of buckets are added up across it.
    """
    work = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = work.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    placed = work.withColumn("_place", F.row_number().over(inside))
    named = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in [*keys, "_bucket"]], "_offset")
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*keys, "_bucket"]]
    joined = placed.join(named, same)
    return joined.withColumn(out, F.col("_offset") + F.col("_place")).select(*df.columns, out)


def repeat_rows(df: DataFrame, times: str, block: int = COPY_BLOCK) -> DataFrame:
    """Each row ``times`` times. Copies are cut into blocks that are spread before expanding, so no task writes out
    one row's copies alone. Meant for tables that hold counts instead of copies, which are small."""
    columns = [c for c in df.columns if c != times]
    n = F.col(times).cast("long")
    pieces = F.sequence(F.lit(0).cast("long"), F.call_function("div", n - 1, F.lit(block)))
    spread = df.where(n > 0).select(*df.columns, F.explode(pieces).alias("_piece"))
    spread = spread.withColumn("_size", F.least(F.lit(block).cast("long"), n - F.col("_piece") * block))
    spread = spread.repartition(*columns, "_piece")
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size")))).select(*columns)


def keep_largest_copies(rows: DataFrame, file: str, keys: list[str]) -> DataFrame:
    """Multiset-max union of overlapping files.

    Number the repeats of a key inside each file; for every (key, repeat number) keep the row of the last file by
    name. So a key survives as often as it occurs in the file that has it most often.

    The files are read once and written to the shared folder, dealt into slices by a hash of the keys. A slice holds
    all rows of its keys, so slices are solved one after another, and the shuffle files of one are removed before the
    next: the disk holds the rows, the survivors and the shuffles of one slice. Small inputs are one slice.
    """
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, "copies")
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(COPY_SLICES)).cast("int"))
    write_scratch(dealt, path, "_slice")
    dealt = spark.read.schema(dealt.schema).parquet(path)
    steps = min(COPY_SLICES, 1 << (dealt.count() // SLICE_ROWS).bit_length())
    path = scratch_dir(spark, "kept")
    for step in range(steps):
        part = dealt.where(F.col("_slice").isin(list(range(step, COPY_SLICES, steps)))) if steps > 1 else dealt
        kept = _largest_copies(part.drop("_slice"), file, keys)
        write_scratch(kept, path)
    left = spark.read.schema(kept.schema).parquet(path)
    return left.where("_times = 1").drop("_times").unionByName(repeat_rows(left.where("_times > 1"), "_times"))


def _largest_copies(rows: DataFrame, file: str, keys: list[str]) -> DataFrame:
    """The rows of ``keep_largest_copies`` with a count ``_times`` in place of copies.

    Identical rows of a file become one row with a count, map-side before the first shuffle. A file's rows of a key
    are all kept unless a later file has the key too, so rows meet a table that holds just the overlapping keys: small
    overlaps are broadcast by the adaptive planner after it has measured them, large ones become a sort-merge join
    whose hot keys it splits. Only rows of which a file keeps some copies are numbered.
    """
    columns, names = rows.columns, [file, *keys]
    collapsed = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))
    counts = collapsed.groupBy(*names).agg(F.sum("_times").alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc(file)).rowsBetween(Window.unboundedPreceding, -1)
    covered = counts.withColumn("_covered", F.max("_n").over(later)).where("_covered > 0")
    covered = covered.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], "_n", "_covered")
    same = null_safe(collapsed, covered, [(c, f"_c{i}") for i, c in enumerate(names)])
    untouched = collapsed.join(covered, same, "left_anti")

    some = collapsed.join(covered.where("_covered < _n"), same).select(*columns, "_covered", "_times")
    others = [c for c in columns if c not in names]
    placed = running_total(some, names, others, F.col("_times"), "_before") if others else some.withColumn("_before", F.lit(0))
    kept = placed.withColumn("_times", F.least(F.col("_times"), F.col("_before") + F.col("_times") - F.col("_covered"))).where("_times > 0")
    return untouched.unionByName(kept.select(*columns, "_times"))
