"""A stored inverted index of facts, added to in batches and read by query term.

A folder holds five small or bucketed tables. ``postings`` has one row for each fact and distinct term, in buckets by a hash of the term, sorted
by term: a question opens the buckets of its terms only, and inside them the row groups that can hold them. ``documents`` has the
length of every fact's version, ``settings`` the number of buckets, ``replaced`` the versions that a later batch took the place of, and ``commits`` one row a
batch with the change in the number of facts and in their total length. A commit is written last: a batch that did not
finish leaves files that no reader takes into account, and can be written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.functions.text import search_tokens

BUCKETS = 256
#: Tokens of a batch for each task that sorts and writes postings.
TASK_TOKENS = 1_000_000
_SCHEMAS = {
    "settings": "buckets int",
    "documents": "id long, length long, batch string",
    "replaced": "id long, batch string, by string",
    "commits": "batch string, documents long, total_length long",
}


def fact_tokens(facts: DataFrame) -> Column:
    """Search tokens of key and text of a fact."""
    return search_tokens(F.concat_ws(" ", F.coalesce("fact_key", F.lit("")), F.coalesce("fact_text", F.lit(""))))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """An empty index in a new folder. A bucket should grow to some 100 MB: thousands of them for billions of facts."""
    for name, schema in _SCHEMAS.items():
        spark.createDataFrame([(buckets,)] if name == "settings" else [], schema).coalesce(1).write.parquet(f"{path}/{name}")


def _buckets(spark: SparkSession, path: str) -> int:
    return _read(spark, path, "settings").first().buckets


def commits(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "commits")


def _dead(spark: SparkSession, path: str) -> DataFrame:
    """(id, batch) of versions that a finished batch replaced."""
    return _read(spark, path, "replaced").join(commits(spark, path).select(F.col("batch").alias("by")), "by", "left_semi").select("id", "batch")


def _live(rows: DataFrame, path: str) -> DataFrame:
    """Rows (id, batch, ...) of finished batches that no later one replaced."""
    spark = rows.sparkSession
    done = rows.join(commits(spark, path).select("batch"), "batch", "left_semi")
    return done.join(_dead(spark, path), ["id", "batch"], "left_anti")


def _counted(tokens: DataFrame, mine: DataFrame) -> DataFrame:
    """(term, id, length, tf) of facts (id, length, t) with sorted tokens; ``mine`` has id and length of the same facts.

    Terms are counted where a run of equal tokens ends, inside their text, so a task holds one fact's terms at a time. Facts
    that are alike in id and length are one, which needs a grouping of these alone.
    """
    last = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: ~F.get("t", i).eqNullSafe(F.get("t", i + 1)))
    ends = tokens.select("id", "length", "t", F.when(F.size("t") > 0, last).alias("ends"))
    count = lambda e, k: F.struct(F.get("t", e).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(-1))).cast("long").alias("tf"))
    counts = ends.select("id", "length", F.transform("ends", count).alias("counts"))

    def terms(rows: DataFrame) -> DataFrame:
        # A row of the explosion carries no text. The plain explosion would have the planner test the array's size below, where it is made again for each token.
        return rows.select("id", "length", F.explode_outer("counts").alias("c")).where("c IS NOT NULL").select("c.term", "id", "length", "c.tf")

    alike = mine.groupBy("id", "length").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("length").alias("_length"))
    if alike.isEmpty():
        return terms(counts)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("length") == F.col("_length"))
    summed = terms(counts.join(alike, same, "left_semi")).groupBy("term", "id", "length").agg(F.sum("tf").alias("tf"))
    return terms(counts.join(alike, same, "left_anti")).unionByName(summed)


def _dealt(rows: DataFrame, tasks: int, buckets: int) -> DataFrame:
    """Rows dealt to about so many tasks by their bucket, or by bucket and fact where there are more tasks than buckets.

    The number of tasks follows the tokens, so what one task sorts does not grow with the batch.
    """
    slices = -(-tasks // buckets)
    place = F.col("bucket") * slices + F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    count = tasks if slices == 1 else buckets * slices
    return rows.repartitionById(count, F.pmod(place, F.lit(count)))


def append(facts: DataFrame, path: str) -> str:
    """Add facts (id, fact_key, fact_text), ids unique among them, and take the place of those that have their ids. Returns the batch's name."""
    spark, batch = facts.sparkSession, uuid.uuid4().hex
    named, buckets = F.lit(batch).alias("batch"), _buckets(spark, path)
    tokens = facts.select("id", fact_tokens(facts).alias("t"))
    length = F.size("t").cast("long").alias("length")
    tokens.select("id", length, named).write.mode("append").parquet(f"{path}/documents")
    mine = _read(spark, path, "documents").where(F.col("batch") == batch)
    rows = _counted(tokens.select("id", length, F.sort_array("t").alias("t")), mine)
    rows = rows.select("term", "id", "tf", "length", bucket_of(F.col("term"), buckets).alias("bucket"))
    total = mine.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    rows = _dealt(rows, max(1, -(-total // TASK_TOKENS)), buckets).sortWithinPartitions("bucket", "term")
    # The batch's name is added after the sort, which need not hold it.
    rows.select("term", "id", "tf", "length", named, "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    old = _live(_read(spark, path, "documents"), path).join(mine.select("id"), "id", "left_semi")
    old.select("id", "batch", F.lit(batch).alias("by")).write.mode("append").parquet(f"{path}/replaced")
    change = mine.select(F.lit(1).alias("n"), "length").unionByName(old.select(F.lit(-1).alias("n"), (-F.col("length")).alias("length")))
    sums = change.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_length"))
    sums.select(named, "documents", "total_length").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return batch


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(term, id, tf, length) of the facts that hold any of the terms; only the buckets of these terms are opened."""
    of_terms = F.explode(F.array(*[bucket_of(F.lit(t), _buckets(spark, path)) for t in terms]))
    buckets = [r.b for r in spark.range(1).select(of_terms.alias("b")).distinct().collect()]
    schema = "term string, id long, tf long, length long, batch string, bucket int"
    rows = spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    return _live(rows, path).select("term", "id", "tf", "length")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: facts in the index and their total length."""
    return commits(spark, path).agg(F.sum("documents").alias("documents"), F.sum("total_length").alias("total_length"))


def scores(spark: SparkSession, path: str, terms: list[str], k1: float, b: float) -> DataFrame:
    """(id, bm25_score, matched_terms) of the facts that hold any of the terms. Parts are added in the order of the terms."""
    rows = postings(spark, path, terms)
    counts = rows.groupBy("term").agg(F.count("*").alias("df"))
    # At most one entry for each term of the question.
    frequency = counts.agg(F.map_from_entries(F.collect_list(F.struct("term", "df")))).scalar()
    rows = rows.withColumns({"_df": F.try_element_at(frequency, F.col("term")).cast("double"), "_c": totals(spark, path).select(F.struct("*")).scalar()})
    n, tf, df = F.col("_c.documents"), F.col("tf").cast("double"), F.col("_df")
    size = k1 * (1 - b + b * F.col("length") / (F.col("_c.total_length") / n))
    part = F.ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1) / (tf + size))
    found = rows.select("id", F.struct("term", part.alias("part")).alias("p")).groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    score = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["part"])
    return found.select("id", score.alias("bm25_score"), F.transform("p", lambda x: x["term"]).alias("matched_terms"))
