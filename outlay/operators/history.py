"""Chat threads, their recent turns, and durable facts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.identity import hashed_key, thread_key
from outlay.functions.text import clip

MAX_TURNS = 12
SUMMARY_CHARS = 1200
NO_ANSWER = "(no answer)"


def new_threads(requests: DataFrame, threads: DataFrame) -> DataFrame:
    """Rows to append for (channel, external_key, created_at) requests whose thread is not stored yet.

    Only hashes of the external key are kept; several requests of one thread give one row, the earliest.
    """
    keyed = requests.select(
        thread_key("channel", "external_key").alias("internal_id"),
        "channel",
        hashed_key("external_key").alias("external_key_hashed"),
        "created_at",
    )
    first = keyed.groupBy("internal_id", "channel", "external_key_hashed").agg(F.min("created_at").alias("created_at"))
    return first.join(threads.select("internal_id"), "internal_id", "left_anti")


def newest_turns(turns: DataFrame, keep: int = MAX_TURNS, thread: str = "thread_id", extra: str = "id") -> DataFrame:
    """The newest ``keep`` turns of every thread. The rank limit is applied before the shuffle, so a long thread
    sends at most ``keep`` rows per task."""
    order = Window.partitionBy(thread).orderBy(F.desc("created_at"), F.desc(extra))
    return turns.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= keep).drop("_place")


def recent_turns(turns: DataFrame, thread_id, limit: int = MAX_TURNS) -> DataFrame:
    """Newest turns of one thread, their JSON columns decoded."""
    rows = turns.where(F.col("thread_id") == thread_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    decoded = {}
    if "tags" in turns.columns:
        decoded["tags"] = F.from_json("tags", "array<string>")
    if "meta" in turns.columns:
        decoded["meta"] = F.from_json("meta", "map<string,string>")
    return rows.withColumns(decoded) if decoded else rows


def turn_line(question, caption, answer):
    """One summary line of a finished turn."""
    shown = F.when(caption.isNotNull(), F.concat(F.lit(" | computed: "), clip(caption, 120))).otherwise(F.lit(""))
    reply = F.coalesce(F.nullif(answer, F.lit("")), F.lit(NO_ANSWER))
    return F.concat(F.lit("- Q: "), clip(question, 100), shown, F.lit(" | answer: "), clip(reply, 120))


def rolling_summary(lines: DataFrame, max_chars: int = SUMMARY_CHARS) -> DataFrame:
    """(thread_id, kept, omitted): per thread the newest lines that fit, each counting its length plus one.

    Every line costs at least one character, so only the newest ``max_chars`` lines of a thread can fit, whatever
    their length; the rank limit drops the rest before the shuffle and only counts see every row.
    """
    newest = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    near = lines.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= max_chars)
    used = F.sum(F.length("line") + 1).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    kept = (
        near.withColumn("_used", used)
        .where(F.col("_used") <= max_chars)
        .groupBy("thread_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("_lines"))
    )
    counts = lines.groupBy("thread_id").agg(F.count(F.lit(1)).alias("_all"))
    joined = counts.join(kept, "thread_id", "left")
    return joined.select(
        "thread_id",
        F.coalesce(F.transform("_lines", lambda x: x["line"]), F.array().cast("array<string>")).alias("kept"),
        (F.col("_all") - F.coalesce("_n", F.lit(0))).alias("omitted"),
    )


def summary_text(summary: DataFrame) -> DataFrame:
    """``rolling_summary`` as one text per thread, starting with how many turns were left out."""
    note = F.concat(F.lit("- ("), F.col("omitted").cast("string"), F.lit(" earlier turns omitted)"))
    lines = F.when(F.col("omitted") > 0, F.concat(F.array(note), F.col("kept"))).otherwise(F.col("kept"))
    return summary.select("thread_id", F.array_join(lines, "\n").alias("text"))


# ----- facts -----

FACT_FIELDS = ("fact_text", "source_short_term_id", "weight", "updated_at", "embedding", "embedding_model")


def upsert_facts(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """Facts after the updates: the newest row per key replaces the whole row, a kept key keeps its id.

    An update without an embedding clears the stored one. Aggregation, so many updates of one key meet map-side.
    """
    old = facts.select("id", "fact_key", *FACT_FIELDS, F.lit(0).alias("_new"))
    new = updates.select(F.lit(None).cast("long").alias("id"), "fact_key", *FACT_FIELDS, F.lit(1).alias("_new"))
    merged = old.unionByName(new).groupBy("fact_key").agg(
        F.max("id").alias("id"), F.max_by(F.struct(*FACT_FIELDS), F.struct("_new", "updated_at", "fact_text")).alias("f")
    )
    return merged.select("id", "fact_key", "f.*")


def top_facts(facts: DataFrame, limit: int = 20) -> DataFrame:
    """Heaviest, then newest facts, without their vectors."""
    columns = [c for c in facts.columns if c not in ("embedding", "embedding_model")]
    return facts.select(*columns).orderBy(F.desc("weight"), F.desc("updated_at"), "fact_key", "id").limit(limit)


def needing_embedding(facts: DataFrame, model: str, limit: int = 1000) -> DataFrame:
    """Newest facts without a vector of this model."""
    if not (model or "").strip():
        raise ValueError("an embedding model is required")
    missing = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(model)
    return facts.where(missing).orderBy(F.desc("updated_at"), "fact_key", "id").limit(max(0, limit))


def set_embeddings(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Replace vector and model where ``vectors`` (fact_key, embedding, embedding_model) has the key; nothing else.

    One vector per key; with several, one of them is taken.
    """
    new = vectors.dropDuplicates(["fact_key"]).select(
        "fact_key", F.col("embedding").alias("_e"), F.col("embedding_model").alias("_m"), F.lit(True).alias("_hit")
    )
    joined = facts.join(new, "fact_key", "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns(
        {
            "embedding": F.when(hit, F.col("_e")).otherwise(F.col("embedding")),
            "embedding_model": F.when(hit, F.col("_m")).otherwise(F.col("embedding_model")),
        }
    ).select(*facts.columns)
