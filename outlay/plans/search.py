"""Fact retrieval: keyword (BM25), vector (cosine), both fused by rank, and passages of a document.

Keyword search reads a stored index (``search_index``) where it is given one, and the texts themselves otherwise.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.functions.chunks import passage_rows
from outlay.functions.html import html_text
from outlay.functions.similarity import all_finite, norm
from outlay.functions.text import STOP_WORDS
from outlay.plans import search_index
from outlay.plans.search_index import fact_tokens
from outlay.session import scratch_dir

FACT_COLUMNS = ("id", "fact_key", "fact_text", "weight", "updated_at")
K1, B = 1.5, 0.75
RANK_K = 60
MAX_QUERY_CHARS = 2000


def query_terms(text: str) -> list[str]:
    """Distinct search tokens of a query, sorted; the same rule as ``search_tokens``."""
    found = re.findall(r"[^\W_]+", text.lower())
    return sorted({t for t in found if len(t) > 1 and t not in STOP_WORDS})


def _tokenized(facts: DataFrame, terms: list[str]) -> DataFrame:
    """Facts with their length in tokens and the tokens that are query terms (with repeats)."""
    tokens = facts.withColumn("_tokens", fact_tokens(facts))
    return tokens.select(
        *facts.columns,
        F.size("_tokens").alias("_length"),
        F.filter("_tokens", lambda t: t.isin(*terms)).alias("_hits"),
    )


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: number of documents, their total length, and per query term how many hold it.

    Each document contributes one length row and one row per distinct hit, so a single pass with map-side sums gives
    all three; at most one row per query term reaches the final step.
    """
    length = F.struct(F.lit("").alias("term"), F.col("_length").cast("long").alias("length"))
    hits = F.transform(
        F.array_distinct("_hits"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("length"))
    )
    rows = docs.select(F.inline(F.concat(F.array(length), hits)))
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    own = F.col("term") == ""
    return terms.agg(
        F.max(F.when(own, F.col("n"))).alias("documents"),
        F.max(F.when(own, F.col("length"))).alias("total_length"),
        F.map_from_entries(F.collect_list(F.when(~own, F.struct("term", "n")))).alias("frequency"),
    )


def _scanned(facts: DataFrame, terms: list[str], k1: float, b: float) -> DataFrame:
    """(id, bm25_score, matched_terms) from the texts. One pass writes what the question needs of each fact, without its text."""
    spark, path = facts.sparkSession, scratch_dir(facts.sparkSession, "question")
    narrow = _tokenized(facts, terms).select("id", "_length", "_hits")
    narrow.write.parquet(path)
    docs = spark.read.schema(narrow.schema).parquet(path)
    corpus = corpus_statistics(docs)
    found = docs.where(F.size("_hits") > 0).withColumn("_c", corpus.select(F.struct("*").alias("c")).scalar())
    found = found.withColumns(
        {
            "_n": F.col("_c.documents"),
            "_df": F.col("_c.frequency"),
            "_norm": k1 * (1 - b + b * F.col("_length") / (F.col("_c.total_length") / F.col("_c.documents"))),
            "matched_terms": F.array_sort(F.array_distinct("_hits")),
        }
    )

    def part(term: Column) -> Column:
        tf = F.size(F.filter("_hits", lambda t: t == term)).cast("double")
        df = F.try_element_at("_df", term).cast("double")
        idf = F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        return idf * (tf * (k1 + 1) / (tf + F.col("_norm")))

    score = F.aggregate(F.transform("matched_terms", part), F.lit(0.0), lambda acc, x: acc + x)
    return found.select("id", score.alias("bm25_score"), "matched_terms")


def bm25(facts: DataFrame, query: str, limit: int = 20, k1: float = K1, b: float = B, index: str | None = None) -> DataFrame:
    """Best facts by BM25 over key and text, ties by weight, then recency. ``index`` is the folder of a stored index of the facts."""
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative and b must be between 0 and 1")
    terms = query_terms(query)
    columns = [c for c in FACT_COLUMNS if c in facts.columns]
    if not terms or limit <= 0:
        return facts.select(*columns, F.lit(None).cast("double").alias("bm25_score"), F.array().cast("array<string>").alias("matched_terms")).where("false")
    found = search_index.scores(facts.sparkSession, index, terms, k1, b) if index else _scanned(facts, terms, k1, b)
    # The scores at the limit and their ties come first, then the facts of these rows alone.
    best = Window.orderBy(F.desc("bm25_score"))
    top = found.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= limit).drop("_r")
    return (
        facts.select(*columns)
        .join(top, "id")
        .orderBy(F.desc("bm25_score"), F.desc("weight"), F.desc("updated_at"), "id")
        .limit(limit)
    )


def checked_vector(vector) -> list[float]:
    """A query vector with finite values and a norm above 0."""
    values = [float(v) for v in vector]
    if not values or not all(math.isfinite(v) for v in values):
        raise ValueError("a query vector needs finite values")
    if not any(values):
        raise ValueError("a query vector must not be zero")
    return values


def vector_similarity(query: list[float], embedding: str) -> Column:
    """Cosine of a fixed query with an array column; null for another length, bad values, or a zero norm."""
    stored = F.col(embedding).cast("array<double>")
    asked = F.array(*[F.lit(v) for v in query])
    length = math.sqrt(sum(v * v for v in query))
    dot = F.aggregate(F.zip_with(asked, stored, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    fits = (F.size(stored) == len(query)) & all_finite(stored)
    return F.when(fits & (norm(stored) > 0), dot / (norm(stored) * length))


def vector_search(facts: DataFrame, vector, model: str, limit: int = 5) -> DataFrame:
    """Best facts of one embedding model by cosine, ties by weight."""
    if not (model or "").strip():
        raise ValueError("an embedding model is required")
    rows = facts.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == model))
    rows = rows.withColumn("similarity", vector_similarity(checked_vector(vector), "embedding"))
    return (
        rows.where(F.col("similarity").isNotNull())
        .select(*[c for c in FACT_COLUMNS if c in facts.columns], "similarity")
        .orderBy(F.desc("similarity"), F.desc("weight"), "id")
        .limit(max(0, limit))
    )


def ranked(results: DataFrame, score: str, name: str) -> DataFrame:
    """Place of each result in its list; lists hold at most 50 rows."""
    order = Window.orderBy(F.desc(score), F.desc("weight"), F.desc("updated_at"), "id")
    return results.withColumn(name, F.row_number().over(order))


def fuse(vectors: DataFrame, keywords: DataFrame, limit: int = 5, k: int = RANK_K) -> DataFrame:
    """Merge two short result lists by reciprocal rank, ties by weight, then recency."""
    left = ranked(vectors, "similarity", "vector_rank").select("id", "similarity", "vector_rank", *_tail(vectors, "v_"))
    right = ranked(keywords, "bm25_score", "keyword_rank").select(
        "id", "bm25_score", "matched_terms", "keyword_rank", *_tail(keywords, "k_")
    )
    both = left.join(right, "id", "full_outer")
    score = F.coalesce(1 / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(
        1 / (k + F.col("keyword_rank")), F.lit(0.0)
    )
    shared = [F.coalesce(f"v_{c}", f"k_{c}").alias(c) for c in FACT_COLUMNS if c != "id"]
    sources = F.array_compact(
        F.array(
            F.when(F.col("vector_rank").isNotNull(), F.lit("vector")),
            F.when(F.col("keyword_rank").isNotNull(), F.lit("bm25")),
        )
    )
    return (
        both.select(
            "id", *shared, "similarity", "bm25_score", "matched_terms",
            score.alias("retrieval_score"), sources.alias("retrieval_sources"),
        )
        .orderBy(F.desc("retrieval_score"), F.desc("weight"), F.desc("updated_at"), "id")
        .limit(max(0, limit))
    )


def _tail(df: DataFrame, prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in FACT_COLUMNS if c != "id"]


def hybrid_search(facts: DataFrame, query: str, vector, model: str, limit: int = 5, index: str | None = None) -> DataFrame:
    """Keyword and vector candidates fused. Without a vector the keyword list alone is ranked; ``index`` as in ``bm25``."""
    if not query or len(query) > MAX_QUERY_CHARS:
        raise ValueError("a query must have between 1 and 2000 characters")
    limit = min(10, max(1, limit))
    candidates = min(50, max(20, 4 * limit))
    words = bm25(facts, query, candidates, index=index)
    if vector is None:
        none = words.select(*FACT_COLUMNS, F.lit(None).cast("double").alias("similarity")).where("false")
        return fuse(none, words, limit)
    return fuse(vector_search(facts, vector, model, candidates), words, limit)


# ----- passages -----

DATA_TITLE = "SELECTED-PERIOD FINANCIAL DATA (authoritative):\n"
SUMMARY_TITLE = "\n\nGENERATED FINANCE SUMMARY:\n"


def report_passages(reports: DataFrame, data: str, html: str) -> DataFrame:
    """Passages of each report: its data as text, then the visible text of its summary."""
    text = F.concat(F.lit(DATA_TITLE), F.col(data), F.lit(SUMMARY_TITLE), html_text(html, separator="\n"))
    others = [c for c in reports.columns if c not in (data, html)]
    return passage_rows(reports.select(*others, text.alias("_text")), "_text")


def passage_search(passages: DataFrame, vector, limit: int = 5) -> DataFrame:
    """Passages closest to a question vector. ``passages`` carries its vectors in ``embedding``.

    A vector that cannot be compared ranks last, as a similarity of -1.
    """
    score = F.coalesce(vector_similarity(checked_vector(vector), "embedding"), F.lit(-1.0))
    keys = [c for c in passages.columns if c not in ("passage", "embedding")]
    return (
        passages.withColumn("similarity", score)
        .drop("embedding")
        .orderBy(F.desc("similarity"), *keys)
        .limit(max(1, limit))
    )
