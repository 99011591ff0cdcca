"""Fact search, passages, HTML text, chat history, number claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.functions import chunks, html, payloads, similarity, text
from outlay.operators import claims, history
from outlay.plans import search, search_index
from outlay.queries.base import query, with_
from outlay.session import scratch_dir

# ----- bindings -----

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
MODEL = "embed-1"


def facts(s):
    """Documents as facts; documents with an embedding carry it, labels above 4 stand for another model."""
    d = s.table("documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("fact_key"),
        F.col("text").alias("fact_text"),
        F.lit(1.0).alias("weight"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("updated_at"),
    )
    e = s.table("embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.when(F.col("label") > 4, F.lit("embed-0")).otherwise(F.lit(MODEL)).alias("embedding_model"),
    )
    return d.join(e, "id", "left")


def question(s) -> str:
    """The text of the first benchmark item: one short row, the query of the searches below."""
    return s.table("benchmark").where("item_id = 0").first().text


def question_vector(s):
    return s.table("embeddings").where("vec_id = 0").first().embedding


_TOKENS = f"""q AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t
    FROM benchmark WHERE item_id = 0) WHERE length(t) > 1 AND t NOT IN ({_STOP})),
  tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(source || ' ' || text), '[\\p{{L}}\\p{{N}}]+'),
    lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS tokens FROM documents),
  len AS (SELECT doc_id, len(tokens) AS n FROM tok),
  tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS t FROM tok) SEMI JOIN q USING (t) GROUP BY ALL),
  df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
  c AS (SELECT count(*) AS n, sum(n) AS total FROM len)"""
# Parts are added in term order, so equal texts tie in both engines.
_BM25 = f"""{_TOKENS}, scored AS (SELECT tf.doc_id, list_reduce(list(ln(1 + (c.n - df.df + 0.5) / (df.df + 0.5)) *
    (tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * len.n / (c.total / c.n)))) ORDER BY tf.t), lambda x, y: x + y) AS score,
    string_agg(tf.t, ' ' ORDER BY tf.t) AS terms FROM tf JOIN df USING (t) JOIN len USING (doc_id), c GROUP BY 1)"""


@query(
    "f23_search_tokens",
    f"WITH {_TOKENS} SELECT doc_id, n AS tokens FROM len",
)
def tokens(s):
    key = F.concat_ws(" ", "source", "text")
    return s.table("documents").select("doc_id", F.size(text.search_tokens(key)).alias("tokens"))


@query(
    "a27_corpus_statistics",
    f"WITH {_TOKENS} SELECT c.n AS documents, CAST(c.total AS BIGINT) AS total_length, df.t AS term, df.df AS n FROM df, c",
)
def corpus(s):
    docs = search._tokenized(facts(s), search.query_terms(question(s)))
    row = search.corpus_statistics(docs)
    return row.select("documents", "total_length", F.explode("frequency").alias("term", "n"))


@query(
    "x8_bm25",
    f"""WITH {_BM25} SELECT doc_id AS id, round(score, 6) AS bm25_score, terms AS matched_terms FROM scored
  ORDER BY score DESC, doc_id DESC LIMIT 20""",
)
def bm25(s):
    found = search.bm25(facts(s), question(s), 20)
    return found.select(
        "id", F.round("bm25_score", 6).alias("bm25_score"), F.array_join("matched_terms", " ").alias("matched_terms")
    )


def stored_index(s) -> str:
    """The facts in a stored index, in three batches: half of them with another text first, the rest, then the first half as it is."""
    folder, rows = scratch_dir(s.spark, "index"), facts(s).select("id", "fact_key", "fact_text")
    search_index.create(s.spark, folder, 16)
    search_index.append(rows.where("id % 2 = 0").withColumn("fact_text", F.reverse("fact_text")), folder)
    search_index.append(rows.where("id % 2 = 1"), folder)
    search_index.append(rows.where("id % 2 = 0"), folder)
    return folder


@query(
    "a27_x8_bm25_stored_index",
    f"""WITH {_BM25} SELECT doc_id AS id, round(score, 6) AS bm25_score, terms AS matched_terms FROM scored
  ORDER BY score DESC, doc_id DESC LIMIT 20""",
)
def bm25_indexed(s):
    found = search.bm25(facts(s), question(s), 20, index=stored_index(s))
    return found.select(
        "id", F.round("bm25_score", 6).alias("bm25_score"), F.array_join("matched_terms", " ").alias("matched_terms")
    )


_COSINE = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  q0 AS (SELECT e FROM v WHERE vec_id = 0),
  cos AS (SELECT v.vec_id, v.label, list_dot_product(v.e, q0.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q0.e, q0.e))) AS s
    FROM v, q0)"""


@query("f24_cosine", f"WITH {_COSINE} SELECT vec_id, round(s, 9) AS similarity FROM cos")
def cosine(s):
    v = s.table("embeddings")
    one = v.where("vec_id = 0").select("embedding").scalar()
    rows = v.withColumn("question", one)
    return rows.select("vec_id", F.round(similarity.cosine("embedding", "question"), 9).alias("similarity"))


@query(
    "x9_vector_search",
    f"WITH {_COSINE} SELECT vec_id AS id, round(s, 9) AS similarity FROM cos JOIN documents ON doc_id = vec_id "
    "WHERE label <= 4 ORDER BY s DESC, vec_id LIMIT 15",
)
def vectors(s):
    found = search.vector_search(facts(s), question_vector(s), MODEL, 15)
    return found.select("id", F.round("similarity", 9).alias("similarity"))


@query(
    "x10_j8_w17_hybrid_search",
    f"""WITH {_BM25}, {_COSINE},
  k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS r FROM scored QUALIFY r <= 40),
  e AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM cos JOIN documents ON doc_id = vec_id
    WHERE label <= 4 QUALIFY r <= 40)
  SELECT COALESCE(k.id, e.id) AS id, round(COALESCE(1 / (60 + e.r), 0) + COALESCE(1 / (60 + k.r), 0), 9) AS retrieval_score,
  concat_ws('+', CASE WHEN e.id IS NOT NULL THEN 'vector' END, CASE WHEN k.id IS NOT NULL THEN 'bm25' END) AS sources
  FROM k FULL JOIN e ON k.id = e.id ORDER BY COALESCE(1 / (60 + e.r), 0) + COALESCE(1 / (60 + k.r), 0) DESC, 1 DESC LIMIT 10""",
)
def hybrid(s):
    found = search.hybrid_search(facts(s), question(s), question_vector(s), MODEL, 10)
    return found.select(
        "id",
        F.round("retrieval_score", 9).alias("retrieval_score"),
        F.array_join("retrieval_sources", "+").alias("sources"),
    )


@query(
    "x10_stored_index",
    f"""WITH {_BM25} SELECT doc_id AS id, round(1 / (60 + row_number() OVER (ORDER BY score DESC, doc_id DESC)), 9) AS retrieval_score
  FROM scored ORDER BY score DESC, doc_id DESC LIMIT 10""",
)
def hybrid_indexed(s):
    found = search.hybrid_search(facts(s), question(s), None, MODEL, 10, index=stored_index(s))
    return found.select("id", F.round("retrieval_score", 9).alias("retrieval_score"))


@query(
    "x10_keyword_fallback",
    f"""WITH {_BM25} SELECT doc_id AS id, round(1 / (60 + row_number() OVER (ORDER BY score DESC, doc_id DESC)), 9) AS retrieval_score
  FROM scored ORDER BY score DESC, doc_id DESC LIMIT 5""",
)
def fallback(s):
    found = search.hybrid_search(facts(s), question(s), None, MODEL, 5)
    return found.select("id", F.round("retrieval_score", 9).alias("retrieval_score"))


# ----- passages and markup -----

# Cut points follow from the one before, so the check walks every text with a recursive query.
_CHUNKS = """WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM documents),
  n AS (SELECT doc_id, t, length(t) AS total FROM t WHERE t <> ''),
  w AS (SELECT doc_id, 0 AS no, 0 AS a, CASE WHEN total <= 900 THEN total ELSE
      CASE WHEN strpos(reverse(t[451:900]), ' ') > 0 THEN 900 - strpos(reverse(t[451:900]), ' ') ELSE 900 END END AS b FROM n
    UNION ALL
    SELECT doc_id, no + 1, a2, CASE WHEN total <= a2 + 900 THEN total ELSE
      CASE WHEN strpos(reverse(t[a2 + 451:a2 + 900]), ' ') > 0 THEN a2 + 900 - strpos(reverse(t[a2 + 451:a2 + 900]), ' ') ELSE a2 + 900 END END
    FROM (SELECT w.doc_id, w.no, n.t, n.total, greatest(w.a + 1, w.b - 120) AS a2 FROM w JOIN n USING (doc_id) WHERE w.b < n.total))
  SELECT doc_id, CAST(no AS BIGINT) AS passage_no, trim(t[a + 1:b]) AS passage FROM w JOIN n USING (doc_id)"""


@query("f27_x11_passages", _CHUNKS)
def passages(s):
    return chunks.passage_rows(s.table("documents").select("doc_id", "text"), "text")


@query(
    "x11_passage_search",
    _CHUNKS.replace("SELECT doc_id, CAST(no AS BIGINT) AS passage_no", ", p AS (SELECT doc_id, CAST(no AS BIGINT) AS passage_no", 1)
    + f"""), {_COSINE} SELECT vec_id, doc_id, passage_no, passage, round(s, 9) AS similarity FROM p
  JOIN cos ON vec_id = (doc_id * 31 + passage_no) % (SELECT count(*) FROM embeddings) ORDER BY s DESC, vec_id, doc_id, passage_no LIMIT 10""",
)
def passage_search(s):
    """Passages take the vectors of the embeddings table in turn."""
    rows = chunks.passage_rows(s.table("documents").select("doc_id", "text"), "text")
    vectors = s.table("embeddings")
    count = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = rows.withColumn("vec_id", F.pmod(F.col("doc_id") * 31 + F.col("passage_no"), count))
    joined = rows.join(vectors.select("vec_id", "embedding"), "vec_id")
    found = search.passage_search(joined, question_vector(s), 10)
    return found.withColumn("similarity", F.round("similarity", 9))


@query("f25_html_text")
def html_text(s):
    """Visible text of every page, once as lines and once joined by blanks."""
    pages = s.table("pages")
    return pages.select(
        "page_id",
        html.html_text("html", skip=("style",), block_lines=True).alias("lines"),
        html.html_text("html", skip=html.HISTORY_SKIP_TAGS, separator=" ").alias("words"),
    )


@query("f36_history_text")
def history_text(s):
    pages = s.table("pages")
    stored = F.when(F.col("page_id") % 3 == 0, F.col("html")).when(F.col("page_id") % 3 == 1, F.lit("plain  text"))
    return pages.select("page_id", html.history_text(stored, "html").alias("text"))


_SAFE = """regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<\\s*script\\b[^>]*>.*?<\\s*/\\s*script\\s*>|<\\s*iframe\\b[^>]*>.*?<\\s*/\\s*iframe\\s*>|<\\s*object\\b[^>]*>.*?<\\s*/\\s*object\\s*>|<\\s*embed\\b[^>]*>.*?<\\s*/\\s*embed\\s*>|<\\s*form\\b[^>]*>.*?<\\s*/\\s*form\\s*>|<\\s*input\\b[^>]*>.*?<\\s*/\\s*input\\s*>|<\\s*link\\b[^>]*>.*?<\\s*/\\s*link\\s*>|<\\s*meta\\b[^>]*>.*?<\\s*/\\s*meta\\s*>', '', 'g'),
  '(?i)<\\s*(script|iframe|object|embed|form|input|link|meta)\\b[^>]*?/?>', '', 'g'),
  '(?i)\\s+on[a-z]+\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>]+)', '', 'g')"""


@query(
    "f26_unsafe_markup",
    f"""WITH c AS (SELECT page_id, html, regexp_replace({_SAFE},
    '(?i)\\s+(?:href|src)\\s*=\\s*(?:''\\s*javascript:[^''"]*''|"\\s*javascript:[^''"]*")', '', 'g') AS cleaned FROM pages)
  SELECT page_id, length(cleaned) AS cleaned_length, md5(cleaned) AS cleaned_hash, CASE WHEN strlen(html) > 3000 THEN 'size' WHEN
  regexp_matches(cleaned, '(?i)<(script|iframe|object|embed|form|input|link|meta)[\\s/>]') THEN 'html'
  WHEN NOT contains(cleaned, 'Previous report for reference:') THEN 'history' END AS problem FROM c""",
)
def unsafe(s):
    cleaned = text.strip_unsafe("html")
    return s.table("pages").select(
        "page_id",
        F.length(cleaned).alias("cleaned_length"),
        F.md5(cleaned).alias("cleaned_hash"),
        text.markup_problem("html", require_label=True, max_bytes=3000).alias("problem"),
    )


@query(
    "f31_facts_in_text",
    """SELECT o_orderkey, 'order_' || o_orderkey AS fact_key, o_orderpriority AS fact_text,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2.5 ELSE 1 END AS DOUBLE) AS weight FROM orders""",
)
def payload(s):
    """Facts written as JSON inside prose, one per order; the check states what was written."""
    orders = s.table("orders")
    body = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit("order_"), F.col("o_orderkey")).alias("fact_key"),
                F.col("o_orderpriority").alias("fact_text"),
                F.when(F.col("o_orderkey") % 2 == 0, F.lit("2.5")).alias("weight"),
            ),
            F.struct(F.lit("").alias("fact_key"), F.lit("no key").alias("fact_text"), F.lit("1").alias("weight")),
        )
    )
    noisy = F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```\nDone {."))
    return payloads.facts_in_text(orders.select("o_orderkey", noisy.alias("reply")), "reply")


@query(
    "f31_first_object",
    """SELECT o_orderkey, '{"a":{"b":' || o_custkey || '},"c":"} {' || o_orderstatus || '"}' AS found FROM orders""",
)
def first_object(s):
    """The first JSON object of a reply, after braces that open none; the check states what was written."""
    inner = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("b")).alias("a"), F.concat(F.lit("} {"), F.col("o_orderstatus")).alias("c")))
    reply = F.concat(F.lit("As {asked}: {\n```json\n"), inner, F.lit("\n``` and {\"x\": 1}"))
    return s.table("orders").select("o_orderkey", payloads.json_object(reply).alias("found"))


# ----- history -----


def turns(s):
    return s.table("conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), "role", "text"
    )


@query(
    "w10_newest_turns",
    "SELECT conv_id AS thread_id, turn AS id, role FROM conversations "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
)
def newest(s):
    return history.newest_turns(turns(s), 3).select("thread_id", "id", "role")


@query("o14_recent_turns", "SELECT turn AS id, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn DESC LIMIT 12")
def recent(s):
    return history.recent_turns(turns(s), 1).select("id", "role", "text")


_CLIP = "trim(regexp_replace(text, '[\\s\\x{0b}\\x{85}\\x{a0}\\x{2028}\\x{2029}]+', ' ', 'g'))"


@query(
    "w11_rolling_summary",
    f"""WITH c AS (SELECT conv_id, turn, {_CLIP} AS t FROM conversations),
  l AS (SELECT conv_id, turn, '- Q: ' || CASE WHEN length(t) <= 100 THEN t ELSE rtrim(t[1:99]) || '…' END || ' | answer: ' ||
    CASE WHEN length(t) <= 120 THEN t ELSE rtrim(t[1:119]) || '…' END AS line FROM c),
  u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM l)
  SELECT conv_id AS thread_id, CAST(count(*) FILTER (used > 500) AS BIGINT) AS omitted,
  COALESCE(string_agg(line, chr(10) ORDER BY turn) FILTER (used <= 500), '') AS kept FROM u GROUP BY 1""",
)
def summary(s):
    lines = s.table("conversations").select(
        F.col("conv_id").alias("thread_id"),
        "turn",
        history.turn_line(F.col("text"), F.lit(None).cast("string"), F.col("text")).alias("line"),
    )
    out = history.rolling_summary(lines, 500)
    return out.select("thread_id", "omitted", F.array_join("kept", "\n").alias("kept"))


@query(
    "j14_f22_new_threads",
    """SELECT sha256(role || ':' || CAST(conv_id AS VARCHAR)) AS internal_id, role AS channel,
  sha256(CAST(conv_id AS VARCHAR)) AS external_key_hashed, min(turn) AS created_at FROM conversations
  WHERE NOT (role = 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')) GROUP BY ALL""",
)
def threads(s):
    """Threads exist already for the user side of conversations that have a system turn."""
    from outlay.functions.identity import thread_key

    c = s.table("conversations")
    key = F.col("conv_id").cast("string")
    asked = c.select(F.col("role").alias("channel"), key.alias("external_key"), F.col("turn").alias("created_at"))
    stored = c.where("role = 'system'").select(thread_key(F.lit("user"), key).alias("internal_id")).distinct()
    return history.new_threads(asked, stored)


def _labelled(s):
    """Facts keyed by document, with updates for the documents that have a label."""
    base = s.table("documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("fact_key"),
        F.col("lang").alias("fact_text"), F.lit(None).cast("long").alias("source_short_term_id"),
        (F.col("doc_id") % 7).cast("double").alias("weight"), F.lit("2001-01-01").alias("updated_at"),
    )
    e = s.table("embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.when(F.col("label") > 4, F.lit("embed-0")).otherwise(F.lit(MODEL)).alias("embedding_model"),
    )
    stored = base.join(e, "id", "left")
    updates = s.table("labels").select(
        F.concat(F.lit("doc-"), F.col("doc_id") * 2).alias("fact_key"), F.lit("labelled").alias("fact_text"),
        F.col("doc_id").alias("source_short_term_id"), (F.col("quality") + 10).cast("double").alias("weight"),
        F.lit("2001-02-01").alias("updated_at"), F.lit(None).cast("array<double>").alias("embedding"),
        F.lit(None).cast("string").alias("embedding_model"),
    )
    return stored, updates


_STORED = """d AS (SELECT doc_id AS id, 'doc-' || doc_id AS fact_key, lang AS fact_text, doc_id % 7 AS weight, '2001-01-01' AS updated_at,
    CASE WHEN vec_id IS NOT NULL THEN CASE WHEN label > 4 THEN 'embed-0' ELSE 'embed-1' END END AS model, vec_id
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
  u AS (SELECT 'doc-' || (doc_id * 2) AS fact_key, doc_id AS source, quality + 10 AS weight FROM labels)"""


@query(
    "u4_fact_upsert",
    f"""WITH {_STORED} SELECT d.id, COALESCE(u.fact_key, d.fact_key) AS fact_key,
  CASE WHEN u.fact_key IS NULL THEN d.fact_text ELSE 'labelled' END AS fact_text, u.source AS source_short_term_id,
  CAST(COALESCE(u.weight, d.weight) AS DOUBLE) AS weight,
  CASE WHEN u.fact_key IS NULL THEN d.updated_at ELSE '2001-02-01' END AS updated_at,
  u.fact_key IS NULL AND vec_id IS NOT NULL AS has_embedding,
  CASE WHEN u.fact_key IS NULL THEN d.model END AS embedding_model FROM d FULL JOIN u ON u.fact_key = d.fact_key""",
)
def upsert(s):
    merged = history.upsert_facts(*_labelled(s))
    return merged.withColumn("has_embedding", F.col("embedding").isNotNull()).drop("embedding")


@query("o13_top_facts", f"WITH {_STORED} SELECT id, fact_key, CAST(weight AS DOUBLE) AS weight FROM d "
       "ORDER BY weight DESC, updated_at DESC, fact_key, id LIMIT 20")  # fmt: skip
def top(s):
    return history.top_facts(_labelled(s)[0]).select("id", "fact_key", "weight")


@query("p18_needing_embedding", f"WITH {_STORED} SELECT id, fact_key FROM d WHERE model IS DISTINCT FROM 'embed-1' "
       "ORDER BY updated_at DESC, fact_key, id LIMIT 1000")  # fmt: skip
def needing(s):
    return history.needing_embedding(_labelled(s)[0], MODEL).select("id", "fact_key")


@query(
    "u6_embedding_backfill",
    f"""WITH {_STORED}, n AS (SELECT 'doc-' || doc_id AS fact_key, vec_id AS new_id FROM labels JOIN embeddings ON vec_id = doc_id % 100)
  SELECT d.id, d.fact_key, d.updated_at, CASE WHEN n.new_id IS NOT NULL THEN 'embed-2' ELSE d.model END AS embedding_model,
  COALESCE(n.new_id, d.vec_id) IS NOT NULL AS has_embedding FROM d LEFT JOIN n ON n.fact_key = d.fact_key""",
)
def backfill(s):
    stored, _ = _labelled(s)
    new = s.table("labels").withColumn("vec_id", F.col("doc_id") % 100).join(s.table("embeddings"), "vec_id")
    new = new.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("fact_key"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.lit("embed-2").alias("embedding_model"),
    )
    out = history.set_embeddings(stored, new)
    return out.select(
        "id", "fact_key", "updated_at", "embedding_model", F.col("embedding").isNotNull().alias("has_embedding")
    )


# ----- number claims -----

# One row per number in the sentence: exact total, thousands, percent, whole total, customer number.
_CLAIMS = with_("narratives", "known") + """, c AS (SELECT o_orderkey AS report_id, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS position,
    unnest([CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE), CAST(CAST(o_totalprice / 1000 AS DECIMAL(18,1)) AS DOUBLE) * 1000,
      CAST(CAST(o_totalprice AS DECIMAL(18,0)) AS DOUBLE), CAST(o_custkey AS DOUBLE), CAST(CAST(o_totalprice / 5000 AS DECIMAL(18,1)) AS DOUBLE)]) AS value,
    unnest([0.01, 50.0, 0.5, 0.5, 0.05]) AS tolerance FROM orders)"""


@query("j11_written_claims", _CLAIMS + " SELECT report_id, position, value, CAST(tolerance AS DOUBLE) AS tolerance FROM c")
def written(s):
    return claims.written_claims(s.narratives).select("report_id", "position", "value", "tolerance")


@query(
    "j11_unmatched_claims",
    _CLAIMS + """ SELECT report_id, position, value FROM c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.report_id = c.report_id
  AND abs(abs(k.number) - c.value) <= c.tolerance + 1e-9)""",
)
def unmatched(s):
    written_numbers = claims.written_claims(s.narratives)
    return claims.unmatched_claims(written_numbers, s.known_numbers).select("report_id", "position", "value")
