"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule bounds a ratio of two measures of a text. A text is kept if it passes the base test and every rule. Null and
empty texts have no words: all measures are 0, the base test fails and they are not kept. Rules whose divisor is 0 pass.
Repeated rows are judged one by one; other columns of the input are passed on untouched, whatever their names.

Equal 8-word windows are found by 64-bit hashes of the words, so no window text is built; one text's windows
collide with odds below 1e-10. Everything happens within a row: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import BLANK, BLANKS, table

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "with", "as", "be", "by", "this",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "des", "sich", "dem", "ein", "eine", "für", "auf",
    "le", "la", "les", "et", "un", "une", "est", "que", "pour", "qui", "dans", "sur", "pas", "du",
    "el", "los", "las", "de", "en", "y", "no", "con", "por", "su", "una", "para", "lo",
)
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * top / bottom <= high``; an absent bound does not bind."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        top, bottom = F.col(self.top) * 1000, F.col(self.bottom)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (top >= bottom * self.low)
        if self.high is not None:
            ok = ok & (top <= bottom * self.high)
        return ok | (bottom == 0)


RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("capitals", "n_capital_runs", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 40, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
    "n_capital_runs", "n_ellipsis_lines", "n_bullet_lines",
)
_OWN = "_quality_"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns packed as ``row`` beside the measures of each text; packing keeps clashing names apart."""
    own = lambda name: F.col(_OWN + name)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(_OWN + "text"))
    df = df.withColumns({
        _OWN + "words": F.array_remove(F.split(own("text"), BLANKS), ""),
        _OWN + "lines": F.filter(F.split(own("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumns({
        "n_words": F.size(own("words")).cast("long"),
        "n_lines": F.size(own("lines")).cast("long"),
        _OWN + "hashes": F.transform(own("words"), lambda w: F.xxhash64(w)),
    })
    h = own("hashes")
    df = df.withColumn(
        _OWN + "windows",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
        ),
    )
    w = own("windows")
    # Texts without an equal pair, nearly all, skip the sort.
    df = df.withColumn(
        _OWN + "sorted",
        F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    s = own("sorted")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn(_OWN + "starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = own("starts")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return df.select(
        "row", "n_words", "n_lines",
        (F.length(own("text")) - _count(own("text"), BLANK)).cast("long").alias("word_chars"),
        _count(own("text"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.col("n_lines") - F.size(F.array_distinct(own("lines")))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(own("words"), lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _count(own("text"), "[A-Z]{2,}").alias("n_capital_runs"),
        F.size(F.filter(own("lines"), lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(own("lines"), lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• "))).cast("long").alias("n_bullet_lines"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``row``, the measures, ``base_failed``, ``kept`` and ``failed_rules``, the comma-joined names of broken rules."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    broken = [F.when(~r.passes(), F.lit(r.name)) for r in rules] or [F.lit(None).cast("string")]
    return measured(docs, text).select(
        "row", *MEASURES, base.alias("base_failed"),
        F.array_join(F.array_compact(F.array(*broken)), ",").alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that are kept, with their own columns."""
    return judged(docs, rules).where("kept").select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules",
    )


def _sql() -> str:
    blank = r"[\x20\x09-\x0D]"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = []
    for r in RULES:
        tests = [f"{r.top} * 1000 < {r.bottom} * {r.low}"] * (r.low is not None) + [f"{r.top} * 1000 > {r.bottom} * {r.high}"] * (r.high is not None)
        broken.append(f"CASE WHEN {r.bottom} <> 0 AND ({' OR '.join(tests)}) THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' '))) AS g,
  unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM a WHERE len(words) >= {WINDOW}),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM
  (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n FROM r) GROUP BY 1),
m AS (SELECT doc_id, len(words) AS n_words, len(lines) AS n_lines,
  length(regexp_replace(text, '{blank}+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(words, lambda x: x IN ({stops}))) AS n_stop_words, len(regexp_extract_all(text, '[A-Z]{{2,}}')) AS n_capital_runs,
  len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
  len(list_filter(lines, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• '))) AS n_bullet_lines
  FROM a LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  concat_ws(',', {', '.join(broken)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""


OP1_SQL = _sql()
