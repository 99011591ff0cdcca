"""Text helpers: search tokens, clipping, excerpts, finding keys, unsafe markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import col
from outlay.functions.merchants import collapse

# Words left out of fact search.
STOP_WORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
    "was", "what", "when", "where", "which", "with", "would", "user",
)
TOKEN_PATTERN = r"[\p{L}\p{N}]{2,}"

# Elements that may not appear in a report, and the patterns that remove them.
UNSAFE_TAGS = "script|iframe|object|embed|form|input|link|meta"
UNSAFE_PAIR = rf"(?is)<\s*({UNSAFE_TAGS})\b[^>]*>.*?<\s*/\s*\1\s*>"
UNSAFE_SINGLE = rf"(?i)<\s*({UNSAFE_TAGS})\b[^>]*?/?>"
EVENT_ATTRIBUTE = r"""(?i)\s+on[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
SCRIPT_LINK = r"""(?i)\s+(?:href|src)\s*=\s*(['"])\s*javascript:[^'"]*\1"""
UNSAFE_LEFT = rf"(?i)<({UNSAFE_TAGS})[\s/>]"
HISTORY_LABEL = "Previous report for reference:"
MAX_REPORT_BYTES = 250_000
LOOKS_LIKE_HTML = r"(?i)<\s*(html|body|style|div|table)\b"


def search_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, longer than one character, stop words out; repeats are kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def clip(text: Column | str, limit: int) -> Column:
    """Collapsed text, cut to ``limit`` characters with an ellipsis."""
    t = collapse(F.coalesce(col(text).cast("string"), F.lit("")))
    cut = F.concat(F.rtrim(F.substring(t, 1, max(0, limit - 1))), F.lit("…"))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def head_tail(text: Column | str, limit: int) -> Column:
    """The first 60 % and the last part of a long text, blank lines dropped."""
    lines = F.transform(F.split(col(text), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    t = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    head = int(limit * 0.6)
    tail = limit - head - 7
    cut = F.concat(
        F.regexp_replace(F.substring(t, 1, head), r"(?U)\s+$", ""),
        F.lit("\n[...]\n"),
        F.regexp_replace(F.substring(t, -tail, tail), r"(?U)^\s+", ""),
    )
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def finding_key(message: Column | str) -> Column:
    """A finding message reduced to lower-case ASCII words, 80 characters; equal keys mean the same finding."""
    t = F.regexp_replace(F.lower(F.coalesce(col(message), F.lit(""))), "[^a-z0-9]+", " ")
    return F.substring(F.trim(t), 1, 80)


def finding_label(category: Column | str, message: Column | str) -> Column:
    """Short text for a finding: its category and up to 100 characters of the message."""
    t = collapse(F.coalesce(col(message), F.lit("")))
    short = F.when(F.length(t) > 100, F.concat(F.rtrim(F.substring(t, 1, 100)), F.lit("…"))).otherwise(t)
    named = F.coalesce(F.nullif(col(category), F.lit("")), F.lit("uncategorized"))
    return F.concat(named, F.lit(": "), short)


def strip_unsafe(html: Column | str) -> Column:
    """Markup without elements, handlers or links that could run code."""
    t = col(html)
    for pattern in (UNSAFE_PAIR, UNSAFE_SINGLE, EVENT_ATTRIBUTE, SCRIPT_LINK):
        t = F.regexp_replace(t, pattern, "")
    return t


def markup_problem(html: Column | str, require_label: bool = False, max_bytes: int = MAX_REPORT_BYTES) -> Column:
    """Why a report may not be sent (size, html, history), or null when it may."""
    raw = col(html)
    cleaned = strip_unsafe(raw)
    out = F.when(raw.isNull() | (raw == "") | (F.octet_length(raw) > max_bytes), F.lit("size")).when(
        cleaned.rlike(UNSAFE_LEFT), F.lit("html")
    )
    if require_label:
        out = out.when(~cleaned.contains(HISTORY_LABEL), F.lit("history"))
    return out


def mentions(text: Column | str, phrase: str) -> Column:
    """Whether a phrase occurs in a text as whole words. The cheap test first: most texts fail it."""
    return col(text).contains(phrase) & col(text).rlike(r"(?U)(?<!\w)\Q" + phrase + r"\E(?!\w)")
