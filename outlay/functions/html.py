"""Visible text of HTML pages by built-in functions.

A page is cut into comments, raw elements, tags and texts by one pattern. Each part becomes its text, or marks: where a
text node ends, where a hidden element starts and ends, and where a line ends. Only hidden elements nest, so only
their marks are walked in order; the rest is replacement.

The marks are control characters that HTML forbids; in a page they count for nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import col
from outlay.functions.merchants import collapse
from outlay.functions.text import LOOKS_LIKE_HTML

# Elements that end a line, and elements whose text is no report text.
BLOCK_TAGS = ("address", "article", "br", "div", "h1", "h2", "h3", "li", "p", "section", "tr")
HISTORY_SKIP_TAGS = ("style", "script", "head", "title")

_NODE, _HIDE, _SHOW, _LINE = "\x01", "\x02", "\x03", "\x04"
#: Elements whose content is text, whatever it looks like. What is not closed by the end of the page is dropped.
_RAW = r"<(?:script|style)(?=[\s>])[^>]*+(?<!/)>"
_PARTS = (
    r"(?is)<!--.*?(?:--!?>|\z)"
    rf"|{_RAW}.*?(?:</(?:script|style)[^>]*+>|\z)"
    r"""|<[a-z/!?](?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+){0,400}+>"""
    r"|<[a-z/!?][^>]*+(?:>|\z)"
    r"|[^<]++|<"
)
#: A last text that may end in an unfinished character reference is dropped, as the rest of a page may still come.
_PENDING = r"(?<=^|>)[^<>]*&[^\s;<>&]{0,33}\z"
_REFERENCES = r"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[a-zA-Z][a-zA-Z0-9]{1,31}+;?|[^&]++|&"


def _character(reference: Column) -> Column:
    """The character of a numeric reference."""
    digits = F.regexp_extract(reference, r"^&#0*([0-9]{1,7});?$", 1)
    hexes = F.regexp_extract(reference, r"^&#[xX]0*([0-9a-fA-F]{1,6});?$", 1)
    code = F.when(hexes != "", F.conv(hexes, 16, 10).try_cast("int")).otherwise(digits.try_cast("int"))
    moved = F.create_map(*[x for i in range(0x80, 0xA0) for x in (F.lit(i), F.lit(unescape(f"&#{i};")))])
    unknown = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    unprintable = code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F)
    nothing = unprintable | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(unknown, "�").when(code.between(0x80, 0x9F), moved[code]).when(nothing, "").otherwise(char)


def _unescaped(text: Column) -> Column:
    """Text with its character references replaced; names without a semicolon count if HTML allows them."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    short = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)

    def value(part: Column) -> Column:
        name = F.substr(part, F.lit(2))
        start = F.regexp_extract(part, f"^&({'|'.join(short)})", 1)
        cut = F.concat(F.try_element_at(names, start), F.substr(name, F.length(start) + 1))
        named = F.coalesce(F.try_element_at(names, name), cut, part)
        return F.when(part.startswith("&#") & (F.length(part) > 2), _character(part)).when(part.rlike("^&[a-zA-Z]"), named).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(_REFERENCES), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, value), "")).otherwise(text)


def _marked(part: Column, skip: tuple[str, ...], breaks: tuple[str, ...]) -> Column:
    """A text, or the marks of a tag."""
    name = F.lower(F.regexp_extract(part, r"^</?([a-zA-Z][^\s/>]*)", 1))
    closing, single = part.startswith("</"), part.endswith("/>")
    hides = name.isin(*skip) if skip else F.lit(False)
    start = F.when(hides & ~closing, _HIDE).otherwise("")
    stop = F.when(hides & (closing | single), _SHOW).otherwise("")
    ends = name.isin(*breaks) if breaks else F.lit(False)
    lines = F.when(ends & single & ~closing, _LINE * 2).when(ends, _LINE).otherwise("")
    content = F.regexp_extract(part, rf"(?is)^{_RAW}(.*)</(?:script|style)[^>]*>\z", 1)
    raw = F.when(hides, _NODE).otherwise(F.concat(F.lit(_NODE), content, F.lit(_NODE)))
    tag = F.concat(F.lit(_NODE), start, stop, lines)
    return (
        F.when(~part.startswith("<"), _unescaped(part))
        .when(part == "<", f"{_NODE}<{_NODE}")
        .when(part.rlike(f"(?i)^{_RAW}"), raw)
        .otherwise(tag)
    )


def _shown(marked: Column) -> Column:
    """What lies outside hidden elements; line ends count inside them too."""

    def step(state: Column, piece: Column) -> Column:
        depth = F.when(piece == _HIDE, state["depth"] + 1).when(piece == _SHOW, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        seen = F.when(piece.isin(_HIDE, _SHOW), "").when(state["depth"] == 0, piece).otherwise(F.regexp_replace(piece, f"[^{_LINE}]+", ""))
        return F.struct(depth.alias("depth"), F.concat(state["text"], seen).alias("text"))

    pieces = F.regexp_extract_all(marked, F.lit(f"[{_HIDE}{_SHOW}]|[^{_HIDE}{_SHOW}]+"), F.lit(0))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step, lambda s: s["text"])


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def html_text(
    html: Column | str, skip: Iterable[str] = (), block_lines: bool = False, separator: str | None = None
) -> Column:
    """Text nodes of a page; a null page has empty text. With a separator: each stripped, empty ones dropped, joined by it.

    Without one: kept verbatim, a newline at each edge of a block element, blank-line runs reduced to one.
    """
    page = F.regexp_replace(F.coalesce(col(html), F.lit("")), f"[{_NODE}-{_LINE}]", "")
    parts = F.regexp_extract_all(F.regexp_replace(page, _PENDING, ""), F.lit(_PARTS), F.lit(0))
    breaks = BLOCK_TAGS if block_lines else ()
    marked = F.array_join(F.transform(parts, lambda p: _marked(p, tuple(skip), breaks)), "")
    shown = _shown(marked) if skip else marked
    if separator is None:
        lines = F.translate(shown, _LINE + _NODE, "\n")
        return _stripped(F.regexp_replace(lines, r"(?U)\n\s*\n+", "\n\n"))
    nodes = F.split(F.regexp_replace(shown, _LINE, f"{_NODE}{_LINE}{_NODE}"), _NODE)
    texts = F.transform(nodes, lambda x: F.when(x == _LINE, "\n").otherwise(_stripped(x)))
    return F.array_join(F.filter(texts, lambda x: x != ""), separator)


def history_text(text: Column | str, html: Column | str) -> Column:
    """Stored text unless it is blank or looks like HTML; then the visible text of it or of the HTML."""
    stored = F.coalesce(col(text), F.lit(""))
    blank = F.trim(F.regexp_replace(stored, r"(?U)\s+", " ")) == ""
    is_markup = blank | stored.rlike(LOOKS_LIKE_HTML)
    page = F.when(is_markup, F.when(blank, F.coalesce(col(html), F.lit(""))).otherwise(stored))
    return collapse(F.when(is_markup, html_text(page, HISTORY_SKIP_TAGS, separator=" ")).otherwise(stored))
