"""Vector and text similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay.functions import bound, col


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column | str) -> Column:
    v = _doubles(col(vector))
    return F.sqrt(_dot(v, v))


def all_finite(vector: Column | str) -> Column:
    bad = (float("inf"), float("-inf"))
    return F.forall(_doubles(col(vector)), lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(*bad))


def cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine of two vectors; null when lengths differ, a value is not finite, or a norm is 0."""
    a, b = _doubles(col(left)), _doubles(col(right))
    size = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & all_finite(a) & all_finite(b)
    return F.when(fits & (size > 0), _dot(a, b) / size)


# ----- short texts -----


def letters(text: Column) -> Column:
    """The characters of a text, in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def marks(text: Column) -> Column:
    """Each character of a text with the number of its occurrence: two texts share as many marks as letters."""
    count = lambda chars, c, i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")
    return bound(letters(text), lambda chars: F.transform(chars, lambda c, i: F.concat(c, count(chars, c, i))))


def letter_pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text."""
    pairs = lambda chars: F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1)))
    return F.array_distinct(F.filter(bound(letters(text), pairs), lambda p: p.isNotNull()))


def common_letters(left: Column, right: Column) -> Column:
    """How many letters two texts share, whatever their order: no matching blocks can be longer in sum."""
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    return F.aggregate(F.array_distinct(letters(right)), F.lit(0), lambda n, c: n + F.least(count(left, c), count(right, c)))


def _blocks(left: Column, right: Column) -> Column:
    """Summed length of the matching blocks: the longest common stretch (the first in ``left``, then in ``right``), and so on
    in the parts before and after it on both sides.

    Cells are the pairs of places with equal characters and the length of the stretch that begins there. Each round takes the best
    stretch of every open part, cut to it, and opens the parts around it; it ends when no part has a stretch left.
    """
    texts = F.struct(letters(left).alias("a"), letters(right).alias("b"))
    return bound(texts, lambda t: _matched(t["a"], t["b"]))


def _matched(a: Column, b: Column) -> Column:
    # Where the texts differ inside the shorter rest, the stretch ends there; one padded with nulls differs, too.
    differ = lambda i, j: F.array_position(F.zip_with(F.slice(a, i + 1, F.size(a)), F.slice(b, j + 1, F.size(b)), lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    stretch = lambda i, j: F.coalesce(F.nullif(differ(i, j), F.lit(0)) - 1, F.size(a) - i).cast("int")
    places = F.flatten(F.transform(a, lambda x, i: F.transform(F.filter(F.transform(b, lambda y, j: F.when(x == y, j)), lambda j: j.isNotNull()), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    cells = F.transform(places, lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), stretch(c["i"], c["j"]).alias("k")))
    part = lambda i0, i1, j0, j1: F.struct(i0.alias("i0"), i1.alias("i1"), j0.alias("j0"), j1.alias("j1"))
    whole = part(F.lit(0), F.size(a), F.lit(0), F.size(b))

    def best(cells: Column, p: Column) -> Column:
        fits = F.filter(cells, lambda c: (c["i"] >= p["i0"]) & (c["i"] < p["i1"]) & (c["j"] >= p["j0"]) & (c["j"] < p["j1"]))
        # The least struct is the longest stretch, then the first in either text.
        return F.array_min(F.transform(fits, lambda c: F.struct((-F.least(c["k"], p["i1"] - c["i"], p["j1"] - c["j"])).alias("k"), c["i"].alias("i"), c["j"].alias("j"))))

    def around(f: Column) -> Column:
        p, k = f["p"], -f["m"]["k"]
        before, after = part(p["i0"], f["m"]["i"], p["j0"], f["m"]["j"]), part(f["m"]["i"] + k, p["i1"], f["m"]["j"] + k, p["j1"])
        return F.filter(F.array(before, after), lambda q: (q["i0"] < q["i1"]) & (q["j0"] < q["j1"]))

    def round_(state: Column, _: Column) -> Column:
        found = F.filter(F.transform(state["open"], lambda p: F.struct(p.alias("p"), best(state["cells"], p).alias("m"))), lambda f: f["m"].isNotNull())
        return F.struct(
            state["cells"].alias("cells"),
            F.flatten(F.transform(found, around)).alias("open"),
            F.aggregate(found, state["n"], lambda n, f: (n - f["m"]["k"]).cast("int")).alias("n"),
        )

    start = F.struct(cells.alias("cells"), F.array(whole).alias("open"), F.lit(0).alias("n"))
    # A round removes a character from every open part, so the shorter text bounds their number.
    rounds = F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))
    return F.aggregate(rounds, start, round_, lambda s: s["n"])


def block_ratio(left: Column, right: Column) -> Column:
    """Similarity of two short texts in 0..1: twice the length of their matching blocks over both lengths; 1 for two empty ones."""
    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    both = F.length(left) + F.length(right)
    return F.when(left == right, 1.0).otherwise(2.0 * _blocks(left, right) / both)
