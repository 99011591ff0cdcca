"""Secret scans: fixed patterns, and a battery of randomness tests for strings without a telling name.

Candidates are runs of at least ``LEAST_RUN`` characters of the base64 and URL-safe alphabets that hold a digit and a
letter and touch no span of a pattern. An equals sign belongs to a run only as padding at its end, so in NAME=VALUE the value
is a candidate of its own. The encoding is the smallest alphabet that holds the string. Under the hypothesis that
the string is uniform over it, three tests give p-values: chi-squared over classes of characters, runs above and below
the middle of the alphabet, and the correlation of neighbours. Three times the least is the string's p-value.

Strings whose hypothesis is rejected are text, numbers or names; the rest are reported as ``random``. Rejections are made by
the Benjamini-Hochberg rule at ``RATE`` within each class of lengths, as longer strings have more power, over the
candidates of all texts: of the strings put aside, at most that share is expected to be random. p-values are rounded up to
cells of a hundredth of a decade, so the rule needs one count for each cell and length class, at most 2,005 rows.

Null and empty texts have no spans. Repeated rows count as often as they occur and give repeated results; a null id stays
null. Empty tables give empty results; only id and text are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.common import stored, table, text_slices

# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
# '=' only closes a run, as the padding of base64 or base32; inside it parts a name from its value.
RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
LEAST_RUN = 20
LENGTHS = (20, 24, 32, 48, 64)
RATE = 0.05
CELLS = 400
_DIGITS, _VOWELS = "0123456789", "aeiou"
# Alphabets from small to large, each in its own order.
ALPHABETS = (
    ("hex", _DIGITS + "abcdef"), ("upper hex", _DIGITS + "ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", _DIGITS + "abcdefghijklmnopqrstuvwxyz"), ("upper", _DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", _DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS + "+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS + "-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS + "+/-_"),
)
_TABLES = [(name, {c: k for k, c in enumerate(a)}) for name, a in ALPHABETS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost without overlap within a kind; matches that are too short drop out."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


# ----- tests -----


def chi_tail(x: float, df: int) -> float:
    """P(X >= x) of the chi-squared law, by the recursion over degrees of freedom."""
    half = x / 2
    p, k = (math.exp(-half), 2) if df % 2 == 0 else (math.erfc(math.sqrt(half)), 1)
    while k < df:
        p += math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2 + 1)) if half > 0 else 0.0
        k += 2
    return min(1.0, p)


def _class(c: str) -> int:
    if c.isdigit():
        return 0
    if not c.isalpha():
        return 1
    return 2 + 2 * c.isupper() + (c.lower() in _VOWELS)


def uniformity(text: str, order: dict[str, int]) -> float:
    """Chi-squared test of the shares of digits, symbols, vowels and other letters by case."""
    size, seen, due = len(order), [0] * 6, [0] * 6
    for c in order:
        due[_class(c)] += 1
    for c in text:
        seen[_class(c)] += 1
    expected = [d * len(text) / size for d in due]
    # Classes with fewer than one expected character join the largest.
    big = max(range(6), key=lambda k: expected[k])
    groups: dict[int, list[float]] = {}
    for k in range(6):
        into = groups.setdefault(k if expected[k] >= 1 else big, [0.0, 0.0])
        into[0] += seen[k]
        into[1] += expected[k]
    if len(groups) < 2:
        return 1.0
    return chi_tail(sum((o - e) ** 2 / e for o, e in groups.values()), len(groups) - 1)


def runs(values: list[int], size: int) -> float:
    """Runs above and below the middle of the alphabet; 0 if all are on one side."""
    high = [2 * v >= size for v in values]
    n1 = sum(high)
    n0, n = len(high) - n1, len(high)
    if not n0 or not n1:
        return 2.0 ** (1 - n)
    count = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * n0 * n1 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return math.erfc(abs(count - mean) / math.sqrt(2 * spread)) if spread > 0 else 1.0


def correlation(values: list[int]) -> float:
    """Correlation of neighbours; 0 for a constant string."""
    n = len(values)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if not spread:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / spread
    return math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))


def battery(text: str) -> tuple[str, float]:
    """(encoding, p-value) of a string under the hypothesis that it is uniform over its alphabet."""
    bare = text.rstrip("=")
    for name, order in _TABLES:
        if all(c in order for c in bare):
            values = [order[c] for c in bare]
            return name, min(1.0, 3 * min(uniformity(bare, order), runs(values, len(order)), correlation(values)))
    return "mixed", 0.0


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, cell) of runs that touch no span in ``taken``; the cell is 100 * -log10 p, at most 400.

    Spans are sorted by start and runs come in order, so both lists are walked once: ``reach`` is the furthest end of the
    spans that start before the end of the run.
    """
    out, at, reach = [], 0, -1
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][2])
            at += 1
        if b - a < LEAST_RUN or a < reach:
            continue
        run = m[0]
        if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        p = battery(run)[1]
        cell = CELLS if p <= 10 ** (-CELLS / 100) else int(-100 * math.log10(p))
        out.append((a, b, sum(b - a >= n for n in LENGTHS) - 1, cell))
    return out


# ----- jobs -----

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
_CAND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int64()), ("cell", pa.int64())]))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, candidates, base_sha256) in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            base = [base_spans(t) for t in texts]
            names = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s) for s in base]
            more = [candidates(t, s) for t, s in zip(texts, base)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in base], _SPAN),
                pa.array([[{"start": a, "end": b, "size": z, "cell": c} for a, b, z, c in s] for s in more], _CAND),
                pa.array([hashlib.sha256(n.encode()).hexdigest() for n in names]),
            ], names=["doc_id", "spans", "candidates", "base_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, spans array<struct<start:long,kind:long,end:long>>, candidates array<struct<start:long,end:long,size:long,cell:long>>, base_sha256 string"
    return rows.mapInArrow(run, kinds)


def limits(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each length class the least cell that is rejected: Benjamini-Hochberg on counts of cells."""
    cells = found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.size").alias("size"), F.col("c.cell").alias("cell")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("size").orderBy(F.desc("cell"))
    ranked = cells.withColumns({"rank": F.sum("n").over(down), "all": F.sum("n").over(Window.partitionBy("size"))})
    # The p-value of a cell is taken as the greatest in it.
    bad = ranked.where(F.pow(F.lit(10.0), -F.col("cell") / 100) * F.col("all") <= F.col("rank") * rate)
    return {r.size: r.cell for r in bad.groupBy("size").agg(F.min("cell").alias("cell")).collect()}  # one row for each length class


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end>>, base_sha256): patterns and random strings of every text."""
    found = stored(scanned(docs), "scanned")
    cut = limits(found, rate)
    keep = lambda c: F.coalesce(*[F.when(c["size"] == z, c["cell"] < least) for z, least in sorted(cut.items())], F.lit(True))
    more = F.transform(F.filter("candidates", keep), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).cast("long").alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", F.sort_array(F.concat("spans", more)).alias("spans"), "base_sha256")


def op9(spark, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", joined.alias("spans"))
