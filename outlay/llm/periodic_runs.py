"""Periodic runs: stretches of words that repeat with a fixed period, found exactly by recompression.

A run of period q has at least max(6, 4q) words, so it covers four neighbouring multiples of q, and the words there are equal.
For each q the words at multiples of q are compared with their successors (a harmonic sum over all q); three equalities in a row
make a candidate. Only texts with candidates get a grammar: block compression (a repeated symbol becomes one symbol with its
count) and pair compression (symbols fall into two halves by a hash, a left one followed by a right one becomes a new
symbol) take turns until every text is a few symbols. Equal stretches are cut alike on every level but near their
ends, so the longest common extension of two places climbs while both are at the border of a symbol and descends after a
difference: a few steps a level, for all candidates of a batch at once. Extensions to both sides give the run; if several
periods give one stretch, the least is its period.

Work in a batch grows with words times the logarithm of the longest text; memory of the grammar is about 150 bytes for
each word of the texts that have candidates. Null, empty and blank texts have no words and no runs. Repeated rows give repeated results; a
null id stays null. Empty tables give empty results; only id and text are read, other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import WORD, table, text_slices

LEAST_WORDS = 6
LEAST_TURNS = 4
#: Levels are added until no text has more symbols than this.
TOP = 8
#: Candidates whose extensions are sought at once.
CANDIDATES = 500_000


class Grammar:
    """Levels of a sequence under alternating block and pair compression, in flat arrays.

    Negative symbols are fences: each occurs once and never becomes part of another symbol. Both ends must be fences.
    A place is an index into the flat arrays; places of level 0 are the indexes of the sequence.
    """

    def __init__(self, sequence: np.ndarray):
        symbols, sizes, parents = [sequence.astype(np.int64)], [np.ones(len(sequence), np.int32)], []
        turn = 0
        while np.diff(np.flatnonzero(symbols[-1] < 0)).max(initial=1) - 1 > TOP:
            now = symbols[-1]
            heads, names = self._blocks(now) if turn % 2 == 0 else self._pairs(now, turn)
            turn += 1
            if len(heads) == len(now):
                continue
            parent = np.zeros(len(now), np.int32)
            parent[heads[1:]] = 1
            parents.append(np.cumsum(parent, dtype=np.int32))
            symbols.append(names)
            sizes.append(np.add.reduceat(sizes[-1], heads).astype(np.int32))
        base = np.concatenate([[0], np.cumsum([len(s) for s in symbols])]).astype(np.int64)
        self.symbol, self.size = np.concatenate(symbols), np.concatenate(sizes)
        self.parent = np.full(base[-1], -1, np.int32)
        # Ends of the children: left and right; -1 on level 0.
        self.left, self.right = np.full(base[-1], -1, np.int32), np.full(base[-1], -1, np.int32)
        for level, parent in enumerate(parents):
            low, high = base[level], base[level + 1]
            self.parent[low:high] = high + parent
            ends = np.flatnonzero(np.diff(parent))
            self.left[high : base[level + 2]] = low + np.concatenate([[0], ends + 1])
            self.right[high : base[level + 2]] = low + np.concatenate([ends, [len(parent) - 1]])

    @staticmethod
    def _named(now: np.ndarray, out: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``out`` with one new symbol, above all of ``now``, for each distinct (first, second) at the places ``at``."""
        new = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]
        out[at] = int(now.max()) + 1 + new
        return out

    def _blocks(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        counts = np.diff(heads, append=len(now))
        many = np.flatnonzero(counts > 1)
        names = now[heads]
        return heads, self._named(now, names, many, names[many], counts[many])

    def _pairs(self, now: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = (now.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        half = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)
        word = now >= 0
        zero, one = word & (half == 0), word & (half == 1)
        joined = zero[:-1] & one[1:]
        other = one[:-1] & zero[1:]
        if np.count_nonzero(other) > np.count_nonzero(joined):
            joined = other
        heads = np.flatnonzero(np.concatenate([[True], ~joined]))
        starts = np.flatnonzero(joined)
        names = now[heads]
        return heads, self._named(now, names, np.searchsorted(heads, starts), now[starts], now[starts + 1])

    def extension(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """Number of equal words from places x and y (of level 0, unequal) on to the right (step 1) or left (step -1)."""
        near, far = (self.left, self.right) if step > 0 else (self.right, self.left)
        x, y = x.astype(np.int64), y.astype(np.int64)
        done = np.zeros(len(x), np.int64)
        falling = np.zeros(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            same = self.symbol[a] == self.symbol[b]
            up_a, up_b = self.parent[a], self.parent[b]
            inner = up_a >= 0
            up = same & inner & ~falling[live] & (near[up_a] == a) & (near[up_b] == b)
            on = same & ~up
            # Within a block all symbols are alike: both places pass as many of them as either has left.
            block = on & inner & (self.symbol[self.left[up_a]] == self.symbol[self.right[up_a]]) & (self.symbol[self.left[up_b]] == self.symbol[self.right[up_b]])
            count = np.where(block, np.minimum((far[up_a] - a) * step, (far[up_b] - b) * step) + 1, 1)
            down = ~same & (self.left[a] >= 0)
            done[live] += np.where(on, count * self.size[a], 0)
            x[live] = np.where(up, up_a, np.where(on, a + step * count, np.where(down, near[a], a)))
            y[live] = np.where(up, up_b, np.where(on, b + step * count, np.where(down, near[b], b)))
            falling[live] |= down
            live = live[same | down]
        return done


def grid(sequence: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) candidates; texts begin at ``starts``, longest first, with a fence of its own after each."""
    places, periods = [], []
    for q in range(1, int(sizes.max(initial=0)) // LEAST_TURNS + 1):
        fits = int(np.searchsorted(-sizes, -LEAST_TURNS * q, side="right"))
        end = starts[fits - 1] + sizes[fits - 1]
        points = sequence[:end:q]
        same = points[1:] == points[:-1]
        at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        if len(at):
            half = at + q // 2
            at = at[(sequence[half] == sequence[half + q]) & (sequence[half] == sequence[half + 2 * q])]
            places.append(at)
            periods.append(np.full(len(at), q, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _laid(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (slices of ``numbers``) one after another with fences around each, and where each begins."""
    begins = np.cumsum(sizes + 1) - sizes
    out = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    out[0] = -1
    for k, (a, s, n) in enumerate(zip(begins.tolist(), starts.tolist(), sizes.tolist())):
        out[a : a + n] = numbers[s : s + n]
        out[a + n] = -2 - k
    return out, begins


def _least(rows: np.ndarray) -> np.ndarray:
    """(start, length, period) rows, one for each stretch: its period is the least found."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def runs(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, in order of text, start and period, of texts given as word numbers."""
    none = (np.zeros(0, np.int64),) * 4
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST_WORDS]
    if not len(order):
        return none
    laid, begins = _laid(numbers, starts[order], sizes[order])
    place, period = grid(laid, begins, sizes[order])
    if not len(place):
        return none
    # Only texts with candidates get a grammar.
    owner = np.searchsorted(begins, place, side="right") - 1
    few, rank = np.unique(owner, return_inverse=True)
    small, heads = _laid(laid, begins[few], sizes[order][few])
    grammar = Grammar(small)
    place = place - begins[owner] + heads[rank]
    found = [np.zeros((0, 3), np.int64)]
    for k in range(0, len(place), CANDIDATES):
        x, q = place[k : k + CANDIDATES], period[k : k + CANDIDATES]
        right = grammar.extension(x, x + q, 1)
        left = grammar.extension(x - 1, x + q - 1, -1)
        rows = np.stack([x - left, left + q + right, q], axis=1)
        found = [_least(np.concatenate(found + [rows[rows[:, 1] >= np.maximum(LEAST_WORDS, LEAST_TURNS * q)]]))]
    start, length, period = found[0].T
    rank = np.searchsorted(heads, start, side="right") - 1
    text, start = order[few[rank]], start - heads[rank]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def collapsed(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> bytes:
    """Words joined by one blank, without those that a run holds after its first ``period`` words."""
    if not start:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.add(start, period), 1)
    np.add.at(edge, np.add(start, length), -1)
    return b" ".join(itertools.compress(words, (np.cumsum(edge) == 0).tolist()))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every text, in one pass."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            # Split at the six ASCII blanks, as bytes.split() does.
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            sizes = np.array([len(w) for w in words], np.int64)
            number = defaultdict(itertools.count().__next__)
            flat = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
            owner, start, length, period = runs(flat, sizes)
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
            s, n, q, cuts = start.tolist(), length.tolist(), period.tolist(), offsets.tolist()
            out = [collapsed(w, s[a:b], n[a:b], q[a:b]) for w, a, b in zip(words, cuts, cuts[1:])]
            found = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(run))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), pa.array(out, pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with each run cut to its first period; words are joined by one blank."""
    return scanned(docs, key, text).select("doc_id", F.col("collapsed").alias("text"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, a tenth of them with a periodic tail as the contract of the query states.

    A null id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    n = F.size("words")
    rows = rows.select("doc_id", "text", "words", n.alias("n"), "g", (F.col("g") % n).cast("int").alias("a"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def op11(spark, sf_dir: str) -> DataFrame:
    out = scanned(planted(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.short")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.short DIV best.period").alias("exponent_milli"), _digest(F.col("lines")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
