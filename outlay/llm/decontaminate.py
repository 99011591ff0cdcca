"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of words; words at ignored positions do not enter its hash, so a substituted word
there does not hide a match. Seeds of benchmark items are matched with those of every position of every text; each hit
names a diagonal (item, shift), and along the diagonal words are compared one by one. A stretch counts if at least
``SIMILARITY`` of its words are equal and it has ``MIN_WORDS`` words, or covers the whole of a shorter item. A stretch begins and
ends with equal words. Items shorter than ``MIN_WORDS`` have masks of their own length that leave no such match out; for
longer ones fixed masks find all placements of two substitutions in 13 or 14 words, and 282 of 286 of three in 15.

The benchmark is the stated query side. It is handled in blocks of at most ``BLOCK_WORDS`` words, each broadcast as
sorted arrays (24 MB at most) to one pass over the texts; a larger benchmark takes more passes, never a larger
broadcast. An item longer than a block is a block of its own. Texts are not shuffled: a hot passage or source is
spread like any other rows.

Null and empty texts and items have no words and match nothing. Words are runs of letters and digits, lower-cased.
Repeated document rows give repeated results; items with equal words are reported each. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.common import stored, table, text_slices

#: 1: the word enters the hash, 0: it is ignored. Every mask begins and ends with 1.
MASKS = ("110101101", "1011001011", "11100010011")
MIN_WORDS = 13
SIMILARITY = 0.8
BLOCK_WORDS = 200_000
_WORDS = re.compile(r"\w+")
_BITS = 22


class Vocabulary(dict):
    """Word to 64-bit hash; emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str, known: Vocabulary) -> np.ndarray:
    return np.array([known[w] for w in _WORDS.findall(text.lower())], dtype=np.uint64)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words that ``mask`` keeps, for every start; empty if there are fewer words than the mask is long."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def short_masks(size: int) -> list[str]:
    """Masks over a whole item of few words that together see every match of it.

    Both ends are equal in a match. The words between fall into one piece more than may differ, so one piece is whole; each
    mask keeps the ends and one piece.
    """
    differ = size - math.ceil(size * SIMILARITY - 1e-9)
    pieces = np.array_split(np.arange(1, size - 1), differ + 1) if differ else [np.arange(size)]
    return ["".join("1" if i in (0, size - 1) or i in piece else "0" for i in range(size)) for piece in pieces]


class Seeds:
    """The sorted seeds of a block of items, with the items' words."""

    def __init__(self, items: list[tuple[int, str]]):
        known = Vocabulary()
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t or "", known) for _, t in items]
        keys, where, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, words in enumerate(self.words):
            for mask in MASKS if len(words) >= MIN_WORDS else short_masks(len(words)) if len(words) else ():
                found = seed_hashes(words, mask)
                keys.append(found)
                where.append(np.full(len(found), k))
                at.append(np.arange(len(found)))
        sizes = {len(w) for w in self.words}
        self.masks = [*(MASKS if max(sizes, default=0) >= MIN_WORDS else ()), *[m for n in sorted(sizes) if 0 < n < MIN_WORDS for m in short_masks(n)]]
        keys, where, at = np.concatenate(keys), np.concatenate(where), np.concatenate(at)
        order = np.argsort(keys, kind="stable")
        self.keys, self.where, self.at = keys[order], where[order], at[order]
        # A bit for each low part of a seed: nearly all positions of the texts stop there.
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.keys & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, shift) of each diagonal with a hit; shift is the text position of the item's first word."""
        found = set()
        for mask in self.masks:
            seeds = seed_hashes(words, mask)
            spots = np.flatnonzero(self.bits[seeds & np.uint64((1 << _BITS) - 1)])
            if not len(spots):
                continue
            low, high = np.searchsorted(self.keys, seeds[spots], "left"), np.searchsorted(self.keys, seeds[spots], "right")
            for p, a, b in zip(spots[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                found.update(zip(self.where[a:b].tolist(), (p - self.at[a:b]).tolist()))
        return found

    def stretch(self, words: np.ndarray, k: int, shift: int) -> tuple[int, int, int]:
        """(first word, words, equal words) of the longest tolerated stretch on a diagonal, in text positions."""
        item = self.words[k]
        first, last = max(0, shift), min(len(words), shift + len(item))
        equal = (words[first:last] == item[first - shift : last - shift]).astype(np.int64)
        # Longest stretch from one equal word to another with 5 * equal >= 4 * length: prefix sums of 5 * equal - 4.
        gain = np.concatenate([[0], np.cumsum(equal * 100 - round(SIMILARITY * 100))])
        best = (0, 0, 0)
        starts = np.flatnonzero(equal)
        if not len(starts):
            return best
        low = np.minimum.accumulate(gain[:-1])
        for end in starts[::-1].tolist():
            if end + 1 <= best[1]:
                break
            # The first start whose prefix sum is not above this end's: low falls monotonically.
            begin = int(np.searchsorted(-low[: end + 1], -gain[end + 1], "left"))
            if begin <= end and end + 1 - begin > best[1]:
                best = (first + begin, end + 1 - begin, int(equal[begin : end + 1].sum()))
        return best

    def needed(self, k: int) -> int:
        return min(MIN_WORDS, len(self.words[k]))

    def overlaps(self, text: str, known: Vocabulary) -> list[tuple[int, int, int, int]]:
        """(item id, first word, words, equal words): for each item that counts, its longest stretch."""
        words = word_hashes(text, known)
        best: dict[int, tuple[int, int, int]] = {}
        for k, shift in self.hits(words):
            found = self.stretch(words, k, shift)
            if found[1] >= self.needed(k) and (k not in best or (found[1], -found[0]) > (best[k][1], -best[k][0])):
                best[k] = found
        return [(self.ids[k], *best[k]) for k in sorted(best)]


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``BLOCK_WORDS`` words, one block in memory at a time."""
    items = benchmark.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL AND k IS NOT NULL")
    block, size = [], 0
    for row in items.orderBy("k", "t").toLocalIterator():
        n = len(_WORDS.findall(row.t))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.k, row.t))
        size += n
    if block:
        yield block


_FOUND = "doc_id long, item_id long, first_word long, n_words long, n_equal long"


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal): the longest tolerated stretch of each item in each text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            seeds, known = Seeds(shared.value), Vocabulary()
            for ids, texts in text_slices(batches):
                found = [(i, *o) for i, t in zip(ids, texts) for o in seeds.overlaps(t, known)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "item_id", "first_word", "n_words", "n_equal"])

        part = rows.mapInArrow(run, _FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def leaks(found: DataFrame) -> DataFrame:
    """One row for each document with an overlap: how many items, and the longest with its item (least id on ties)."""
    best = Window.partitionBy("doc_id").orderBy(F.desc("n_words"), F.desc("n_equal"), "item_id", "first_word")
    counts = Window.partitionBy("doc_id")
    rows = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_words", "n_equal", "first_word"), F.struct("n_words", "n_equal", -F.col("first_word"))).alias("b")).select("doc_id", "item_id", "b.*")
    return rows.withColumns({"n_items": F.count("*").over(counts), "r": F.row_number().over(best)}).where("r = 1").drop("r")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any overlap. Rows with a null id are tested by their own texts."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    clean = marked
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        clean = clean.where(~_leaks_udf(shared)(F.col("text")))
    return clean.select("row.*")


def _leaks_udf(shared):
    """Whether a text overlaps an item of the broadcast block, in Arrow batches; seeds are built once for each task."""

    @F.arrow_udf("boolean")
    def leaks_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seeds, known = Seeds(shared.value), Vocabulary()
        for texts in batches:
            yield pa.array([bool(seeds.overlaps(t.as_py() or "", known)) for t in texts], pa.bool_())

    return leaks_text


def op10(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_items, item_id, first_word, n_words, n_equal) of every contaminated document."""
    found = stored(overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "overlaps")
    return leaks(found).select("doc_id", "n_items", "item_id", "first_word", "n_words", "n_equal")
