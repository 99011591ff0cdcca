"""Toxicity by a counterfactually regularised classifier.

A text is the set of its words and their 4- and 5-character runs, marked at word borders. Counts of every feature in the
toxic and other texts of all labelled rows pick the ``FEATURES`` with the highest chi-squared value. A logistic model over
them is fitted on at most ``SAMPLE`` labelled rows (the ones with the least hash of their id; fewer rows are all used).
Each of those texts that names a group is also swapped: the name is replaced by another of its list, and the squared
change of the score is a penalty beside the usual one, so that naming a group does not move the score. The model is a
table of at most ``FEATURES`` weights, sent to all tasks; scoring is one pass over the texts.

Ids, labels and counts are shuffled, texts are not: labels are broadcast in blocks of about ``BLOCK`` ids, and texts meet
them where they are read, in one reading for each block. Only texts of labelled rows that share an id are shuffled.

Null and empty texts score the model's intercept. Rows without a label, and labels of rows that do not exist, are not
learned from; repeated labels count once, by their greatest value; rows that
share an id are learned from once, by their least text, and repeated rows score alike. Without labelled rows, or
with labels of one kind, every text gets the share of toxic labels (0 without any). Labels, language, source and id are
never part of a score; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import stored, table, text_slices

#: Features of the model, labelled rows it is fitted on, and texts a feature must occur in.
FEATURES = 4096
SAMPLE = 20_000
LEAST = 3
#: Labels that are broadcast at once.
BLOCK = 500_000
#: Leading bits of a hash whose values are counted to find where the sample ends.
RANGE_BITS = 14
#: Weights of the usual and of the counterfactual penalty.
RIDGE = 1e-4
FAIRNESS = 1.0
FOLDS, HELD = 5, 0
#: The place of a feature among the chosen ones, as the sample carries it.
PLACE = np.dtype("<u4")
# Names of groups; a swap stays within a list.
GROUPS = (
    ("women", "men", "girls", "boys", "gay", "lesbian", "trans", "straight", "queer"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indian", "mexican", "american", "chinese"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
)
SWAP = {w: g[(k + 1) % len(g)] for g in GROUPS for k, w in enumerate(g)}
_WORDS = re.compile(r"[^\W\d_]+")


class WordFeatures(dict):
    """Word to the hashes of its features; emptied at ``limit`` words. ``only`` keeps chosen features."""

    def __init__(self, only: frozenset[int] | None = None, limit: int = 200_000):
        super().__init__()
        self.only, self.limit = only, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        marked = f"<{word}>"
        runs = {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
        found = {xxhash.xxh64_intdigest(r) >> 1 for r in runs}
        value = self[word] = tuple(found if self.only is None else found & self.only)
        return value


def words_of(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def features(words: set[str], known: WordFeatures) -> set[int]:
    out: set[int] = set()
    for w in words:
        out.update(known[w])
    return out


@dataclass
class Model:
    """Intercept and weights by feature hash."""

    intercept: float = -30.0
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        known = WordFeatures(frozenset(self.weights))

        def score(text: str) -> float:
            z = self.intercept + sum(map(self.weights.__getitem__, sorted(features(words_of(text), known))))
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


# ----- learning -----


def _counts(rows: DataFrame) -> DataFrame:
    """(f, n0, n1): in how many other and toxic texts of (y, text) rows each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for labels, texts in text_slices(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(labels, texts):
                counts[y].update(features(words_of(t), known))
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], names=["f", "n0", "n1"]
            )

    return rows.select("y", "text").mapInArrow(run, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _joined(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the marked rows, the least text of rows that share an id; ``marks`` (doc_id, y) are broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _chosen(docs: DataFrame, marks: DataFrame, count: int, least: int, block: int) -> list[int]:
    """Features with the highest chi-squared value over the texts of all ``marks`` (doc_id, y, copies)."""
    totals = marks.agg(F.count("*").alias("n"), F.sum(1 - F.col("y")).alias("t0"), F.sum("y").alias("t1"), F.max("copies").alias("copies")).first()
    t0, t1 = totals.t0 or 0, totals.t1 or 0
    blocks = max(1, -(-totals.n // block))
    parts = []
    for k in range(blocks):
        here = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k if blocks > 1 else F.lit(True)
        some, own = docs.select("doc_id", "text").where(here), marks.where(here)
        rows = some.join(F.broadcast(own.where("copies = 1").select("doc_id", "y")), "doc_id").select("y", "text")
        if (totals.copies or 1) > 1:
            rows = rows.unionByName(_joined(some, own.where("copies > 1").select("doc_id", "y")).select("y", "text"))
        parts.append(stored(_counts(rows), "counts"))
    counts = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        counts = counts.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    chi = (n1 * t0 - n0 * t1) ** 2 / ((n0 + n1) * (t0 + t1 - n0 - n1) + 1)
    best = counts.where(n0 + n1 >= least).orderBy(chi.desc(), "f").limit(count).select("f")
    return [r.f for r in best.collect()]  # ``count`` at most


def sampled(marks: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows (doc_id, y) with the least hash of their id, all if there are fewer.

    Hash ranges are counted first, so that no more than the sample and one range are sorted in one place.
    """
    h = F.xxhash64("doc_id")
    at = F.shiftright(h, 64 - RANGE_BITS)
    last, seen = None, 0
    for place, n in sorted(marks.groupBy(at.alias("at")).count().collect()):  # 2 ** RANGE_BITS rows at most
        if seen < sample:
            last, seen = place, seen + n
    return marks.where(at <= F.lit(last)).orderBy(h, "doc_id").limit(sample)


def _examples(rows: DataFrame, chosen: list[int]) -> list:
    """Rows (y, x, gained, lost): chosen features, and those that the swap adds and takes, as packed places.

    Four bytes a feature: the driver keeps the sample as arrays, never as objects.
    """
    shared = rows.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(chosen)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        known = WordFeatures(frozenset(place))

        def packed(found: set[int]) -> bytes:
            return np.array(sorted(place[f] for f in found), PLACE).tobytes()

        for labels, texts in text_slices(batches):
            columns: tuple[list, list, list] = ([], [], [])
            for t in texts:
                words = words_of(t)
                other = {SWAP.get(w, w) for w in words}
                x = features(words, known)
                swapped = features(other, known) if other != words else None
                columns[0].append(packed(x))
                columns[1].append(None if swapped is None else packed(swapped - x))
                columns[2].append(None if swapped is None else packed(x - swapped))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], names=["y", "x", "gained", "lost"])

    found = rows.select("y", "text").mapInArrow(run, "y long, x binary, gained binary, lost binary").toArrow().to_pylist()
    return sorted(((e["y"], e["x"], e["gained"], e["lost"]) for e in found), key=lambda e: (e[0], e[1], e[2] or b"", e[3] or b""))


def fitted(examples: list, chosen: list[int], ridge: float = RIDGE, fairness: float = FAIRNESS, rounds: int = 25) -> Model:
    """Weights that minimise mean log loss + ridge / 2 * |w|^2 + fairness * mean squared score change, by Newton steps."""
    y = np.array([e[0] for e in examples], float)
    if not len(y) or y.min() == y.max():
        return Model(60.0 if len(y) and y[0] == 1 else -60.0)

    def sparse(packed):
        at = np.repeat(np.arange(len(packed)), [len(x) // PLACE.itemsize for x in packed])
        return at, np.frombuffer(b"".join(packed), PLACE).astype(np.int64)

    n, k = len(y), len(chosen)
    row, col = sparse([e[1] for e in examples])
    pairs = [e for e in examples if e[2] is not None]
    m = max(1, len(pairs))
    (prow, pcol), (mrow, mcol) = sparse([e[2] for e in pairs]), sparse([e[3] for e in pairs])

    def times(v):  # the intercept is the last weight
        return np.bincount(row, v[col], minlength=n) + v[k]

    def back(r):
        return np.append(np.bincount(col, r[row], minlength=k), r.sum())

    def change(v):
        return np.bincount(prow, v[pcol], minlength=m) - np.bincount(mrow, v[mcol], minlength=m)

    def change_back(r):
        return np.append(np.bincount(pcol, r[prow], minlength=k) - np.bincount(mcol, r[mrow], minlength=k), 0.0)

    held = np.append(np.full(k, ridge), 1e-9)

    def loss(v):
        z = times(v)
        return (np.logaddexp(0, z) - y * z).mean() + (held * v * v).sum() / 2 + fairness * (change(v) ** 2).sum() / m

    w = np.zeros(k + 1)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -60, 60)))
        grad = back((p - y) / n) + held * w + 2 * fairness / m * change_back(change(w))
        if np.abs(grad).max() < 1e-7:
            break
        curve = np.maximum(p * (1 - p), 1e-6) / n
        # Conjugate gradients for curvature * step = -grad.
        step, r = np.zeros(k + 1), -grad
        d, rr = r.copy(), r @ r
        for _ in range(60):
            h = back(curve * times(d)) + held * d + 2 * fairness / m * change_back(change(d))
            a = rr / (d @ h)
            step, r = step + a * d, r - a * h
            rr, old = r @ r, rr
            if rr < 1e-16:
                break
            d = r + rr / old * d
        size = 1.0
        while (after := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if after >= now:
            break
        w, now = w + size * step, after
    return Model(float(w[k]), {f: float(x) for f, x in zip(chosen, w) if x})


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic", held: int | None = HELD, count: int = FEATURES, sample: int = SAMPLE, block: int = BLOCK) -> Model:
    """The model of the labelled rows of ``docs``; rows of fold ``held`` are left out (None: none)."""
    marks = labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL")
    if held is not None:
        marks = marks.where(fold("doc_id") != held)
    marks = marks.groupBy("doc_id").agg(F.max(F.col(label).cast("long")).alias("y"))
    marks = stored(docs.groupBy("doc_id").agg(F.count("*").alias("copies")).join(marks, "doc_id").select("doc_id", "y", "copies"), "marks")
    chosen = _chosen(docs, marks, count, LEAST, block)
    # ``sample`` pairs of an id and a label at most.
    rows = stored(_joined(docs, sampled(marks.select("doc_id", "y"), sample)), "labelled")
    return fitted(_examples(rows, chosen), chosen)


def fold(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


# ----- scoring -----


def _score(docs: DataFrame, model: Model):
    """A column function: the score of a text, in Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = shared.value.scorer()
        for texts in batches:
            yield pa.array([score(t.as_py() or "") for t in texts], pa.float64())

    return score_text


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    return docs.withColumn(name, _score(docs, model)(F.col("text")))


def keep_harmless(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score below ``most``, with their own columns; the model is learned from all folds but the held one."""
    return docs.where(_score(docs, learned(docs, labels))(F.col("text")) < most)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learned(docs, table(spark, sf_dir, "labels")), "score")
    held = F.coalesce(fold("doc_id") == HELD, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
