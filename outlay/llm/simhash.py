"""SimHash near-copies by covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority vote of the hashes of the text's word shingles. For radius r every bit
position is given a non-zero vector of r + 1 bits; for each non-zero v one table fixes the positions whose vector has
odd parity with v. At most r differing positions give r linear conditions on r + 1 bits, so some v is even on all of
them: the pair agrees on all that this table fixes. No pair within the radius is missed.

Only distinct fingerprints enter tables, so a group of exact copies is one row. Buckets of up to ``BUCKET``
fingerprints are compared in bounded batches and emit a spanning forest, not pairs. Larger buckets go to finer tables:
the same construction over the positions left free, until at most r positions are free and all in a bucket are within
the radius; their members hang on the least one. The number of rows grows with the number of fingerprints alone.

Null, empty and blank texts have fingerprint 0 and link like any other. Rows with a null id are dropped, as no
component can name them; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import stored, table, text_slices
from outlay.llm.components import roots

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints that are compared with each other at most; larger buckets are split by finer tables.
BUCKET = 512
_CHUNK = 65_536
# Byte value to eight counters of 8 bits, lowest bit in the lowest byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lower-cased; fewer words are one shingle, none give no hash."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*[words[i:] for i in range(size)]) if len(words) >= size else (words,)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(r), SEED) for r in runs], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        octets = hashes[start : start + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        edges = np.arange(0, len(octets), 255)
        for k in range(8):
            # 255 rows at most, so no 8-bit counter overflows.
            sums = np.add.reduceat(_SPREAD[octets[:, k]], edges)
            counts[8 * k : 8 * k + 8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            found = np.array([fingerprint(shingle_hashes(t, size)) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, fp long")


# ----- tables -----


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def finer(free: int, radius: int) -> list[int]:
    """Free masks of the tables that cover ``radius`` differences among the positions set in ``free``."""
    places = [i for i in range(BITS) if free >> i & 1]
    if len(places) <= 2 * radius + 2:
        return [sum(1 << i for i in few) for few in combinations(places, min(radius, len(places)))]
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        fixed = sum(1 << p for k, p in enumerate(places) if ((1 + k % n) & v).bit_count() & 1)
        masks.append(free & ~fixed)
    return sorted(set(masks))


def _table_rows(members: DataFrame, frees: dict[int, list[int]], first: bool) -> DataFrame:
    """One row for each fingerprint and finer table: (free, key, fp)."""
    spark = members.sparkSession
    if first:
        masks = [_signed(m) for m in next(iter(frees.values()))]
        rows = members.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("free"))
    else:
        # At most 15 ** level entries, whatever the data.
        pairs = spark.createDataFrame([(_signed(f), [_signed(m) for m in ms]) for f, ms in frees.items()], "free long, next array<long>")
        rows = members.join(F.broadcast(pairs), "free").select("fp", F.explode("next").alias("free"))
    rows = rows.select("free", F.col("fp").bitwiseAND(F.bitwise_not("free")).alias("key"), "fp")
    return rows if first else rows.distinct()


# ----- links inside buckets -----


def forest(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among ``values`` (sorted by group): each non-root with the least value of its local component."""
    n, step = len(values), 1
    left, right = [], []
    start = np.arange(n)
    while len(start):
        start = start[start + step < n]
        start = start[groups[start] == groups[start + step]]
        near = np.bitwise_count(values[start] ^ values[start + step]) <= radius
        left.append(start[near])
        right.append(start[near] + step)
        step += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    child = np.flatnonzero(label != np.arange(n))
    return values[child].view(np.int64), values[label[child]].view(np.int64)


def _links(batches, radius: int):
    """Batches sorted by bucket to links; an unfinished bucket waits for the next batch."""
    held: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    for batch in batches:
        rows = np.concatenate([*held, np.stack([batch.column(i).to_numpy() for i in range(3)])], axis=1)
        changes = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        cut = changes[-1] if len(changes) else 0
        held = [rows[:, cut:]]
        yield from _linked(rows[:, :cut], changes[:-1] if len(changes) else changes, radius)
    rows = held[0]
    yield from _linked(rows, np.zeros(0, np.int64), radius)


def _linked(rows: np.ndarray, changes: np.ndarray, radius: int):
    if not rows.shape[1]:
        return
    group = np.zeros(rows.shape[1], np.int64)
    group[changes] = 1
    group = np.cumsum(group)
    a, b = forest(group, rows[2].view(np.uint64), radius)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(found: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``found`` (fp) that join all that are within the radius."""
    everything = (1 << BITS) - 1
    frees, parts, members, first = {everything: finer(everything, radius)}, [], found, True
    while True:
        rows = _table_rows(members, frees, first)
        first = False
        if not parts:
            rows = stored(rows, "tables")
        counts = rows.groupBy("free", "key").agg(F.count("*").alias("n"))
        nexts = sorted({m for ms in frees.values() for m in ms})
        done = [m for m in nexts if m.bit_count() <= radius]
        if done:
            # All of a bucket are within the radius of each other: hang them on the least.
            small = rows.where(F.col("free").isin([_signed(m) for m in done]))
            least = small.groupBy("free", "key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
            parts.append(stored(small.join(least, ["free", "key"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct(), "links"))
            rows = rows.where(~F.col("free").isin([_signed(m) for m in done]))
            counts = rows.groupBy("free", "key").agg(F.count("*").alias("n"))
        hot = stored(counts.where(F.col("n") > bucket).drop("n"), "hot")
        some = not hot.isEmpty()
        usual = rows.join(hot, ["free", "key"], "left_anti") if some else rows
        shared = usual.join(counts.where(F.col("n").between(2, bucket)).drop("n"), ["free", "key"], "left_semi")
        shared = shared.repartition("free", "key").sortWithinPartitions("free", "key", "fp").select("free", "key", "fp")
        parts.append(shared.mapInArrow(lambda batches: _links(batches, radius), "a long, b long"))
        if not some:
            break
        members = stored(rows.join(hot, ["free", "key"], "left_semi"), "members")
        frees = {m: finer(m, radius) for m in nexts if m.bit_count() > radius}
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id reachable by links of at most ``radius`` bits."""
    own = stored(fingerprints(docs, size, key, text), "fingerprints")
    reps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    tree = stored(roots(links(reps.select("fp"), radius)), "roots")
    rooted = reps.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` with one document of each component: the one with the least id; of rows that repeat an id, one.

    Rows with a null id are kept, as nothing names them.
    """
    names = docs.columns
    best = components(docs, size, radius).where("doc_id = component_id").select(F.col("doc_id").alias("_simhash_id")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("_simhash_id"))
    named = row.where("_simhash_id IS NOT NULL").join(best, "_simhash_id")
    one = named.groupBy("_simhash_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(row.where("_simhash_id IS NULL").select("row.*"))


def op2(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
