"""Hard negatives by lists that all anchors of a cluster share, walked until the end is certified.

Anchors are clustered by direction: centroids come from at most ``SAMPLE`` anchors, every anchor takes the nearest. The
score of anchor u and row i is at most |u| |i| cos(max(0, angle(i, c) - t)), where c is the middle of the anchors of a
cluster and t the widest angle between c and one of them. Apart from |u| that bound is the same for all members, so a
cluster sorts the rows by it once, and each member walks the list until the bound of the next row is below the
last score it could still use. Nothing past that place can enter its result.

Rows are dealt into slabs and anchors into blocks of bounded size (a large cluster fills several, small ones share one);
each pair of a block and a slab is one group of a co-grouped job, so neither side is gathered or broadcast and no
group grows with the data. A slab gives at most k rows for each anchor, and the best of all slabs are the result. The first
walk finds the positives, the second one the negatives inside the band that each positive's score opens.

Scores are exact integers: single, double or unbounded precision is taken as the sizes of the components ask; a score
outside of 64 bits counts as the nearest long. Rows with a null id, label, vector or
component, or with a component that is not finite (also once scaled) take no part. A vector shorter than another has zeros in its
missing places. Rows that share the id of an anchor are never its partners; other repeated rows count as often as they occur, and a
repeated anchor repeats its result. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.common import stored, table

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors that fit the centroids, and centroids at most.
SAMPLE, CLUSTERS, PER_CLUSTER = 4_096, 64, 32
#: Most anchors of a block and, on average, rows of a slab. Small tables have fewer rows in a slab, so that all cores work.
BLOCK, SLAB, LEAST_SLAB = 2_048, 16_384, 512
_FIRST, _LAST = 128, 4_096
_LONG = 2**63 - 1


# ----- one group -----


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows of doubles, padded with zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with one width, of the smallest kind of number that holds all products and sums exactly."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    top = max(width, 1) * max(1.0, np.abs(a).max(initial=0.0)) * max(1.0, np.abs(b).max(initial=0.0))
    if top >= 2.0**53:
        return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b))
    kind = np.float32 if top < 2.0**24 else np.float64
    return a.astype(kind), b.astype(kind)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, lengths); a vector of zeros has no direction."""
    top = np.abs(m).max(axis=1, initial=0.0, keepdims=True)
    small = np.divide(m, top, out=np.zeros_like(m), where=top > 0)
    size = np.sqrt((small * small).sum(axis=1, keepdims=True))
    return np.divide(small, size, out=np.zeros_like(m), where=size > 0), (size * top)[:, 0]


def shared_list(members: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bound) of rows, both as directions: bounds fall along the order; a score is at most |u| times the bound."""
    middle = members.mean(axis=0, keepdims=True)
    middle = _unit(middle if np.abs(middle).max(initial=0.0) > 1e-12 else members[:1])[0][0]
    some = np.abs(members).max(axis=1, initial=0.0) > 0
    widest = np.arccos(np.clip(members[some] @ middle, -1, 1)).max(initial=0.0)
    # The slack covers the rounding of angles.
    apart = np.arccos(np.clip(rows @ middle, -1, 1)) - widest - 1e-6
    bound = lengths * np.cos(np.clip(apart, 0, math.pi))
    bound += np.abs(bound) * 1e-9
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def _leading(member: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each member by falling score, then name, in order of member."""
    by = np.argsort(name, kind="stable")
    by = by[np.argsort(-score[by], kind="stable")]
    by = by[np.argsort(member[by], kind="stable")]
    heads = np.flatnonzero(np.diff(member[by], prepend=-1))
    place = np.arange(len(by)) - np.repeat(heads, np.diff(heads, append=len(by)))
    return by[place < k]


def walk(
    anchors: np.ndarray, anchor_names: np.ndarray, anchor_labels: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray,
    rows: np.ndarray, names: np.ndarray, labels: np.ndarray, order: np.ndarray, bound: np.ndarray, same: bool, k: int,
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each column of ``low`` and ``high``: (member, score, name) of the k best rows whose score lies between them."""
    kind = anchors.dtype
    floor, high = low.astype(kind), high.astype(kind)
    found = [(np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)) for _ in range(low.shape[1])]
    at, size = 0, _FIRST
    while at < len(order):
        reach = lengths * bound[at]
        reach = np.maximum(reach + np.abs(reach) * 1e-6 + 1e-6, -_LONG - 1)
        going = np.flatnonzero(((floor <= high) & ~(reach[:, None] < floor)).any(axis=1))
        if not len(going):
            break
        part = order[at : at + size]
        scores = anchors[going] @ rows[part].T
        if kind == object:
            scores = np.clip(scores, -_LONG - 1, _LONG)
        partner = (anchor_labels[going, None] == labels[part]) == same
        partner &= anchor_names[going, None] != names[part]
        for p, (member, score, name) in enumerate(found):
            m, c = np.nonzero(partner & (scores >= floor[going, p, None]) & (scores <= high[going, p, None]))
            if not len(m):
                continue
            member, score, name = np.concatenate([member, going[m]]), np.concatenate([score, scores[m, c]]), np.concatenate([name, names[part[c]]])
            best = _leading(member, score, name, k)
            member, score, name = found[p] = member[best], score[best], name[best]
            last = np.flatnonzero(np.diff(member, append=-1))
            full = np.diff(last, prepend=-1) == k
            floor[member[last[full]], p] = score[last[full]]
        at += size
        size = min(2 * size, _LAST)
    return found


def searched(rows: pa.Table, anchors: pa.Table, same: bool, k: int) -> pa.Table:
    """(aid, slot, name, score) of the k best rows of a slab for each slot of each anchor of a block."""
    out = []
    if rows.num_rows and anchors.num_rows:
        own, raw = matrix(anchors["vec"]), matrix(rows["vec"])
        exact_own, exact = alike(own, raw)
        names, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        width = exact.shape[1]
        directions, lengths = _unit(np.pad(raw, ((0, 0), (0, width - raw.shape[1]))))
        own_directions, own_lengths = _unit(np.pad(own, ((0, 0), (0, width - own.shape[1]))))
        aids, clusters = anchors["aid"].to_numpy(), anchors["cluster"].to_numpy()
        # Python integers: a slot that is missing can take no score.
        slots = max((len(s) for s in anchors["slots"].to_pylist()), default=0)
        low = np.full((len(aids), slots), math.inf, object)
        high = np.full((len(aids), slots), -math.inf, object)
        for i, given in enumerate(anchors["slots"].to_pylist()):
            for p, slot in enumerate(given):
                low[i, p], high[i, p] = (-math.inf, math.inf) if slot is None else (-((-LOW * slot) // 100), HIGH * slot // 100)
        for cluster in np.unique(clusters):
            us = np.flatnonzero(clusters == cluster)
            order, bound = shared_list(own_directions[us], directions, lengths)
            found = walk(exact_own[us], anchors["vec_id"].to_numpy()[us], anchors["label"].to_numpy()[us], own_lengths[us], low[us], high[us],
                         exact, names, labels, order, bound, same, k)
            for p, (member, score, name) in enumerate(found):
                out.append(pa.table({"aid": aids[us][member], "slot": np.full(len(member), p, np.int32), "name": name, "score": score.astype(np.int64)}))
    empty = pa.table({"aid": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "name": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    return pa.concat_tables(out) if out else empty


# ----- jobs -----


def usable(embeddings: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, each component the floor of 256 times its value."""
    x = F.col(f"`{vector}`")
    # Scaling by a power of two and taking the floor lose nothing in the column's own precision.
    wide = F.transform(x.cast("array<double>"), lambda v: v * SCALE)
    bad = F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kind = "array<float>" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    vec = F.transform(wide, lambda v: F.when(F.abs(v) < 2.0**62, F.floor(v).cast("double")).otherwise(v)).cast(kind)
    rows = embeddings.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), vec.alias("vec"))


def centroids(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Directions of ``count`` clusters at most, by k-means on the sphere, the same for the same sample."""
    points = _unit(sample)[0]
    chosen = [points[0]]
    nearest = points @ chosen[0]
    while len(chosen) < min(count, len(points)) and nearest.min() < 1 - 1e-9:
        chosen.append(points[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, points @ chosen[-1])
    middle = np.array(chosen)
    for _ in range(rounds):
        owner = np.argmax(points @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, owner, points)
        new = _unit(sums)[0]
        middle = np.where(np.abs(new).max(axis=1, keepdims=True, initial=0.0) > 0, new, middle)
    return middle


def dealt(counts: dict[int, int], most: int = BLOCK) -> tuple[dict[int, tuple[int, int]], int]:
    """(first block, number of blocks) of each cluster and the number of all blocks: none above ``most`` on average."""
    place, block, filled = {}, 0, 0
    for cluster, n in sorted(counts.items()):
        if n > most:
            block, filled = block + (filled > 0), 0
            parts = -(-n // most)
            place[cluster] = (block, parts)
            block += parts
            continue
        if filled + n > most:
            block, filled = block + 1, 0
        place[cluster] = (block, 1)
        filled += n
    return place, block + (filled > 0)


def clustered(anchors: DataFrame) -> tuple[DataFrame, int]:
    """Anchors with aid, cluster and block, written once, and the number of blocks."""
    count = anchors.count()
    sample = anchors.orderBy(F.xxhash64("vec_id", "vec")).limit(SAMPLE).select("vec").toArrow()
    if not count:
        return anchors.select("*", *[F.lit(0).cast("long").alias(c) for c in ("aid", "cluster", "block")]), 0
    middle = centroids(matrix(sample["vec"]), min(CLUSTERS, -(-count // PER_CLUSTER)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _unit(matrix(pa.chunked_array([batch.column("vec")])))[0]
                width = max(points.shape[1], middle.shape[1])
                near = np.pad(points, ((0, 0), (0, width - points.shape[1]))) @ np.pad(middle, ((0, 0), (0, width - middle.shape[1]))).T
                yield batch.append_column("cluster", pa.array(np.argmax(near, axis=1).astype(np.int64)))

    kind = anchors.schema["vec"].dataType.simpleString()
    near = anchors.mapInArrow(assign, f"vec_id long, label long, vec {kind}, cluster long")
    near = stored(near.withColumn("aid", F.monotonically_increasing_id()), "anchors")
    place, blocks = dealt({r.cluster: r["count"] for r in near.groupBy("cluster").count().collect()})  # at most CLUSTERS rows
    pick = lambda k: F.get(F.array(*[F.lit(place.get(c, (0, 1))[k]).cast("long") for c in range(len(middle))]), F.col("cluster").cast("int"))
    return near.withColumn("block", pick(0) + F.pmod(F.xxhash64("aid"), pick(1))), blocks


def best(rows: DataFrame, anchors: DataFrame, blocks: int, slabs: int, slots: Column, same: bool, k: int) -> DataFrame:
    """(aid, slot, name, score, rank) of the k best rows for each slot of each anchor; a null slot takes any score."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("slab", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slabs)))
    left = left.select("*", every(blocks).alias("block"))
    right = anchors.select("aid", "vec_id", "label", "vec", "cluster", "block", slots.alias("slots"))
    right = right.select("*", every(slabs).alias("slab"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return searched(a, b, same, k)

    pairs = left.groupBy("block", "slab").cogroup(right.groupBy("block", "slab")).applyInArrow(run, "aid long, slot int, name long, score long")
    order = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "name")
    return stored(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, label, vec) tables.

    Positives are the best rows of the anchor's label; for each, negatives are the best rows of other labels whose
    score is between LOW and HIGH hundredths of the positive's.
    """
    spark = rows.sparkSession
    anchors, blocks = clustered(anchors)
    count = rows.count()
    slabs = max(-(-count // SLAB), min(-(-count // LEAST_SLAB), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    if blocks:
        first = best(rows, anchors, blocks, slabs, F.array(F.lit(None).cast("long")), True, positives)
    else:
        first = anchors.select("aid", F.lit(0).alias("slot"), F.col("vec_id").alias("name"), F.col("label").alias("score"), F.lit(0).alias("rank"))
    # At most ``positives`` entries for each anchor.
    kept = first.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "name"))).alias("found"))
    met = anchors.join(kept, "aid")
    if not blocks:
        return met.select(*[F.lit(0).cast(t).alias(c) for c, t in OUT]).limit(0)
    met = stored(met, "positives")
    second = best(rows, met, blocks, slabs, F.transform("found", lambda f: f["score"]), False, negatives)
    owner = met.select("aid", F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("slot", "found"))
    return second.join(owner, ["aid", "slot"]).select(
        "anchor_id", F.col("found.name").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("name").alias("negative_id"),
        F.col("found.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


OUT = (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))


def op13(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = f"""
WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id % {EVERY} = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""
