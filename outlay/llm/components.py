"""Connected components of links between long keys, by alternating large-star and small-star rounds.

Each round is two grouped minima and two equi joins; nothing is gathered in one place. A key with very many links is
pre-aggregated by the grouped minimum and split by the adaptive skew join. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the root is the least node of its component.

    Links of a node to itself count as none, repeated links once, null ends are dropped; no links give no rows.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _with_least(large)
        # u and its lesser neighbours all hang on the least of them.
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
