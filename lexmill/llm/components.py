"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted_join, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with m, the least v of its u; nodes of very many pairs don't skew the join."""
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")
    return counted_join(pairs, least, ["u"], "degree", ["v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (longs u, v) but the roots, the least nodes of their components.

    A round costs joins of the edges alone; the number of rounds grows with the
    logarithm of the longest chain.  Each half round is written to the shared
    folder, so a lost executor costs one half round at most.
    """
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    while True:
        both = materialise(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialise(large.distinct(), "large")
        nearest = _least_neighbour(large)
        small = nearest.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(nearest.select("u", F.col("m").alias("v"))).distinct()
        now, before = materialise(small, "small"), state
        state = _state(now)
        if state == before:
            return now.select("u", F.col("v").alias("root"))
