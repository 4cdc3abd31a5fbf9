"""Clustering around centroids by Lloyd's rounds over distinct vectors, in whole numbers.

Vectors are quantised to whole numbers and equal ones become one row with its
multiplicity.  A round takes the fixed number of centroids to every partition,
which gives back, for each centroid, weighted sums of whole numbers: no order
of adding can change a result.  At the end the distinct vectors' clusters are
joined back to the vec_ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import counted_join, materialise

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
#: Whole numbers to a unit of a component.
SCALE = 256
#: Larger components count as this, so that every squared distance fits a long.
LARGEST = 1 << 27
#: Vectors that a task compares with the centroids at once.
CHUNK = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q) of the vectors with exactly DIMENSIONS components, none null or not finite.

    q holds floor(SCALE * x) of each component, 4 bytes each and so that q
    sorts as the list does.  vec_id may be null or repeat; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            q = np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64)
            flat = np.ascontiguousarray((q + (1 << 31)).astype(">u4"))
            fixed = pa.Array.from_buffers(pa.binary(4 * DIMENSIONS), len(batch), [None, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), fixed.cast(pa.binary())], ["vec_id", "q"])

    whole = F.col("v").isNotNull() & (F.size("v") == DIMENSIONS)
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(whole & usable).mapInArrow(run, "vec_id long, q binary")


def unpacked(column: pa.Array) -> np.ndarray:
    """The vectors of a column of q, a row each."""
    if not len(column):
        return np.zeros((0, DIMENSIONS), np.int64)
    joined = b"".join(x.as_py() for x in column)
    return np.frombuffer(joined, ">u4").astype(np.int64).reshape(-1, DIMENSIONS) - (1 << 31)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smallest of equals, and the squared distance to it."""
    # Sums may wrap around on the way; what comes out fits a long.
    d = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


@dataclass
class Clustering:
    """centroids: a row of whole numbers each. assigned: (q, n, cluster, distance) of each distinct vector. kept: (vec_id, q)."""

    centroids: np.ndarray
    assigned: DataFrame
    kept: DataFrame


def _sums(distinct: DataFrame, centroids: np.ndarray) -> list[Row]:
    """(cluster, n, s0, s1, ...) of every cluster that has vectors: at most as many rows as centroids."""
    names = [f"s{j}" for j in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), DIMENSIONS), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for low in range(0, len(batch), CHUNK):
                part = batch.slice(low, CHUNK)
                x, n = unpacked(part.column(0)), part.column(1).to_numpy()
                at, _ = nearest(x, centroids)
                np.add.at(sums, at, x * n[:, None])
                np.add.at(counts, at, n)
        has = np.flatnonzero(counts)
        columns = [pa.array(has, pa.int32()), pa.array(counts[has]), *(pa.array(sums[has, j]) for j in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *names])

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    return parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect()


def _assign(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), CHUNK):
                part = batch.slice(low, CHUNK)
                at, d = nearest(unpacked(part.column(0)), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.int32()), pa.array(d)], ["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, "q binary, n long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> Clustering:
    """Lloyd's rounds from the vectors whose vec_ids have the smallest hashes.

    Each round gives every vector to the nearest centroid, the smallest number
    of equals, and replaces centroids that have vectors by the floor of their
    mean; at the end vectors are given once more.  A null vec_id is hashed as
    an empty one; vectors of equal vec_ids are ordered by their components.
    With fewer vectors than ``clusters`` each is a centroid; an empty table has
    none and gives no rows.  The driver holds the centroids alone.
    """
    kept = materialise(quantised(vectors), "vectors")
    distinct = materialise(kept.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = kept.select(key.alias("key"), "q").orderBy("key", "q").limit(clusters).collect()
    centroids = unpacked(pa.array([bytes(r.q) for r in seeds], pa.binary()))
    for _ in range(rounds if len(centroids) else 0):
        for r in _sums(distinct, centroids):
            centroids[r.cluster] = [r[f"s{j}"] // r.n for j in range(DIMENSIONS)]
    assigned = _assign(distinct, centroids) if len(centroids) else distinct.select("q", "n", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return Clustering(centroids, materialise(assigned, "assigned"), kept)


def cluster_report(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """A row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    As ``cluster`` says.  The inertias are sums of distances over the vector's
    cluster and over all; one that doesn't fit a long is null.
    """
    found, spark = cluster(vectors, clusters, rounds), vectors.sparkSession
    # A row for each centroid.
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n")).alias("inertia")).collect()
    own = {r.cluster: int(r.inertia) for r in sums}
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(own.values()))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    rows = [(k, fits(own.get(k, 0)), total, sha) for k, sha in enumerate(shas)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = counted_join(found.kept, found.assigned, ["q"], "n", ["vec_id"])
    out = out.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
