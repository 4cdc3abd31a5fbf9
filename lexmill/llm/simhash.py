"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if some value lies
within r bits of both.  So every fingerprint emits all values within r bits
(its ball: 2,081 values for r = 2), and fingerprints that share a value are
linked.  Sharing proves the link, and each value can be shared by no more
fingerprints than its own ball holds, so no group is unbounded and links within
it can be stars.

Balls are not shipped value by value.  The shuffle key is the value's lowest
``key_bits`` bits; a fingerprint goes once to each key that occurs in its ball
(79 for 12 bits), and the values of that key are made, sorted and met there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import counted_join, materialise
from .textscan import utf8

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Most values of one key that are held in memory at once; a larger key is met in several passes.
VALUES_AT_ONCE = 4_000_000
_HASHES_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count, ones, digest = len(words) - n + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for low in range(0, count, _HASHES_AT_ONCE):
        high = min(count, low + _HASHES_AT_ONCE)
        spans = zip(starts[low:high].tolist(), ends[low + n - 1 : high + n - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            at = offsets.tolist()
            fps = [fingerprint(data[a:b].tobytes(), shingle_words) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``most`` of them set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a[i] and b[i]; each set's label is its least member."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, labels):
            return labels
        labels = new


def meet(fps: np.ndarray, key: int, key_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints whose balls share a value with these lowest bits: (fingerprint, least of its set)."""
    fps = np.unique(fps)
    unsigned, low_mask = fps.view(np.uint64), np.uint64((1 << key_bits) - 1)
    spent = np.bitwise_count((unsigned & low_mask) ^ np.uint64(key))
    high = unsigned >> np.uint64(key_bits)
    own = [np.flatnonzero(spent == j) for j in range(radius + 1)]
    masks = [flips(64 - key_bits, radius - j) for j in range(radius + 1)]
    passes = -(-sum(len(o) * len(m) for o, m in zip(own, masks, strict=True)) // VALUES_AT_ONCE)
    labels = np.arange(len(fps))
    for turn in range(passes):
        values, owners = [], []
        for o, m in zip(own, masks, strict=True):
            step = max(1, VALUES_AT_ONCE // len(m))
            for i in range(0, len(o), step):
                part = o[i : i + step]
                v, w = (high[part][:, None] ^ m[None, :]).ravel(), np.repeat(part, len(m))
                if passes > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == turn
                    v, w = v[mine], w[mine]
                values.append(v)
                owners.append(w)
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        if len(same):
            labels = _merge(labels, owner[same], owner[same + 1])
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of equal keys in rows (key, fp) sorted by key."""
    key, held = None, []
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if keys[a] != key:
                if held:
                    yield key, np.concatenate(held)
                key, held = int(keys[a]), []
            held.append(fps[a:b])
    if held:
        yield key, np.concatenate(held)


def ball_links(nodes: DataFrame, max_bits: int = RADIUS, key_bits: int = 12) -> DataFrame:
    """(u, v): links that join all fingerprints ``fp`` at ``max_bits`` or fewer differing bits (an even number)."""
    radius = max_bits // 2
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    masks = flips(key_bits, radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 2000):
                part = fps[i : i + 2000]
                keys = (part.view(np.uint64) & np.uint64((1 << key_bits) - 1))[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), pa.array(np.repeat(part, len(masks)))], ["k", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fps in _groups(batches):
            u, v = meet(fps, key, key_bits, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    placed = nodes.select("fp").mapInArrow(spread, "k int, fp long").repartition("k").sortWithinPartitions("k")
    return placed.mapInArrow(join, "u long, v long")


def near_fingerprints(nodes: DataFrame, max_bits: int = RADIUS) -> DataFrame:
    """(fp, root) for each of the distinct fingerprints ``fp`` that links join to a lesser one, the root of its component."""
    # A key should hold some thousand fingerprints, whatever their number.
    key_bits = min(24, max(12, (nodes.count() >> 12).bit_length()))
    return components(ball_links(nodes, max_bits, key_bits)).withColumnRenamed("u", "fp")


def simhash_components(docs: DataFrame, max_bits: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``.

    Needs columns doc_id and text; others are ignored.  A null, empty or blank
    text has fingerprint zero, which links like any other.  Copies share a
    fingerprint and are met once.  component_id is the least doc_id of all rows
    that links reach; rows with a null doc_id take part but never name a
    component (it is null if all its doc_ids are).  Repeated rows give repeated
    rows; an empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, shingle_words), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    roots = near_fingerprints(nodes, max_bits)
    rooted = materialise(nodes.join(roots, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    names = materialise(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "names")
    named = materialise(counted_join(rooted.drop("rep"), names, ["root"], "size", ["fp"]), "named")
    out = counted_join(fps, named.select("fp", "component_id", "n"), ["fp"], "n", ["doc_id"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, one row for each such doc_id; all columns stay.

    Rows with a null doc_id can't be told apart and stay.
    """
    found = simhash_components(docs, max_bits, shingle_words)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
