"""Near copies: SimHash fingerprints (op8) and MinHash bands find candidates, the Jaccard similarity of whole shingle sets decides.

Documents whose fingerprints op8 puts into one component are linked to its
least one.  Its 4 bits leave most pairs of a similarity of 0.8 apart, so
documents that share a band of MinHashes are linked to the band's least
document too, and the components of all these links hold, but for a chance
stated at BANDS, every pair that is similar.  A document is its set of shingles.  The texts
of one component then meet, once each, or block by block, and their shingle
sets are compared: no estimate decides.  Documents with equal sets are one from
the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import counted_join, materialise
from .textscan import utf8

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair shares no band with probability (1 - s^BAND_HASHES)^BANDS: at most 7e-4 at s = 0.8, 2e-5 at 0.85, 3e-8 at 0.9.
BANDS, BAND_HASHES = 24, 6
SEED = 42
_SHINGLES_AT_ONCE = 1 << 10
_LAST_ID = (1 << 63) - 1
#: Texts of a component of candidates that meet in one task, and of a block of a larger one, in bytes.
GROUP_BYTES = 4 << 20
#: Texts that are broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Rounds in which a larger component's texts are held against one of them before its blocks are compared.
HUB_ROUNDS = 4
#: Groups of up to so many sets are compared pair by pair, larger ones by an index of their shingles.
_FEW = 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles: all its words, if they are fewer; none without a word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - n + 1))


def set_key(hashes: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed longs, each a hash of its place and of BAND_HASHES MinHashes."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), _SHINGLES_AT_ONCE):
        part = hashes[low : low + _SHINGLES_AT_ONCE]
        np.minimum(least, (_FACTORS[:, None] * part[None, :]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND_HASHES))], np.uint64).view(np.int64)


def signatures(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, mark, key, bands, fp): each row's set of shingles as one long, its bands, and op8's fingerprint; mark is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            at = offsets.tolist()
            texts = [data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            sets = [shingles(x, shingle_words) for x in texts]
            rows = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
            fps = pa.array(np.array([simhash.fingerprint(x) for x in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(set_key, sets), pa.int64()), rows, fps], ["doc_id", "mark", "key", "bands", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, mark long, key long, bands array<long>, fp long")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): null texts are empty; mark is a hash of the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _order(doc_id: Column) -> Column:
    """What doc_ids are compared by: a null one comes after all others."""
    return F.coalesce(doc_id, F.lit(_LAST_ID))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def link(sets: list[np.ndarray], least: float = SIMILARITY, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components that all similar pairs of these sets form; pairs already joined, by ``labels`` or here, are not compared."""
    root = list(range(len(sets))) if labels is None else labels.tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = sorted((find(i), find(j)))
        root[b] = a

    if len(sets) <= _FEW:
        for i in range(1, len(sets)):
            for j in range(i):
                if find(i) != find(j) and similar(sets[i], sets[j], least):
                    join(i, j)
        return np.array([find(i) for i in range(len(sets))], np.int64)
    # A set's overlaps with all others at once: how often each occurs among the owners of its shingles.
    sizes = np.array([len(x) for x in sets])
    _, at, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    begin = np.cumsum(number) - number
    for i, own in enumerate(np.split(at, np.cumsum(sizes)[:-1])):
        own = own[number[own] > 1]
        if i and len(own):
            both = np.bincount(np.concatenate([owners[begin[x] : begin[x] + number[x]] for x in own.tolist()]), minlength=len(sets))[:i]
            for j in np.flatnonzero((both > 0) & (both >= least * (sizes[i] + sizes[:i] - both) - 1e-9)).tolist():
                if find(i) != find(j):
                    join(i, j)
    return np.array([find(i) for i in range(len(sets))], np.int64)


def _sets(texts: pd.Series, shingle_words: int) -> list[np.ndarray]:
    return [shingles(x.encode(), shingle_words) for x in texts]


def judge_members(members: DataFrame, least: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, first): the least (id, mark) that similar pairs reach within each ``root``, for rows (key, root, id, mark, text).

    The texts of a root of up to ``group_bytes`` meet in one task.  Larger
    roots, a group of near copies of a third of all rows among them, are judged
    in blocks; see ``_block_links``.
    """
    sizes = members.groupBy("root").agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    large = materialise(sizes.where(F.col("bytes") > group_bytes), "large")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "mark"])
        labels = link(_sets(pdf.text, shingle_words), least)
        firsts = pdf.iloc[pd.Series(labels).groupby(labels).transform("idxmin")]
        return pd.DataFrame({"key": pdf.key.to_numpy(), "id": firsts.id.to_numpy(), "mark": firsts["mark"].to_numpy()})

    kind = "key long, id long, mark long"
    small = members.join(large.select("root"), "root", "left_anti").groupBy("root").applyInPandas(compare, kind)
    if not large.isEmpty():
        rows = materialise(members.join(large, "root"), "large-members")
        roots = materialise(components(_block_links(rows, least, shingle_words, group_bytes)), "large-roots").withColumnRenamed("u", "key").withColumnRenamed("root", "joined")
        named = materialise(rows.select("key", "id", "mark").join(roots, "key", "left").withColumn("joined", F.coalesce("joined", "key")), "large-named")
        firsts = materialise(named.groupBy("joined").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("n")), "large-firsts")
        named = counted_join(named.select("key", "joined"), firsts, ["joined"], "n", ["key"])
        small = small.unionByName(named.select("key", "first.id", "first.mark"))
    return small.select("key", F.struct("id", "mark").alias("first"))


def _block_links(rows: DataFrame, least: float, shingle_words: int, block_bytes: int) -> DataFrame:
    """(u, v): links that join all similar pairs of keys within each root of rows (key, root, id, mark, text, bytes).

    A few rounds hold all texts of a root against one of them, which takes no
    shuffle and joins most of a group of near copies.  Texts joined by one
    round needn't be compared with each other again.  All other pairs are, in
    blocks of about ``block_bytes``: a task has two blocks at most.
    """
    left, links = rows.select("key", "root", "text"), None
    for turn in range(HUB_ROUNDS):
        hubs = left.groupBy("root").agg(F.min_by(F.struct("key", "text"), "key").alias("hub")).select("root", F.col("hub.key").alias("hub"), F.col("hub.text").alias("hub_text"))
        hubs = materialise(hubs, f"hubs-{turn}")

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, own = None, None
            for batch in batches:
                found = []
                for k, hub_text, text in zip(batch.column("hub").to_pylist(), batch.column("hub_text"), batch.column("text"), strict=True):
                    if k != hub:
                        hub, own = k, shingles(hub_text.as_py().encode(), shingle_words)
                    found.append(k if similar(own, shingles(text.as_py().encode(), shingle_words), least) else None)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "root", "text")), pa.array(found, pa.int64())], ["key", "root", "text", "hub"])

        # A root of more than block_bytes has one hub, so that hubs are few beside the rows; they are broadcast only if small.
        size = hubs.agg(F.sum(F.octet_length("hub_text"))).first()[0] or 0
        met = left.join(F.broadcast(hubs) if size <= BROADCAST_BYTES else hubs, "root").select("key", "root", "text", "hub", "hub_text")
        met = materialise(met.mapInArrow(against, "key long, root long, text string, hub long"), f"met-{turn}")
        joined = met.where("hub is not null")
        links = joined if links is None else links.unionByName(joined)
        left = met.where("hub is null").drop("hub")
        if left.isEmpty():
            break
    both = links.unionByName(left.withColumn("hub", F.lit(None).cast("long")))
    group = F.coalesce("hub", F.lit(0))
    sizes = both.groupBy("root", group.alias("group"), F.col("hub").isNull().alias("free")).agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.col("bytes") / block_bytes).cast("int")).drop("bytes"), "blocks")
    number = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = both.withColumn("group", group).withColumn("free", F.col("hub").isNull()).join(sizes, ["root", "group", "free"])
    placed = materialise(placed.withColumn("block", number).drop("blocks"), "placed")
    names = sizes.select("root", "group", "free", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    side = lambda x: names.select("root", F.struct("free", "group", "block").alias(x))
    pairs = side("x").join(side("y"), "root").where("x < y OR (x = y AND x.free)")
    pairs = pairs.where(~(F.col("x.group") == F.col("y.group")) | F.col("x.free") | F.col("y.free"))
    pairs = materialise(pairs.select("root", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("mine")), "pairs")
    sent = placed.withColumn("mine", F.struct("free", "group", "block")).select("root", "mine", "key", "hub", "text").join(pairs, ["root", "mine"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        start = np.arange(len(pdf))
        hub = pdf.hub.to_numpy(dtype=object)
        heads: dict[int, int] = {}
        for i, h in enumerate(hub):
            if h is not None and h == h:
                start[i] = heads.setdefault(int(h), i)
        labels = link(_sets(pdf.text, shingle_words), least, start)
        moved = np.flatnonzero(labels != np.arange(len(pdf)))
        keys = pdf.key.to_numpy()
        return pd.DataFrame({"u": keys[moved], "v": keys[labels[moved]]})

    found = sent.select("root", "x", "y", "key", F.col("hub").cast("string").alias("hub"), "text").groupBy("root", "x", "y").applyInPandas(compare, "u long, v long")
    return found.unionByName(links.select(F.col("key").alias("u"), F.col("hub").alias("v")))


def _fingerprint_bands(keys: DataFrame) -> DataFrame:
    """(key, band): the root of the component that op8 puts each of a key's fingerprints into, for rows (key, fp)."""
    keys = materialise(keys, "fingerprints")
    nodes = materialise(keys.groupBy("fp").agg(F.count("*").alias("n")), "fingerprint-nodes")
    rooted = materialise(nodes.join(simhash.near_fingerprints(nodes), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    return counted_join(keys, rooted, ["fp"], "n", ["key"]).select("key", F.col("root").alias("band")).distinct()


def _components(docs: DataFrame, least: float, shingle_words: int) -> DataFrame:
    """(doc_id, mark, first_id, first_mark), a row per row of ``docs``: the least row that its links reach, by doc_id and then by mark."""
    signed = materialise(signatures(docs, shingle_words).withColumn("id", _order(F.col("doc_id"))), "signatures")
    nodes = signed.groupBy("key").agg(F.min(F.struct("id", "mark")).alias("rep"), F.count("*").alias("n"))
    nodes = materialise(nodes.select("key", "rep.id", "rep.mark", "n"), "nodes")
    placed = signed.dropDuplicates(["key"]).select("key", F.explode("bands").alias("band"))
    # A component of fingerprints is one more band; equal sets may have several fingerprints.
    placed = materialise(placed.unionByName(_fingerprint_bands(signed.select("key", "fp").distinct())), "bands")
    first = placed.groupBy("band").agg(F.min("key").alias("v"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first, "first")
    links = counted_join(placed, first, ["band"], "n", ["key"]).where("v <> key").select(F.col("key").alias("u"), "v")
    roots = materialise(components(links).select(F.col("u").alias("key"), "root"), "roots")
    members = roots.union(roots.select("root", "root").distinct()).join(nodes.select("key", "id", "mark"), "key")
    texts = _texts(docs).select(_order(F.col("doc_id")).alias("id"), "mark", "text")
    # Equal rows are one.
    members = materialise(members.join(texts, ["id", "mark"]).dropDuplicates(["key"]), "members")
    judged = materialise(judge_members(members, least, shingle_words), "judged")
    named = nodes.join(judged, "key", "left").select("key", "n", F.coalesce("first", F.struct("id", "mark")).alias("first"))
    out = counted_join(signed.select("doc_id", "mark", "key"), materialise(named, "named"), ["key"], "n", ["doc_id", "mark"])
    return out.select("doc_id", "mark", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark"))


def near_copies(docs: DataFrame, least: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, component_id), a row per row of ``docs``.

    component_id is the least doc_id that links of at least this similarity
    reach.  Null, empty and blank texts are copies of each other.  Rows with a
    null doc_id take part but never name a component, unless all of its
    doc_ids are null: then it is null.  Only doc_id and text are read.
    """
    found = _components(docs, least, shingle_words)
    # No doc_id but null can be greater, and none is taken for it: the greatest one is a component's least only alone or with null ones.
    return found.select("doc_id", F.when((F.col("first_id") < _LAST_ID) | (F.col("doc_id") == _LAST_ID), F.col("first_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the least doc_id, null ones last.

    Rows are told apart by their whole content, not by doc_id: different texts
    of one doc_id both stay, unless they are near copies.  Of rows that share
    doc_id and text, that with the least hash of all columns stays; rows equal
    in all columns are one.  An empty table stays empty.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = F.xxhash64(*[F.to_json(F.struct(docs[f.name])) if "map" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), _order(docs["doc_id"].cast("long")).alias("id"), mark.alias("mark"), whole.alias("whole"))
    firsts = _components(docs, least, shingle_words).select(F.col("first_id").alias("id"), F.col("first_mark").alias("mark")).distinct()
    held = materialise(rows.select("id", "mark", "whole").distinct().groupBy("id", "mark").agg(F.min("whole").alias("whole")).join(firsts, ["id", "mark"]), "held")
    return rows.join(held, ["id", "mark", "whole"], "left_semi").dropDuplicates(["id", "mark", "whole"]).select("__doc.*")
