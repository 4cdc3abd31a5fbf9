"""Benchmark decontamination with suffix arrays of the training texts.

Each shard of training texts becomes a sequence of word codes (words that no
benchmark item has get code 0, which nothing matches) and a suffix array over
it.  Every suffix of every item is binary-searched in every shard, which gives
all places of its window; from each of these places the text is searched in the
items' own suffix array, as far as it goes, which gives the longest verbatim
match.  The benchmark is the query set: it is cut into blocks of bounded size,
of which a worker holds one at a time, and all blocks pass over a batch of texts
in one stage, so training text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import ALNUM, covered, pieces, scan, word_hashes

WINDOW = 10
#: Text of one block of items, at most: the bound of what is broadcast at once.
BLOCK_BYTES = 8 << 20
#: Text of one shard, about.
SHARD_BYTES = 8 << 20


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the spans, and the index of each one's span."""
    which = np.repeat(np.arange(len(starts)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(which)) - first[which] + starts[which], which


class Coded:
    """Word codes of some texts, read ``per`` words at a time as one integer key."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, bits: int):
        self.codes, self.bits, self.per = codes, bits, 63 // bits
        at, end = np.arange(len(codes)), np.repeat(offsets[1:], np.diff(offsets))
        unknown = np.append(np.flatnonzero(codes == 0), len(codes))
        #: Words from each place to the next code 0 or end of text.
        self.run = np.minimum(unknown[np.searchsorted(unknown, at)], end) - at

    def keys(self, at: np.ndarray, skip: int) -> np.ndarray:
        """Keys of the words ``skip`` after each place; 0 for words beyond the run."""
        out, left = np.zeros(len(at), np.int64), self.run[at] - skip
        for k in range(self.per):
            out <<= self.bits
            inside = np.flatnonzero(left > k)
            out[inside] |= self.codes[at[inside] + skip + k]
        return out


class SuffixArray:
    """Suffixes of at least ``least`` coded words, sorted by their first ``depth`` words or more.

    Keys of the first ``kept`` words are kept beside the suffixes; those beyond are made when asked for.
    """

    def __init__(self, text: Coded, least: int, depth: int, kept: int):
        self.text, self.depth = text, depth
        at = np.flatnonzero(text.run >= max(1, least))
        keys = text.keys(at, 0)
        order = np.argsort(keys, kind="stable")
        self.at, self.levels = at[order], [keys[order]]
        new = np.ones(len(at), bool)
        new[1:] = self.levels[0][1:] != self.levels[0][:-1]
        for skip in range(text.per, depth, text.per):
            group = np.cumsum(new) - 1
            tied = np.flatnonzero(np.bincount(group, minlength=len(at))[group] > 1) if len(at) else at
            if not len(tied) and skip >= kept:
                break
            keys = text.keys(self.at[tied], skip)
            order = np.lexsort((keys, group[tied]))
            self.at[tied], keys = self.at[tied][order], keys[order]
            inner = np.flatnonzero(tied[1:] == tied[:-1] + 1)
            new[tied[inner + 1]] |= keys[inner + 1] != keys[inner]
            if skip < kept:
                # Suffixes move among their equals alone, so that the levels before stay as they are.
                self.levels.append(text.keys(self.at, skip))

    def _keys(self, level: int, rank: np.ndarray) -> np.ndarray:
        return self.levels[level][rank] if level < len(self.levels) else self.text.keys(self.at[rank], level * self.text.per)

    def _bound(self, level: int, low: np.ndarray, high: np.ndarray, target: np.ndarray, shift: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) >> 1
            value = self._keys(level, mid) >> shift[live]
            right = value <= target[live] if after else value < target[live]
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]
        return low

    def longest(self, query: Coded, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For suffixes of ``query`` cut to ``words`` words: the length of the longest match, and its range in the array."""
        matched = np.zeros(len(starts), np.int64)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.at))
        live, per = np.arange(len(starts)), query.per
        for skip in range(0, self.depth, per):
            own = query.keys(starts[live], skip)
            open_ = np.arange(len(live))
            for take in range(per, 0, -1):
                want = np.minimum(words[live[open_]] - skip, take)
                now = open_[want == take]
                shift = np.full(len(now), query.bits * (per - take))
                target, i = own[now] >> shift, live[now]
                a = self._bound(skip // per, low[i], high[i], target, shift, False)
                b = self._bound(skip // per, low[i], high[i], target, shift, True)
                hit = a < b
                low[i[hit]], high[i[hit]], matched[i[hit]] = a[hit], b[hit], skip + take
                open_ = np.setdiff1d(open_, now[hit], assume_unique=True)
            live = live[(matched[live] == skip + per) & (words[live] > skip + per)]
            if not len(live):
                break
        return matched, low, high


class Items:
    """One block of benchmark items, ready for search."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        words = scan(texts, ALNUM, True)
        hashes = word_hashes(words)
        self.ids, self.vocabulary = ids, np.unique(hashes)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.coded = Coded(np.searchsorted(self.vocabulary, hashes) + 1, words.offsets, self.bits)
        sizes = np.minimum(words.counts, window)
        number = np.where(words.counts > 0, words.counts - sizes + 1, 0)
        self.starts, self.item = _spans(words.offsets[:-1], number)
        self.sizes = sizes[self.item]
        self.least = int(self.sizes.min()) if len(self.sizes) else 0
        self.most = int(self.sizes.max()) if len(self.sizes) else 0
        self.array = SuffixArray(self.coded, self.least, int(words.counts.max()) if len(ids) else 0, self.coded.per)

    def search(self, texts: pa.Array) -> list[tuple[int, np.ndarray, list[str], int]]:
        """Per text: number of words, spans of hit words (first, end, first, ...), ids of items with windows in it, words of the longest match."""
        words = scan(texts, ALNUM, True)
        out = [(int(n), np.zeros(0, np.int64), [], 0) for n in words.counts]
        if not len(self.starts) or not len(words.starts):
            return out
        hashes = word_hashes(words)
        code = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        text = Coded(np.where(self.vocabulary[code] == hashes, code + 1, 0), words.offsets, self.bits)
        array = SuffixArray(text, self.least, self.most, self.most)
        if not len(array.at):
            return out
        matched, low, high = array.longest(self.coded, self.starts, self.sizes)
        found = np.flatnonzero(matched == self.sizes)
        if not len(found):
            return out
        # Windows with the same places are one class.
        classes, which = np.unique(np.stack([low[found], high[found], self.sizes[found]], axis=1), axis=0, return_inverse=True)
        place, of_class = _spans(classes[:, 0], classes[:, 1] - classes[:, 0])
        at, size = array.at[place], classes[of_class, 2]
        hit = covered(at, size, len(text.codes))
        doc = np.searchsorted(words.offsets, at, "right") - 1
        longest, places = np.zeros(len(out), np.int64), np.unique(at)
        length, *_ = self.array.longest(text, places, text.run[places])
        np.maximum.at(longest, np.searchsorted(words.offsets, places, "right") - 1, length)
        pairs = np.unique(np.stack([doc, of_class], axis=1), axis=0)
        by_class = np.argsort(which.ravel(), kind="stable")
        number = np.bincount(which.ravel(), minlength=len(classes))
        members, pair = _spans((np.cumsum(number) - number)[pairs[:, 1]], number[pairs[:, 1]])
        items = np.unique(np.stack([pairs[pair, 0], self.item[found[by_class[members]]]], axis=1), axis=0)
        for d in np.unique(doc).tolist():
            own = np.flatnonzero(np.diff(hit[words.offsets[d] : words.offsets[d + 1]], prepend=False, append=False))
            ids = [self.ids[i] for i in items[slice(*np.searchsorted(items[:, 0], [d, d + 1])), 1].tolist()]
            out[d] = (out[d][0], own, ids, int(longest[d]))
        return out


def _blocks(benchmark: DataFrame, window: int) -> list:
    """Broadcast blocks of items, each of about BLOCK_BYTES of text at most; repeated items are one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = -(-size // BLOCK_BYTES) or 1
    out = []
    for b in range(number):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == b).toArrow().combine_chunks()
        texts = block.column("text").combine_chunks() if len(block) else pa.array([], pa.string())
        out.append(benchmark.sparkSession.sparkContext.broadcast(Items(block.column("id").to_pylist(), texts, window)))
    return out


def _join_spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two lists of spans."""
    if not len(a) or not len(b):
        return a if len(a) else b
    size = int(max(a[-1], b[-1]))
    delta = np.zeros(size + 1, np.int64)
    for x in (a, b):
        np.add.at(delta, x[0::2], 1)
        np.add.at(delta, x[1::2], -1)
    return np.flatnonzero(np.diff(np.cumsum(delta[:size]) > 0, prepend=False, append=False))


def _search(column: pa.Array, blocks: list) -> list[tuple[int, np.ndarray, list[str], int]]:
    """The results of all blocks, text by text."""
    out = None
    for block in blocks:
        items, found = block.value, []
        for low, high in pieces(column, SHARD_BYTES):
            found += items.search(column.slice(low, high - low))
        out = found if out is None else [(n, _join_spans(s, t), i + j, max(x, y)) for (n, s, i, x), (_, t, j, y) in zip(out, found, strict=True)]
        if len(blocks) > 1:
            # A worker would keep every block that it has read.
            vars(block).pop("_value", None)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, spans.

    A window is ``window`` consecutive words of an item, or all its words if it
    has fewer; a document's word is hit if it lies in a place of any window.
    ``spans`` are the hit words as first, end, first, end ...; longest_match is
    the longest verbatim match with any item, in words, that begins at such a
    place (0 if there is none).  An id in two blocks counts once.  Needs doc_id and text, and item_id and
    text; other columns are ignored.  Null, empty and wordless texts and items
    match nothing; an empty table of either kind gives no hits.  Rows are
    judged one by one, so repeated rows give repeated results; a null item_id
    is listed as an empty string.  Word equality is that of 64-bit hashes.
    """
    blocks = _blocks(benchmark, window)
    names = ["doc_id", "n_words", "n_hit", "items", "longest_match", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _search(batch.column(1), blocks)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, *_ in found], pa.int64()),
                    pa.array([int((s[1::2] - s[0::2]).sum()) for _, s, *_ in found], pa.int64()),
                    pa.array([sorted(set(i)) for _, _, i, _ in found], pa.list_(pa.string())),
                    pa.array([x for *_, x in found], pa.int64()),
                    pa.array([s.tolist() for _, s, *_ in found], pa.list_(pa.int64())),
                ],
                names,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, longest_match long, spans array<bigint>")
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns.

    Null, empty and wordless texts stay, as do all rows if the benchmark is
    empty; of repeated rows all stay or none.
    """
    blocks, at = _blocks(benchmark, window), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not len(s) for _, s, *_ in _search(batch.column(at), blocks)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
