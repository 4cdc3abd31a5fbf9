"""Removal of passages that already occur in a document with a smaller doc_id.

First pass: every partition sketches its windows of 13 words as counts of
hashed cells, and the sketches are merged slice by slice.  A cell's count is an
overestimate of the count of each window in it, so no repeated window is lost.
Cells of two or more are folded into a bitmap of bounded size, which is
broadcast (it is sharp for some tens of GB; beyond, more windows pass, so that
the second pass shuffles more, but loses none).  Second pass: windows that the bitmap estimates to be repeated, and
only those, are grouped exactly, by 96 hash bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .textscan import NOT_SPACE, Words, covered, pieces, scan, utf8, window_hashes, window_starts, word_hashes

WINDOW = 13
#: Cells of the count sketch, as a power of two, for so many windows at most; see ``sketch_plan``.
MIN_CELL_BITS, MAX_CELL_BITS = 26, 40
#: The bitmap has at most 2^30 bits: 128 MB, the bound of what is broadcast.
MAX_BITMAP_BITS = 30
#: Bits of a chunk of the bitmap, as a power of two.
CHUNK_BITS = 20
#: Windows sketched in a slice, about, which bounds what a reducer holds.
SLICE_WINDOWS = 1 << 20
#: Windows sketched before a partition sends its counts on.
SKETCH_AT_ONCE = 4_000_000
#: Windows estimated repeated that a task holds before they leave, about, and those it remembers after.
HELD_WINDOWS, SEEN = 300_000, 1 << 18
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LAST_ID = (1 << 63) - 1


def _windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word indices of all windows, and two independent hashes of each."""
    hashes, starts = word_hashes(words), window_starts(words, n)
    return starts, window_hashes(hashes, n, _FIRST)[starts], window_hashes(hashes, n, _SECOND)[starts]


def sketch_plan(text_bytes: int) -> tuple[int, int, int]:
    """Cell bits, slice bits and bitmap bits for a corpus of so many bytes of text.

    About 64 cells a window keep estimates sharp; beyond 2^40 cells, and for
    bitmaps beyond their bound, more windows are estimated repeated than are.
    That costs shuffle in the second pass, never a result.
    """
    windows = max(1, text_bytes // 6)
    cells = min(MAX_CELL_BITS, max(MIN_CELL_BITS, windows.bit_length() + 6))
    return cells, max(4, min(20, (windows // SLICE_WINDOWS).bit_length())), min(MAX_BITMAP_BITS, max(20, windows.bit_length() + 1))


def repeated_cells(docs: DataFrame, n: int, cell_bits: int, slice_bits: int) -> DataFrame:
    """(cells): arrays of the cells that two or more windows fall into, by the merged sketches of all partitions."""
    low_bits = cell_bits - slice_bits

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            cuts = np.searchsorted(cells >> np.uint64(low_bits), np.arange((1 << slice_bits) + 1, dtype=np.uint64))
            low = cells & np.uint64((1 << low_bits) - 1)
            # Sorted cells of a slice as steps: small numbers, which the shuffle's codec packs.
            steps = np.diff(low, prepend=np.uint64(0))
            firsts = cuts[:-1][cuts[:-1] < cuts[1:]]
            steps[firsts] = low[firsts]
            full = np.flatnonzero(np.diff(cuts))
            width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
            packed = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
            blobs = [bytes([width]) + packed[cuts[i] : cuts[i + 1]].tobytes() for i in full]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["slice", "blob"])

        for batch in batches:
            for low, high in pieces(batch.column(0)):
                words = scan(batch.column(0).slice(low, high - low), NOT_SPACE, False)
                held.append(_windows(words, n)[1] >> np.uint64(64 - cell_bits))
                if sum(map(len, held)) >= SKETCH_AT_ONCE:
                    yield send()
        if held:
            yield send()

    def unpack(blob: bytes) -> np.ndarray:
        width = blob[0]
        out = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
        out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
        return out.reshape(-1).view("<u8")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(part: int, blobs: list[bytes]) -> pa.RecordBatch:
            at = np.sort(np.concatenate([unpack(b).cumsum(dtype=np.uint64) for b in blobs]))
            twice = np.unique(at[1:][at[1:] == at[:-1]]) | np.uint64(part << low_bits)
            return pa.RecordBatch.from_arrays([pa.array([twice.astype(np.int64)], pa.list_(pa.int64()))], ["cells"])

        part, blobs = None, []
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != part and blobs:
                    yield cells(part, blobs)
                    blobs = []
                part = s
                blobs.append(b)
        if blobs:
            yield cells(part, blobs)

    sketches = docs.select("text").mapInArrow(sketch, "slice int, blob binary")
    return sketches.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "cells array<bigint>")


def _probes(cells: np.ndarray, cell_bits: int, bitmap_bits: int) -> Iterator[np.ndarray]:
    """The two bits of the bitmap that stand for each cell, both in the chunk of its leading bits."""
    chunk_bits = min(bitmap_bits, CHUNK_BITS)
    chunk = (cells >> np.uint64(cell_bits - bitmap_bits + chunk_bits)).astype(np.int64) << chunk_bits
    for multiplier in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F):
        x = cells * np.uint64(multiplier)
        yield chunk | ((x ^ (x >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(64 - chunk_bits)).astype(np.int64)


def fold(cells: DataFrame, cell_bits: int, bitmap_bits: int) -> np.ndarray:
    """A bitmap with the bits of all cells in ``cells`` set.

    A slice of cells has chunks of the bitmap of its own, or a part of one, so
    that all tasks together send hardly more than the bitmap, which is the
    bound of what the driver holds.
    """
    chunk_bits = min(bitmap_bits, CHUNK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for bits in _probes(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.uint64), cell_bits, bitmap_bits):
                bits = np.unique(bits)
                cuts = np.searchsorted(bits >> chunk_bits, np.arange((1 << bitmap_bits - chunk_bits) + 1))
                for c in np.flatnonzero(np.diff(cuts)).tolist():
                    plane = planes.setdefault(c, np.zeros((1 << chunk_bits) // 8, np.uint8))
                    own = bits[cuts[c] : cuts[c + 1]] & (1 << chunk_bits) - 1
                    np.bitwise_or.at(plane, own >> 3, (1 << (own & 7)).astype(np.uint8))
        for c, plane in planes.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([plane.tobytes()], pa.binary())], ["chunk", "plane"])

    size = (1 << chunk_bits) // 8
    out = np.zeros(size << bitmap_bits - chunk_bits, np.uint8)
    for row in cells.mapInArrow(run, "chunk int, plane binary").toLocalIterator():
        out[row.chunk * size : (row.chunk + 1) * size] |= np.frombuffer(row.plane, np.uint8)
    return out


class _Seen:
    """Windows that a task has met repeatedly, with the least doc_id so far; at most SEEN of them, the last ones met."""

    def __init__(self) -> None:
        self.h1, self.h2, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def least(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The least of ``ids`` and what is known of each window (ascending by h1, h2); remembers those met before or ``often`` now."""
        at = np.minimum(np.searchsorted(self.h1, h1), max(0, len(self.h1) - 1))
        known = (self.h1[at] == h1) & (self.h2[at] == h2) if len(self.h1) else np.zeros(len(h1), bool)
        out = ids.copy()
        out[known] = np.minimum(ids[known], self.ids[at[known]])
        new = np.flatnonzero(known | often)[:SEEN]
        rest = np.ones(len(self.h1), bool)
        rest[at[known]] = False
        if len(new) + rest.sum() > SEEN:
            rest[:] = False
        merged = [np.concatenate(x) for x in ((self.h1[rest], h1[new]), (self.h2[rest], h2[new]), (self.ids[rest], out[new]))]
        order = np.argsort(merged[0], kind="stable")
        self.h1, self.h2, self.ids = (x[order] for x in merged)
        return out


def _candidates(docs: DataFrame, n: int, bitmap, cell_bits: int, bitmap_bits: int) -> DataFrame:
    """Rows for windows that are estimated repeated.

    Windows leave in parts of about HELD_WINDOWS, whatever an Arrow batch
    holds.  A window that a smaller doc_id of the same part has too, or one
    that the task remembers, is already known to go: such windows leave as
    spans of one row a text, with place -1.  Of the others one row a window and
    text leaves, with its first place in the text, and any others in ``more``.
    So a common window has about a row for each task, as long as it is
    remembered.  ``h2at`` packs 32 further hash bits and the place.  Rows leave
    in the order of the texts, so that the shuffle's codec sees equal ids
    together.
    """
    fields = pa.schema([("h1", pa.int64()), ("h2at", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("more", pa.binary())])

    def send(found: list[tuple[np.ndarray, ...]], ids_all: np.ndarray, marks_all: np.ndarray, seen: _Seen) -> Iterator[pa.RecordBatch]:
        h1, h2, row, at = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((at, row, ids_all[row], h2, h1))
        h1, h2, row, at = h1[order], h2[order], row[order], at[order]
        ids = ids_all[row]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        firsts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        often = np.diff(np.append(firsts, len(h1))) > 1
        least = seen.least(h1[firsts], h2[firsts], ids[firsts], often)[group] == ids
        gone = np.flatnonzero(~least)
        if len(gone):
            gone = gone[np.lexsort((at[gone], row[gone]))]
            yield _known(row[gone], at[gone], ids_all, marks_all, fields)
        # Of rows with the least doc_id, each text's places of a window share a row.
        keep = np.flatnonzero(least)
        if not len(keep):
            return
        head = np.ones(len(keep), bool)
        head[1:] = (group[keep][1:] != group[keep][:-1]) | (row[keep][1:] != row[keep][:-1])
        head_at = np.flatnonzero(head)
        size = np.diff(np.append(head_at, len(keep)))
        by_text = np.lexsort((at[keep[head_at]], row[keep[head_at]]))
        k, further = keep[head_at[by_text]], size[by_text] - 1
        ends = np.cumsum(further)
        places = np.arange(further.sum()) + np.repeat(head_at[by_text] + 1 - ends + further, further)
        data = at[keep[places]].astype(np.int32)
        offsets = np.append(0, 4 * ends).astype(np.int32)
        more = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(h1[k]), pa.array(h2[k] << 32 | at[k]), pa.array(ids[k]), pa.array(marks_all[row[k]]), more], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bitmap.value, _Seen()
        for batch in batches:
            ids_all, marks_all = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found: list[tuple[np.ndarray, ...]] = []
            for low, high in pieces(batch.column(2)):
                words = scan(batch.column(2).slice(low, high - low), NOT_SPACE, False)
                starts, h1, h2 = _windows(words, n)
                hit = np.arange(len(h1))
                for probe in _probes(h1 >> np.uint64(64 - cell_bits), cell_bits, bitmap_bits):
                    own = probe[hit]
                    hit = hit[(bits[own >> 3] >> (own & 7).astype(np.uint8) & 1).astype(bool)]
                if len(hit):
                    row = np.searchsorted(words.offsets, starts[hit], "right") - 1
                    found.append((h1[hit].view(np.int64), h2[hit].view(np.int64) >> 32, row + low, starts[hit] - words.offsets[row]))
                if sum(len(x[0]) for x in found) >= HELD_WINDOWS:
                    yield from send(found, ids_all, marks_all, seen)
            if found:
                yield from send(found, ids_all, marks_all, seen)

    return docs.mapInArrow(run, "h1 long, h2at long, id long, mark long, more binary")


def _known(row: np.ndarray, at: np.ndarray, ids: np.ndarray, marks: np.ndarray, fields: pa.Schema) -> pa.RecordBatch:
    """One row a text: its window starts (sorted) as runs of (first, number)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    firsts = np.flatnonzero(new)
    runs = np.stack([at[firsts], np.diff(np.append(firsts, len(row)))], axis=1).astype(np.int32)
    owner = row[firsts]
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    own, blobs = owner[cuts], [x.tobytes() for x in np.split(runs, cuts[1:])]
    # Their keys only spread them; the grouping ignores rows of this kind.
    key = (ids[own] * 2654435761 + own).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(own), 0xFFFFFFFF)), pa.array(ids[own]), pa.array(marks[own]), pa.array(blobs, pa.binary())], schema=fields)


def _starts(places: np.ndarray, more: list[bytes], runs: list[bytes]) -> np.ndarray:
    """Window starts of one text: single ones, further ones, and runs of (first, number)."""
    out = [places, *(np.frombuffer(x, np.int32) for x in more)]
    for x in runs:
        first, number = np.frombuffer(x, np.int32).reshape(-1, 2).astype(np.int64).T
        out.append(np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum()))
    return np.unique(np.concatenate([x.astype(np.int64) for x in out]))


def remove_repeated_passages(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of n words around it also starts in a document with
    a smaller doc_id.  Windows are judged on the input.  Needs doc_id and text;
    other columns are ignored.  Null, empty and blank texts have no words and
    keep an empty text; texts of fewer than n words keep all of them.  A null
    doc_id counts as larger than any other.  Rows of the same doc_id don't
    remove each other's words.  Window equality is that of 96 hash bits.
    """
    spark = docs.sparkSession
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    # A text is known by its doc_id, and by a hash of itself too only if a doc_id repeats: such hashes don't pack.
    repeated = not docs.groupBy(F.coalesce(own, F.lit(_LAST_ID)).alias("id")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    mark = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(_LAST_ID)).alias("id"), mark.alias("mark"), text.alias("text"))
    cell_bits, slice_bits, bitmap_bits = sketch_plan(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bitmap = spark.sparkContext.broadcast(fold(repeated_cells(rows, n, cell_bits, slice_bits), cell_bits, bitmap_bits))
    cands = _candidates(rows.select("id", "mark", "text"), n, bitmap, cell_bits, bitmap_bits)
    cands = cands.withColumn("h2", F.shiftright("h2at", 32)).withColumn("at", F.col("h2at").bitwiseAND(0xFFFFFFFF))
    known = F.col("at") == 0xFFFFFFFF
    first = F.min(F.when(~known, F.col("id"))).over(Window.partitionBy("h1", "h2"))
    gone = cands.withColumn("first", first).where(known | (F.col("first") < F.col("id")))
    per_text = gone.groupBy("id", "mark").agg(
        F.collect_list(F.when(~known, F.col("at").cast("int"))).alias("places"),
        F.collect_list(F.when(~known & (F.octet_length("more") > 0), F.col("more"))).alias("more"),
        F.collect_list(F.when(known, F.col("more"))).alias("runs"),
    )
    joined = rows.join(per_text, ["id", "mark"], "left").select("doc_id", "text", "places", "more", "runs")
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in pieces(whole.column(1)):
                batch = whole.slice(low, high - low)
                data, offsets = utf8(batch.column(1))
                at = offsets.tolist()
                texts, sizes, removed = [], [], []
                for i, places in enumerate(batch.column(2)):
                    words = data[at[i] : at[i + 1]].tobytes().split()
                    sizes.append(len(words))
                    if places.is_valid:
                        starts = _starts(places.values.to_numpy(zero_copy_only=False), batch.column(3)[i].as_py(), batch.column(4)[i].as_py())
                        stay = np.flatnonzero(~covered(starts, n, len(words))).tolist()
                        words = [words[j] for j in stay]
                    removed.append(sizes[-1] - len(words))
                    texts.append(b" ".join(words))
                shas = [hashlib.sha256(t).hexdigest() for t in texts]
                kept = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), kept], schema=fields)

    return joined.mapInArrow(rebuild, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
