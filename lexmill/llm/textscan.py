"""Byte-level scanning of Arrow string columns with numpy.

A batch of texts is one UTF-8 buffer with document offsets.  Words, their
64-bit hashes and hashes of word windows come from whole-array operations, so
no Python object is made per word.  All word classes used here are decided by
single bytes: bytes of 0x80 and above either all belong to words or none do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are scanned in pieces of about so many bytes, which bounds the arrays.
PIECE_BYTES = 2 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_LONG_WORD = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of some texts: byte spans in ``data`` and, per text, the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # words of text i: offsets[i] to offsets[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes (eight zero bytes follow) and its offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    out = np.zeros(offs[-1] - offs[0] + 8, np.uint8)
    if data is not None:
        out[:-8] = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return out, offs - offs[0]


def pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``piece_bytes`` of text each, one row at least."""
    return ranges(pc.fill_null(pc.binary_length(column), 0), piece_bytes)


def ranges(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``, one row at least."""
    at = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(at):
        before = at[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(at, before + most, "right")))
        yield low, high
        low = high


def find_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``in_word``, none across two texts."""
    flags = in_word[data[:-8]]
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1] | edge[1:-1]
    last[:-1] &= ~flags[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def scan(column: pa.Array, in_word: np.ndarray, lower: bool) -> Words:
    data, offsets = utf8(column)
    return find_words(LOWER[data] if lower else data, offsets, in_word)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    eights = np.ndarray(len(words.data) - 7, np.dtype("<u8"), np.ascontiguousarray(words.data).data, strides=(1,))
    length = words.ends - words.starts
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = length.astype(np.uint64) * _MUL
    at, rest, live = words.starts, length, slice(None)
    for _ in range(_LONG_WORD // 8):
        x = (h[live] ^ (eights[at] & masks[np.minimum(rest, 8)])) * _MUL
        h[live] = (x ^ (x >> _SHIFT)) * _MUL2
        more = np.flatnonzero(rest > 8)
        if not len(more):
            break
        live = more if isinstance(live, slice) else live[more]
        at, rest = at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(length > _LONG_WORD):
        h[i] = np.uint64(xxhash.xxh64_intdigest(words.data[words.starts[i] : words.ends[i]].tobytes(), 7))
    return h ^ (h >> np.uint64(29))


def window_hashes(hashes: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, also of those across texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    q, count = np.uint64(multiplier | 1), len(hashes) - n + 1
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= q
        out += hashes[k : k + count]
    out ^= out >> _SHIFT
    out *= _MUL
    return out ^ (out >> np.uint64(29))


def window_starts(words: Words, n: int) -> np.ndarray:
    """Indices of the words at which n consecutive words of one text begin."""
    count = len(words.starts) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    end = np.repeat(words.offsets[1:], words.counts)[:count]
    return np.flatnonzero(np.arange(count) + n <= end)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(delta[:n]) > 0


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)
