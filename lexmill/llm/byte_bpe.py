"""Byte-level BPE encoding and decoding with a sentencepiece model made from a vocabulary of ranks.

The model is written straight from the vocabulary, in sentencepiece's file
format: one piece for each token, its bytes written as 256 letters, scored by
the negative rank, and no normalisation.  Merging the pair of the best score
first, the leftmost of equals, is then what byte-level BPE does by ranks.
Texts are split into pre-tokens by the vocabulary's pattern and each is encoded
alone; decoding puts each id's bytes in a row.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import pieces, ranges
from .token_counts import PATTERN

#: Bytes are written as the 256 letters from this code point on: none is white space or a control.
FIRST_LETTER = 0x100
#: Characters of a text that are encoded at once, at least, and ids that are decoded at once, about.
CHUNK, IDS = 1 << 18, 1 << 19
#: Pre-tokens of up to so many characters are remembered by a worker, in all up to so many characters.
SHORT, REMEMBERED = 64, 4 << 20
BEFORE_SPACE = regex.compile(r"(?<=\S)(?=\s)")

_LETTERS = {b: FIRST_LETTER + b for b in range(256)}


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: a line for each, the bytes in base64 and the rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def lettered(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTERS)


def _field(number: int, value: int | float | bytes) -> bytes:
    """A field of a protocol buffer: a whole number, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return bytes([number << 3 | 2]) + _varint(len(value)) + value
    return bytes([number << 3]) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


# Fixed values of the file format: numbers of fields, kinds of pieces and models.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _BPE = 3, 2
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the tokens by rank; the piece for what is unknown, which the format asks for, comes last and never occurs."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out += _field(_PIECES, _field(_PIECE, lettered(token).encode()) + _field(_SCORE, float(-rank)) + _field(_TYPE, _NORMAL))
    out += _field(_PIECES, _field(_PIECE, b"<unk>") + _field(_SCORE, 0.0) + _field(_TYPE, _UNKNOWN))
    out += _field(_TRAINER, _field(_MODEL_TYPE, _BPE))
    plain = _field(_NAME, b"identity") + _field(_DUMMY_PREFIX, 0) + _field(_EXTRA_SPACES, 0) + _field(_ESCAPE_SPACES, 0)
    return bytes(out + _field(_NORMALIZER, plain))


class Codec(dict):
    """Encodes and decodes whole texts; as a dict, the ids of short pre-tokens that were met, 4 bytes each."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        super().__init__()
        self.ranks = read_ranks(content)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.ids = np.array(sorted(self.ranks.values()), np.int32)  # a piece's number is its token's place by rank
        self.pattern = regex.compile(pattern)
        self.held = 0
        tokens = {rank: token for token, rank in self.ranks.items()}
        sizes = np.zeros(int(self.ids[-1]) + 1, np.int64)
        sizes[self.ids] = [len(tokens[r]) for r in self.ids.tolist()]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(tokens[r] for r in self.ids.tolist()), np.uint8)

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        # A pre-token that is a token as a whole has that token's id.
        rank = self.ranks.get(raw)
        ids = np.array([rank], np.int32) if rank is not None else self.ids[self.model.encode(lettered(raw), num_threads=1)]
        if len(word) <= SHORT:
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self[word] = ids.tobytes()
            self.held += len(word) + 8
        return ids.tobytes()

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The text's ids, some hundred thousand characters at a time.

        Texts are cut where white space begins: no pre-token crosses that, and
        none looks back.
        """
        low = 0
        while low < len(text):
            cut = BEFORE_SPACE.search(text, low + CHUNK) if len(text) - low > CHUNK else None
            high = cut.start() if cut else len(text)
            yield np.frombuffer(b"".join(map(self.__getitem__, self.pattern.findall(text, low, high) if low or cut else self.pattern.findall(text))), np.int32)
            low = high

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids in a row, and where each id's begin."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        sizes = self.sizes[ids]
        starts, out = np.cumsum(sizes) - sizes, [np.zeros(0, np.uint8)]
        for low in range(0, len(ids), IDS):
            own, n = slice(low, low + IDS), sizes[low : low + IDS]
            out.append(self.bytes[np.repeat(self.starts[ids[own]] - (starts[own] - starts[low]), n) + np.arange(n.sum())])
        return np.concatenate(out), starts

    def text_of(self, ids: np.ndarray) -> bytes:
        return self.decode(ids)[0].tobytes()


@lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> Codec:
    """A worker makes a vocabulary's codec once, not for every task."""
    return Codec(content, pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str = PATTERN) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, ids (array<int>).

    A null text is empty and has no ids.  Repeated rows repeat; doc_id may be
    null; other columns are ignored.  ``ranks`` is the vocabulary file's
    content, which is broadcast: some hundred KB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(shared.value, pattern)
            for low, high in pieces(batch.column(1)):
                part = batch.slice(low, high - low)
                found = [list(own.encode(text.as_py())) for text in part.column(1)]
                offsets = np.cumsum([0, *(sum(map(len, x)) for x in found)], dtype=np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *chain.from_iterable(found)])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of each list of ids (``into``, binary) instead of the list; a null list has none.

    An id that the vocabulary doesn't have is an error.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in rows.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(shared.value, PATTERN)
            sizes = pc.fill_null(pc.list_value_length(batch.column(len(kept))), 0)
            for low, high in ranges(sizes, IDS):
                part = batch.slice(low, high - low)
                lists = part.column(len(kept))
                data, starts = own.decode(lists.flatten().to_numpy(zero_copy_only=False))
                first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                offsets = np.append(starts, len(data))[first].astype(np.int32)
                found = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], [*kept, into])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.select(*kept, ids).mapInArrow(run, ", ".join([*fields, f"`{into}` binary"]))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str = PATTERN) -> DataFrame:
    """Encodes every text and decodes its ids: doc_id, n_tokens, ids_sha256, decoded_sha256, as ``encode`` and ``decode`` say."""
    rows = encode(docs, ranks, pattern)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    rows = decode(rows.select("doc_id", "n_tokens", digest.alias("ids_sha256"), "ids"), ranks)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
