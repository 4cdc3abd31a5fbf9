"""Edit-aware token counts.

A document's pre-tokens are kept in blocks; a segment tree over the blocks has
sums of characters and tokens.  An edit finds its block by descending the tree,
splits text again from a pre-token or two before the edit until a boundary
falls on one that was there before, counts only those pre-tokens and updates
the sums above the blocks it touched.  Pre-tokens are matched from left to
right without looking back, so from such a boundary on nothing can differ.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pattern that splits text before the merges of byte-level ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 128
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
EDITS = 3


class Counter(dict):
    """Tokens of a pre-token."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        super().__init__()
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = len(self.encoding._encode_single_piece(word))
        return n


class TokenTree:
    """Token counts of one text, kept up to date under edits."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.counted = text, counter, 0
        words = counter.pattern.findall(text)
        lengths, counts = list(map(len, words)), list(map(counter.__getitem__, words))
        self.blocks = [(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(words), BLOCK)] or [([], [])]
        self._build()

    def _build(self) -> None:
        size = 1 << (len(self.blocks) - 1).bit_length()
        self.size = size
        self.chars, self.tokens = [0] * 2 * size, [0] * 2 * size
        for i, (lengths, counts) in enumerate(self.blocks):
            self.chars[size + i], self.tokens[size + i] = sum(lengths), sum(counts)
        for i in range(size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(len(lengths) for lengths, _ in self.blocks)

    def _find(self, place: int) -> tuple[int, int]:
        """The block that holds a character and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            left = self.chars[2 * i]
            if place < begin + left or not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                i, begin = 2 * i + 1, begin + left
        return min(i - self.size, len(self.blocks) - 1), begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end by ``new``."""
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        # A pre-token's match may depend on two characters after it.
        block, at = self._find(max(0, start - 3))
        first_block, lengths = block, list(self.blocks[block][0])
        index = 0
        while index < len(lengths) and at + lengths[index] <= start - 3:
            at += lengths[index]
            index += 1
        keep = self.blocks[block][0][:index], self.blocks[block][1][:index]
        # Old boundaries are walked beside the new ones until two meet after the edit.
        old, fresh_lengths, fresh_counts, reached = at, [], [], at
        rest_lengths, rest_counts = self.blocks[block][0][index:], self.blocks[block][1][index:]
        used, met = 0, reached + shift == old + shift and reached >= end + shift and old >= end and start == end and not new
        for m in self.counter.pattern.finditer(text, at):
            if met:
                break
            fresh_lengths.append(m.end() - m.start())
            fresh_counts.append(self.counter[m.group()])
            reached = m.end()
            while old < reached - shift or old < end:
                if used == len(rest_lengths):
                    if block + 1 == len(self.blocks):
                        break
                    block += 1
                    rest_lengths, rest_counts, used = *self.blocks[block], 0
                    continue
                old += rest_lengths[used]
                used += 1
            met = old >= end and old == reached - shift and reached >= start + len(new)
        if not met and reached < len(text):
            raise AssertionError("the pattern left text unmatched")
        if not met:
            used = len(rest_lengths)
            block = len(self.blocks) - 1 if reached == len(text) else block
            rest_lengths, rest_counts = ([], []) if reached == len(text) else (rest_lengths, rest_counts)
            used = 0 if reached == len(text) else used
        self.counted += len(fresh_counts)
        all_lengths, all_counts = keep[0] + fresh_lengths + rest_lengths[used:], keep[1] + fresh_counts + rest_counts[used:]
        parts = [(all_lengths[i : i + BLOCK], all_counts[i : i + BLOCK]) for i in range(0, len(all_lengths), BLOCK)]
        touched = block - first_block + 1
        self.text = text
        if touched == 1 and len(all_lengths) <= 2 * BLOCK and (all_lengths or len(self.blocks) == 1):
            self.blocks[first_block] = (all_lengths, all_counts)
            i = self.size + first_block
            self.chars[i], self.tokens[i] = sum(all_lengths), sum(all_counts)
            while i > 1:
                i //= 2
                self._sum(i)
        else:
            self.blocks[first_block : block + 1] = parts
            self.blocks = self.blocks or [([], [])]
            self._build()


def edits_of(doc_id: int | None, text: str, number: int = EDITS) -> Iterator[tuple[float, int, str]]:
    """A document's edits, from its id alone: (place as a share of the text, characters to remove, new text)."""
    for k in range(number):
        h = xxhash.xxh64_intdigest(f"{doc_id}:{k}", 11)
        yield (h & 0xFFFF) / 0x10000, h >> 16 & 31, ("", " revised", "edit ", ".\n", "  ", "'s")[(h >> 24) % 6]


def apply_edit(text: str, share: float, remove: int, new: str) -> tuple[int, int, str]:
    start = int(share * len(text))
    return start, min(len(text), start + remove), new


def recount(docs: DataFrame, ranks: bytes, pattern: str = PATTERN, edits: int = EDITS) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_chars, n_pretokens, n_tokens, edited_chars, edited_tokens, n_recounted, edited_sha256.

    Counts are of the whole text, then of the text after the document's edits
    (see ``edits_of``); n_recounted is how many pre-tokens the edits had
    counted again.  A null text is empty and has no tokens; edits apply to it
    too.  Repeated rows repeat; other columns are ignored.  ``ranks`` is the
    vocabulary file's content, which is broadcast: some hundred KB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["doc_id", "n_chars", "n_pretokens", "n_tokens", "edited_chars", "edited_tokens", "n_recounted", "edited"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, pattern)
        for batch in batches:
            for low in range(0, len(batch), 256):
                part, rows = batch.slice(low, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    text = text.as_py()
                    tree = TokenTree(text, counter)
                    before = (doc_id, len(text), tree.n_pretokens, tree.n_tokens)
                    for share, remove, new in edits_of(doc_id, text, edits):
                        tree.edit(*apply_edit(tree.text, share, remove, new))
                    rows.append((*before, len(tree.text), tree.n_tokens, tree.counted, tree.text))
                kinds = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", edited string")
    return out.select(*names[:-1], F.sha2("edited", 256).alias("edited_sha256"))
