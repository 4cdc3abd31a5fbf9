"""Ids and decoded bytes against the tiktoken library, and the model that is made from a vocabulary."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from conftest import SF_DIR

from lexmill.llm import byte_bpe
from lexmill.llm.queries import RANKS
from lexmill.llm.shared import table


@pytest.fixture(scope="module")
def content():
    with open(RANKS, "rb") as f:
        return f.read()


def reference(content):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.read_ranks(content), special_tokens={})


def test_all_documents(spark, content):
    docs, encoding = table(spark, SF_DIR, "documents"), reference(content)
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()))
    assert sorted(map(tuple, byte_bpe.round_trip(docs, content).collect())) == sorted(want)


def test_odd_texts_and_pretokens(content):
    codec, encoding, rnd = byte_bpe.Codec(content), reference(content), random.Random(2)
    texts = ["".join(rnd.choice("ab  \n\t\r'st12½é漢字́\x00\x1c\x85İßΣ😀　_,.<|endoftext|>") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    texts += ["x" * 100_000, " " * 5000, "na" * 40_000, "<|endoftext|>", "'s'S it's", "\n\n\n"]
    for text in texts:
        ids = [int(i) for part in codec.encode(text) for i in part]
        assert ids == encoding.encode_ordinary(text) and codec.text_of(np.array(ids, np.int32)) == text.encode()


def test_long_texts_are_cut_where_no_pretoken_is(content, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    codec, encoding, rnd = byte_bpe.Codec(content), reference(content), random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice("ab  \n\n\t\u3000\x85'st12é漢._") for _ in range(rnd.randint(0, 120)))
        assert [int(i) for part in codec.encode(text) for i in part] == encoding.encode_ordinary(text)


def test_ids_that_are_none(content):
    codec = byte_bpe.Codec(content)
    for ids in ([50256], [-1], [10**6]):
        with pytest.raises(ValueError, match="vocabulary"):
            codec.text_of(np.array(ids, np.int32))


def test_every_token_is_reached_by_merges(content):
    codec = byte_bpe.Codec(content)
    tokens = list(codec.ranks)
    found = codec.model.encode([byte_bpe.lettered(t) for t in tokens], num_threads=1)
    assert all(ids == [codec.ranks[t]] for t, ids in zip(tokens, found, strict=True))


def test_ranks_with_gaps(spark):
    ranks = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 601, b"abc": 700, b"bc": 650}
    content = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    codec, encoding = byte_bpe.Codec(content), reference(content)
    for text in ("abc abcbc", "cab bcabc", "zzabz"):
        ids = [int(i) for part in codec.encode(text) for i in part]
        assert ids == encoding.encode_ordinary(text) and codec.text_of(np.array(ids, np.int32)) == text.encode()
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.serialise({b"a": 0})


def test_edges(spark, content):
    schema = "doc_id long, text string, ids string, decoded string, n_tokens string"
    rows = [(None, None, "", "", ""), (1, "", "", "", ""), (2, "hi there", "x", "y", "z"), (2, "hi there", "x", "y", "z")]
    out = sorted(map(tuple, byte_bpe.round_trip(spark.createDataFrame(rows, schema), content).collect()), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r for r in out if r[0] != 2] == [(1, 0, empty, empty), (None, 0, empty, empty)]
    assert [r[3] for r in out if r[0] == 2] == [hashlib.sha256(b"hi there").hexdigest()] * 2
    assert byte_bpe.round_trip(spark.createDataFrame([], schema), content).collect() == []
