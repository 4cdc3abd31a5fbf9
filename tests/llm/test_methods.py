"""What the operators' methods promise beyond the contracts' columns."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from conftest import SF_DIR

from lexmill.llm import decontam, langid, line_dedup, quality, sharding, substring, warc
from lexmill.llm.shared import shared_folder, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("seed", range(4))
def test_longest_matches_are_those_of_all_places(seed, monkeypatch):
    rng = random.Random(seed)
    draw = lambda n: [f"w{rng.randrange(4)}" for _ in range(n)]
    stem = [f"s{i}" for i in range(10)]
    items = [stem + ["x1", "x2"], stem + ["y1", "y2", "y3", "y4"]] + [draw(rng.randrange(0, 16)) for _ in range(12)]
    texts = [stem + ["y1", "y2", "y3", "y4"], stem + ["x1", "y1"], []] + [draw(rng.randrange(0, 60)) + ["zz"] + items[rng.randrange(len(items))] + draw(5) for _ in range(30)]
    block = decontam.Items([str(i) for i in range(len(items))], pa.array([" ".join(x) for x in items]), 10)
    found = block.search(pa.array([" ".join(x) for x in texts]))
    for words, (n, spans, ids, longest) in zip(texts, found, strict=True):
        hit, own, best = set(), set(), 0
        for p in range(len(words)):
            here = 0
            for i, item in enumerate(items):
                size = min(10, len(item))
                for k in range(len(item) - size + 1) if item else []:
                    if words[p : p + size] == item[k : k + size]:
                        hit |= set(range(p, p + size))
                        own.add(str(i))
                        here = 1
            if here:
                for item in items:
                    for k in range(len(item)):
                        m = 0
                        while k + m < len(item) and p + m < len(words) and words[p + m] == item[k + m]:
                            m += 1
                        best = max(best, m)
        inside = {w for a, b in zip(spans[::2], spans[1::2], strict=True) for w in range(a, b)}
        assert (n, inside, sorted(set(ids)), longest) == (len(words), hit, sorted(own), best)


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    docs, items = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    items = items.unionByName(items)
    whole = sorted(map(repr, decontam.contamination(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2_000)
    assert sorted(map(repr, decontam.contamination(docs, items).collect())) == whole


@pytest.mark.parametrize("limit", [500, 1000, 6000])
def test_pages_of_repeated_rows_fit(spark, limit):
    rows = [(1, "x" * 600)] * 10 + [(2, "y" * 50)] * 3 + [(None, None)] * 2 + [(3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sharding.shards(frame, limit).collect()
    pages = defaultdict(list)
    for r in out:
        pages[r.shard, r.page].append(r.n_bytes)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in rows)
    assert all(sum(p) <= limit or len(p) == 1 for p in pages.values())
    assert all(r.shard_bytes == sum(pages[r.shard, r.page]) for r in out)
    # No more pages than the rows need.
    assert sum(600 in p for p in pages.values()) == math.ceil(10 / max(1, limit // 600))


def test_written_shards_hold_all_rows_and_columns(spark):
    rows = [(1, "x" * 600, "s", 0)] * 5 + [(1, "other", None, 1), (None, None, "p", 2), (None, "a", "p", 3)] + [(i, f"text {i} " * 20, "q", i) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string, page int").repartition(3)
    path = f"{shared_folder(spark)}/out"
    assert sharding.write_shards(frame, path, 1000) == ["_shard", "_page", "seq"]
    back = sharding.read_shards(spark, path, "doc_id long, text string, shard string, page int, _shard string, _page int").collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in back))) == sorted(map(repr, rows))
    held = defaultdict(list)
    for r in back:
        held[r._shard, r._page].append(len(r.text or ""))
    assert all(sum(x) <= 1000 or len(x) == 1 for x in held.values())
    placed = Counter((r.doc_id, "b" + r.shard, r.page) for r in sharding.shards(frame, 1000).collect())
    assert placed == Counter((r.doc_id, r._shard, r._page) for r in back)


def archive(records, dictionary=b"WARC/1.1\r\nWARC-Type: response\r\n" * 4):
    codec = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(codec.compress(r) for r in records)


def good_record():
    digest = warc.base64.b32encode(warc.hashlib.sha1(b"payload").digest()).decode()
    return warc.record(7, "http://a/é", digest, 7, b"payload", None)


@pytest.mark.parametrize(
    "breach",
    [
        lambda r: archive([r])[:-3],
        lambda r: archive([r])[warc.struct.calcsize("<II") + 32 * 4 :],
        lambda r: b"",
        lambda r: archive([r])[:20],
        lambda r: archive([r]) + b"junk that is no frame",
        lambda r: archive([r.replace(b"Content-Length: 7", b"Content-Length: 8")]),
        lambda r: archive([r[:-1]]),
        lambda r: archive([r.replace(b"payload\r\n\r\n", b"payloaD\r\n\r\n")]),
        lambda r: archive([r.replace(b"WARC-Date", b"WARC-Dat")]),
        lambda r: archive([b"no record"]),
        lambda r: archive([r.replace(b"WARC-Type: response", b"WARC-Type: revisit")]),
    ],
)
def test_breaches_of_the_archive_format_are_told(breach):
    data = breach(good_record())
    with pytest.raises(warc.WarcError):
        for at, record in warc.frames(memoryview(data), "a"):
            warc.parse(record, f"a, byte {at}")


def test_records_of_other_writers_are_read(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nWARC-Date: 2001-01-01T00:00:00Z\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    other = good_record().replace(b"urn:lexmill:page:7", b"urn:uuid:3-4")
    (tmp_path / "x.warc.zst").write_bytes(archive([info, other, good_record()]))
    rows = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path), "*.warc.zst").collect()}
    assert {k: (r.page_id, r.record_type, bytes(r.payload)) for k, r in rows.items()} == {
        "urn:uuid:1-2": (None, "warcinfo", b"hello"),
        "urn:uuid:3-4": (None, "response", b"payload"),
        "urn:lexmill:page:7": (7, "response", b"payload"),
    }


def test_the_dictionary_sample_has_no_repeated_pages(spark):
    frame = spark.createDataFrame([(i, "same page " * 30) for i in range(3000)] + [(9000 + i, f"page {i} of its own") for i in range(20)], "page_id long, html string")
    assert warc.train_dictionary(frame) == warc.train_dictionary(frame.dropDuplicates(["html"]))


def test_the_labelled_sample_is_bounded(spark):
    rows = [(4, "one row again and again", "en")] * 5000 + [(i, f"ein Text {i}", "de") for i in range(2000)]
    found = Counter(r.lang for r in langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert found == {"en": 1, "de": langid.TEXTS_PER_LANGUAGE}


def test_predictions_are_those_of_the_plain_network():
    rng = np.random.default_rng(5)
    net = langid.train(rng.integers(97, 123, (40, langid.WINDOW)).astype(np.uint8), np.arange(40) % 3, ["a", "b", "c"])
    texts = ["", "short", "x" * 127, "é" * 64, "some words " * 40, "last " * 26]
    best, score = langid.predict(net, net.tables(), pa.array(texts))
    for text, b, s in zip(texts, best, score, strict=True):
        data = text.encode()
        probabilities = []
        for at in langid.cut(len(data)):
            window = np.frombuffer(data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
            e = net.embedding[window].astype(np.float64)
            hidden = []
            for f, bias in zip(net.filters, net.biases, strict=True):
                y = [sum(e[i + j] @ f[j] for j in range(len(f))) for i in range(langid.WINDOW - len(f) + 1)]
                hidden.append(np.max(y, axis=0) + bias)
            z = np.maximum(np.concatenate(hidden), 0) @ net.dense + net.dense_bias
            probabilities.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        mean = np.mean(probabilities, axis=0)
        assert mean.argmax() == b and abs(mean.max() - s) < 1e-4


def test_the_held_out_share_learns_nothing(spark):
    docs = table(spark, SF_DIR, "documents")
    ids = [r.doc_id for r in docs.where(langid.held_out()).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)
    changed = docs.selectExpr("doc_id", "text", f"CASE WHEN doc_id IN ({','.join(map(str, ids))}) THEN 'xx' ELSE lang END AS lang")
    assert langid.fit(changed).languages == langid.fit(docs).languages


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (17, 3)])
def test_batches_do_not_change_what_goes(spark, batches, fanout):
    docs = table(spark, SF_DIR, "documents")
    found = sorted(map(repr, line_dedup.drop_common_lines(docs, batches=batches, fanout=fanout).collect()))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    number = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")})
    for d, t in texts.items():
        kept = [x for x in t.split("\n") if not key(x) or number[key(x)] < 10]
        assert any(repr("\n".join(kept)) in f and f.startswith(f"Row(doc_id={d}, ") for f in found)


def test_runs_arrive_one_by_one_and_are_compacted(spark):
    rng = random.Random(3)
    batches = [Counter(rng.choices(range(30), k=25)) for _ in range(9)]
    with line_dedup.LineRuns(spark, shared_folder(spark), 5, buckets=2, fanout=2) as runs:
        known = Counter()
        for i, batch in enumerate(batches):
            runs.add(spark.createDataFrame([(h, h, n) for h, n in batch.items()], "h1 long, h2 long, n_docs long"))
            known += batch
            # A binary counter's carries.
            assert runs.compactions == (i + 1) - bin(i + 1).count("1")
            assert sum(map(len, runs.levels)) == bin(i + 1).count("1")
            merged = {r.h1: r.n_docs for r in runs.merged().collect()}
            assert {h for h, n in merged.items() if n >= 5} == {h for h, n in known.items() if n >= 5}
            assert all(merged[h] == n for h, n in known.items() if n < 5)
        names = list(runs.names)
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_windows_of_small_parts_are_removed_alike(spark, monkeypatch):
    docs = table(spark, SF_DIR, "documents")
    whole = sorted(map(repr, substring.remove_repeated_passages(docs).collect()))
    monkeypatch.setattr(substring, "HELD_WINDOWS", 500)
    monkeypatch.setattr(substring, "SEEN", 300)
    monkeypatch.setattr(substring, "pieces", lambda column: ((i, i + 1) for i in range(len(column))))
    assert sorted(map(repr, substring.remove_repeated_passages(docs.repartition(3)).collect())) == whole


def classes(text):
    words = WORD.findall(text)
    size = sum(map(len, words))
    own = [len(re.findall(p, text)) for p in quality.CLASSES.values()]
    return [*own, len(text) - size, len(text.encode()) - len(text), size - sum(own)]


def distance(p, q):
    both = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(both(a, b) + both(b, a) for a, b in zip(p, q, strict=True)) / 2))


def share(counts):
    return [x / sum(counts) if sum(counts) else 0.0 for x in counts]


def test_verdicts_are_those_of_the_plain_formula(spark):
    docs = [(r.doc_id, r.text or "", r.lang) for r in table(spark, SF_DIR, "documents").collect()]
    docs += [(5000, "tie b tie a " * 30, None), (5001, "", "en"), (5002, "solo " * 60, "zz")]
    pooled = defaultdict(lambda: ([0] * 7, Counter()))
    for _, text, lang in docs:
        for key in {lang, "\0all"} - {None}:
            counts, words = pooled[key]
            counts[:] = [a + b for a, b in zip(counts, classes(text), strict=True)]
            words.update(WORD.findall(text))
    refs = {}
    for key, (counts, words) in pooled.items():
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]
        refs[key] = share(counts), [w for w, _ in top], [n / sum(words.values()) for _, n in top]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.quality_report(frame).collect()}
    assert len(found) == len(docs)
    for d, text, lang in docs:
        shares, common, word_shares = refs[lang or "\0all"]
        words = WORD.findall(text)
        own = [words.count(w) for w in common]
        own = [x / len(words) if words else 0.0 for x in [*own, len(words) - sum(own)]]
        class_distance, word_distance = distance(share(classes(text)), shares), distance(own, [*word_shares, 1 - sum(word_shares)])
        r = found[d]
        assert abs(r.class_distance - class_distance) < 1e-6 and abs(r.word_distance - word_distance) < 1e-6, d
        odd = len(text) >= quality.MIN_CHARS_FOR_CLASSES and class_distance > quality.MAX_CLASS_DISTANCE
        odd |= len(words) >= quality.MIN_WORDS_FOR_COMMON and word_distance > quality.MAX_WORD_DISTANCE
        absent = distance([0.0] * len(common) + [1.0], [*word_shares, 1 - sum(word_shares)])
        odd |= lang is not None and len(words) >= quality.MIN_WORDS_FOR_ABSENCE and word_distance > quality.MAX_ABSENCE * absent
        assert r.kept == (not r.base_failed and not odd), d


def test_rows_that_repeat_are_documents_of_their_own(spark):
    """A third of all rows are one row; ids repeat and are null; each row loses what ``min_docs`` rows have."""
    rows = [(7, "Same line\nother\n\n x ")] * 20 + [(None, "same LINE\nown")] * 3 + [(i % 5, f"line {i}\n x\n") for i in range(36)] + [(7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    number = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    expected = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or number[key(x)] < 10]
        expected.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.drop_common_lines(docs, 10).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
