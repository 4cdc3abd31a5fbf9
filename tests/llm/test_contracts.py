"""The contracts' queries against SQL or brute force over whole tables."""

import base64
import re
import zlib
from collections import Counter, defaultdict

import pytest
import tiktoken
import xxhash
from conftest import SF_DIR

from lexmill.llm import queries, sharding, token_counts
from lexmill.llm.shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in table(spark, SF_DIR, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(name, agree):
    agree(queries.QUERIES[name], queries.SQL[name])


def test_quality_figures(spark, documents):
    for r in queries.op3_quality_rules(spark, SF_DIR).collect():
        text = documents[r.doc_id].text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        repeated = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected
        assert not (failed and r.kept)


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, documents):
    fps = {d: brute_fingerprint(r.text) for d, r in documents.items()}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, SF_DIR).collect()}
    assert found == {d: (f"{f:016x}", find(d)) for d, f in fps.items()}


def test_mixture_meets_targets(spark, documents):
    rows = queries.op6_mixing(spark, SF_DIR).collect()
    sizes = {d: len(WORD.findall(r.text or "")) for d, r in documents.items()}
    assert {r.doc_id: r.size for r in rows} == sizes
    totals = defaultdict(int)
    for d, n in sizes.items():
        totals[documents[d].source] += n
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    open_, target, rest = {s: i % 3 + 1 for i, s in enumerate(sources)}, {}, sum(totals.values())
    while True:
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * totals[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * totals[s]
            rest -= target[s]
            del open_[s]
    target |= share
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        s = documents[r.doc_id].source
        assert r.source_size == totals[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in totals)
    assert sorted(map(repr, rows)) == sorted(map(repr, queries.op6_mixing(spark, SF_DIR).collect()))


def test_language_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize("limit", [2_000, 20_000, 1 << 30])
def test_shards_are_the_least_deep_that_fit(spark, documents, limit):
    rows = sharding.shards(table(spark, SF_DIR, "documents"), limit).collect()
    assert {r.doc_id: r.n_bytes for r in rows} == {d: len((x.text or "").encode()) for d, x in documents.items()}
    held = defaultdict(list)
    for r in rows:
        assert len(r.shard) == r.depth
        held[r.shard].append(r)
    sums = {s: sum(r.n_bytes for r in x) for s, x in held.items()}
    assert not any(a != b and b.startswith(a) for a in sums for b in sums)
    for s, rs in held.items():
        assert all(r.shard_bytes == sums[s] for r in rs)
        assert sums[s] <= limit or len(rs) == 1
        if s:
            assert sum(n for t, n in sums.items() if t.startswith(s[:-1])) > limit


def test_token_counts_are_those_of_whole_texts(spark, documents):
    with open(queries.RANKS, "rb") as f:
        ranks = f.read()
    merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    whole = tiktoken.Encoding("whole", pat_str=token_counts.PATTERN, mergeable_ranks=merges, special_tokens={})
    for r in queries.op10_token_counts(spark, SF_DIR).collect():
        text = documents[r.doc_id].text or ""
        assert r.n_tokens == len(whole.encode_ordinary(text))
        for edit in token_counts.edits_of(r.doc_id, text):
            start, end, new = token_counts.apply_edit(text, *edit)
            text = text[:start] + new + text[end:]
        assert (r.edited_chars, r.edited_tokens) == (len(text), len(whole.encode_ordinary(text)))
