"""The pipeline's near-duplicate stage against brute force over all pairs of documents."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF_DIR

from lexmill.llm import nearcopies, simhash
from lexmill.llm.shared import table


def near_sets(rng, words, number, changes):
    """Copies of one text, each with some words of its own."""
    out = []
    for _ in range(number):
        own = list(words)
        for at in rng.sample(range(len(own)), changes):
            own[at] = f"own{rng.random()}"
        out.append(" ".join(own))
    return out


def brute_kept(texts):
    """The least doc_id of each component of pairs with a 5-word Jaccard similarity of at least 0.8."""
    sets = {}
    for d, t in texts.items():
        words = (t or "").lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in sets if find(d) == d}


def test_stage_finds_all_pairs_of_similarity_080(spark):
    rng, docs = random.Random(5), table(spark, SF_DIR, "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    at = 10_000
    for group in range(30):
        for t in near_sets(rng, [f"w{rng.randrange(900)}" for _ in range(200)], 3, group % 8):
            texts[at] = t
            at += 1
    # A group beyond _FEW, which the index compares.
    for t in near_sets(rng, [f"v{rng.randrange(900)}" for _ in range(200)], 40, 3):
        texts[at] = t
        at += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF_DIR).collect()}
    assert kept == brute_kept(texts)


@pytest.mark.parametrize("number", [5, 80])
def test_links_are_those_of_all_pairs(number):
    rng = np.random.default_rng(number)
    base = [rng.integers(0, 1 << 40, 100).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate((base[i % 4][rng.random(100) < 0.93], rng.integers(0, 1 << 40, 4).astype(np.uint64)))) for i in range(number)]
    expected = list(range(number))
    for a, b in combinations(range(number), 2):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((expected[a], expected[b]))
            expected = [low if e == high else e for e in expected]
    assert nearcopies.link(sets).tolist() == expected


@pytest.mark.parametrize("group_bytes", [1 << 24, 9_000])
def test_large_components_are_judged_in_blocks_alike(spark, group_bytes):
    rng, rows = random.Random(9), []
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    for center in near_sets(rng, base, 4, 12):
        for t in near_sets(rng, center.split(), 12, rng.randrange(1, 5)):
            rows.append((len(rows), t))
    sets = [nearcopies.shingles(t.encode()) for _, t in rows]
    frame = spark.createDataFrame([(nearcopies.set_key(s), i % 2, i, 7, t) for (i, t), s in zip(rows, sets, strict=True)], "key long, root long, id long, mark long, text string")
    found = {r.key: r["first"].id for r in nearcopies.judge_members(frame, group_bytes=group_bytes).collect()}
    for root in (0, 1):
        own = [i for i, _ in rows if i % 2 == root]
        labels = nearcopies.link([sets[i] for i in own])
        assert len(set(labels.tolist())) > 1
        assert [found[nearcopies.set_key(sets[i])] for i in own] == [own[x] for x in labels]


def test_rows_are_told_apart_by_content(spark):
    rng = random.Random(4)
    text, copy, other = (*near_sets(rng, [f"w{i}" for i in range(100)], 2, 1), " ".join(f"v{i}" for i in range(50)))
    rows = [(1, text, "a"), (1, other, "b"), (1, other, "b"), (1, other, "c"), (2, copy, "d"), (None, text, "e"), (None, "x y z", "f"), (3, None, "g"), (4, "", "h"), (None, " ", "i")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = nearcopies.drop_near_copies(frame)
    assert kept.columns == frame.columns
    found = sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect())))
    assert found == sorted(map(repr, [(1, text), (1, other), (None, "x y z"), (3, None)]))


def test_simhash_finds_copies_that_share_no_band(spark):
    # A passage of 65 words again and again, and eight words of each text's own: a similarity of 65 / 81, and the same fingerprint.
    rng = random.Random(3)
    for _ in range(20_000):
        passage = " ".join(f"w{rng.randrange(10**9)}" for _ in range(65))
        own = [" ".join(f"own{rng.randrange(10**9)}" for _ in range(8)) for _ in range(2)]
        a, b = (nearcopies.shingles(" ".join([passage, passage, x]).encode()) for x in own)
        if nearcopies.similar(a, b) and not set(nearcopies.bands(a)) & set(nearcopies.bands(b)):
            break
    texts = [" ".join([passage] * 20 + [x]) for x in own]
    one, other = (simhash.fingerprint(t.encode()) for t in texts)
    assert (one ^ other).bit_count() <= simhash.RADIUS
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert brute_kept(dict(enumerate(texts))) == {0}
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF_DIR).collect()] == [0]
