"""Passage similarity against all pairs: copies, frequent terms, thresholds, and how few pairs are made."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import passages
from lexmill.operators.lexicon import passage_rows


def made(spark):
    rnd = random.Random(4)
    words = [f"x{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    weights = [1 / (i + 1) for i in range(len(words))]
    pool = [" ".join(rnd.choices(words, weights, k=rnd.randint(5, 14))) for _ in range(60)]
    texts = []
    for i in range(40):
        own = [rnd.choice(pool[:6]) if rnd.random() < 0.4 else rnd.choice(pool) for _ in range(rnd.randint(1, 6))]
        own += [own[0]] * (3 if i % 9 == 0 else 0)
        texts.append(". ".join(own) + ". ")
    texts += ["", "a b", ". ".join([pool[0]] * 40)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def all_pairs(docs):
    """{(id, idx, id2, idx2): (cosine, products by term)} by the definition."""
    bags = {}
    for r in passage_rows(docs).collect():
        bag = Counter(w for w in r.passage.lower().replace(".", " ").split() if len(w) > 2)
        if bag:
            bags[r.id, r.passage_idx] = bag
    df = Counter(t for b in bags.values() for t in b)
    units = {}
    for key, bag in bags.items():
        w = {t: n * (math.log((len(bags) + 1) / (df[t] + 1)) + 1) for t, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        units[key] = {t: x / norm for t, x in w.items()}
    out = {}
    for a in units:
        for b in units:
            if a[0] < b[0]:
                out[*a, *b] = sum(x * units[b].get(t, 0) for t, x in units[a].items())
    return out


@pytest.mark.parametrize("k,threshold", [(30, 0.08), (5, 0.08), (2500, 0.25), (100_000, 0.5)])
def test_best_pairs_are_those_of_all_pairs(spark, k, threshold):
    docs = made(spark)
    want = sorted((-math.floor(s * 1e4 + 0.5) / 1e4, *key) for key, s in all_pairs(docs).items() if s >= threshold)[:k]
    found = [(-r.similarity, r.id, r.passage_idx, r.id2, r.idx2) for r in passages.similar(docs, k, threshold).collect()]
    assert found == want


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.9])
@pytest.mark.parametrize("block", [3, 2000])
def test_prefixes_lose_no_pair(spark, threshold, block):
    docs = made(spark)
    found = passages.index(docs)
    place = {(r.id, r.passage_idx): r.cls for r in found.members.collect()}
    want = {tuple(sorted((place[k[:2]], place[k[2:]]))) for k, s in all_pairs(docs).items() if s >= threshold and place[k[:2]] != place[k[2:]]}
    got = {(r.a, r.b) for r in passages.similar_classes(found.classes, threshold, block).collect()}
    assert got >= want  # classes of one document alone may be in it too
    assert len(set(place.values())) == found.classes.count() < len(place)


def test_high_thresholds_make_few_pairs(spark):
    classes = passages.index(made(spark)).classes
    terms = classes.select("cls", F.explode("terms.term").alias("term"))
    plain = terms.join(terms.withColumnRenamed("cls", "b"), "term").where("cls < b").count()
    assert 0 < passages.candidate_pairs(classes, 0.9).count() < plain / 5


def test_shared_terms_are_the_heaviest(spark):
    docs = spark.createDataFrame([(1, "common words rare thing here again. "), (2, "common words rare thing there later. "), (3, "common words only stand here alone. ")], "id long, text string")
    r = passages.similar(docs).first()
    assert (r.id, r.id2) == (1, 2) and set(r.shared_terms) == {"common", "words", "rare", "thing"} and set(r.shared_terms[:2]) == {"rare", "thing"}


def test_no_passages(spark):
    assert passages.similar(spark.createDataFrame([(1, ""), (2, None)], "id long, text string")).collect() == []


def test_close_classes_are_those_of_all_pairs_and_few_others_meet(spark):
    import itertools
    import math
    import random

    r = random.Random(6)
    rows = []
    for i in range(160):
        # The same words, a few of them more often; some vectors with one heavy and many small shares.
        words = {f"w{j}": 30.0 + (r.random() if r.random() < 0.3 else 0) for j in range(i % 4, i % 4 + 6)} | {"all": 20.0}
        if i % 5 == 0:
            words = {"w0": 400.0, **{f"s{j}": 1.0 + (i % 3 == 0) * 0.2 for j in range(i % 10, 12)}}
        norm = math.sqrt(sum(x * x for x in words.values()))
        rows.append((f"c{i:03}", [(1 if t != "all" else 9, t, x / norm) for t, x in sorted(words.items())]))
    classes = spark.createDataFrame(rows, "cls string, terms array<struct<df:long,term:string,u:double>>")
    bags = {c: {t: u for _, t, u in ts} for c, ts in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(bags), 2) if sum(u * bags[b].get(t, 0) for t, u in bags[a].items()) >= 1 - 5e-5}
    found = [(x.a, x.b) for x in passages.similar_classes(classes, 1 - 5e-5).collect()]
    assert want and set(found) == want and len(found) == len(want)
    met, before = passages.close_pairs(classes, 1 - 5e-5).count(), passages.candidate_pairs(classes, 1 - 5e-5).count()
    assert met < before


def test_terms_are_cut_once_and_not_shuffled_for_their_df(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"Harvest number {i} brings grain and wine again. Winter days follow harvest days slowly here.") for i in range(40)], "id long, text string")
    want = sorted(map(tuple, passages.tfidf(passages.passage_terms(docs)).collect()))
    found = passages.tfidf(passages.passage_terms(docs), f"{tmp_path}/few")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [term" in plan and "SortMergeJoin" not in plan and "regexp_extract_all" not in plan
    columns = passages.tfidf(passages.passage_terms(docs)).columns
    assert want and sorted(map(tuple, found.select(*columns).collect())) == want
    monkeypatch.setattr(passages, "WORDS_SENT", 3)
    assert sorted(map(tuple, passages.tfidf(passages.passage_terms(docs), f"{tmp_path}/many").select(*columns).collect())) == want


def test_terms_are_shuffled_once_as_lines(spark, tmp_path):
    docs = made(spark)
    plain = passages.index(docs)
    found = passages.index(docs, path=str(tmp_path / "index"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(found.classes) == rows(plain.classes) and rows(found.members) == rows(plain.members)
    stored = spark.read.parquet(*map(str, (tmp_path / "index").glob("classes-*")))
    assert "u" not in stored.schema["w"].dataType.elementType.names  # weights are not kept
    plan = found.classes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InMemoryTableScan" not in plan
    assert [tuple(r) for r in passages.similar(docs, 40, 0.3, path=str(tmp_path / "all")).collect()] == [tuple(r) for r in passages.similar(docs, 40, 0.3).collect()]


def test_few_pairs_of_classes_are_laid_out(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0 - (i % 3) / 10, i // 2) for i in range(60)], "a string, b string, similarity double, begin long")
    found = [(r.similarity, r.begin) for r in passages._foremost(pairs, 7).collect()]
    assert sorted(found) == sorted((1.0, i // 2) for i in range(0, 60, 3) if i // 2 <= 9)
    assert passages._foremost(pairs, 100).count() == 60
