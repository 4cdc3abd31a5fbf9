"""Indexed contexts, the n-th smallest, labels of features, and runs that are written and read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import concordance, conllu, corpus, features
from lexmill.queries import shared_folder

TEXTS = ["The Nation of maſter and MASTER", "naTION OF İstanbul ıs", "none", "", None, "tion o", "ΣΊΣΥΦΟΣ σίσυφος σίσυφοσ", "K kelvin K", "Straße STRASSE", "aaa aaaa", "😀 nation of 😀", "ﬁnis µ μ"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    found = concordance.gram_index(docs, shared_folder(spark), 4)
    yield found
    found.drop()


@pytest.mark.parametrize("query", ["tion of", " Tion OF ", "master", "istanbul", "σίσυφος", "kelvin", "straße", "aa", "a", "aaa", "finis", "zzz", "", "😀 n", "is µ", "k k"])
def test_index_finds_what_the_scan_finds(docs, index, query):
    assert index.kwic(query, 5, 20).collect() == concordance.kwic(docs, query, 5, 20).collect()


def test_contexts_are_those_of_a_plain_search(docs):
    want = []
    for i, text in enumerate(TEXTS):
        for m in re.finditer("tion of", text or "", re.I):
            want.append((i, m.start(), text[max(0, m.start() - 4) : m.start()], m.group(), text[m.end() : m.end() + 4]))
    assert [tuple(r) for r in concordance.kwic(docs, "tion of", 4).collect()] == want
    assert [tuple(r) for r in concordance.kwic(docs, "tion of", 4, 2).collect()] == want[:2]


def test_only_candidates_are_read(spark, docs, index):
    assert {r.id for r in index.candidates("tion of").collect()} == {0, 1, 10}
    plan = index.kwic("tion of")._jdf.queryExecution().toString()
    assert "In(id, [0,1,10])" in plan  # the ids reach the scan
    top = re.search(r"TakeOrderedAndProject\([^\n]*", index.kwic("tion of")._jdf.queryExecution().executedPlan().toString()).group()
    assert "text" not in top


@pytest.mark.parametrize("values", [[5], [0, 0, 0, 7], [3, 1, 2], [2**31 - 1, 0, 65536, 65535, 256, 255], None])
def test_nth_smallest(spark, values):
    values = values or [random.Random(1).randrange(2**20) for _ in range(500)]
    table = spark.createDataFrame([(v,) for v in values], "v long")
    for n in {0, len(values) // 2, len(values) - 1}:
        assert features.nth_smallest(table, n) == sorted(values)[n]
    with pytest.raises(ValueError):
        features.nth_smallest(table, len(values))


def test_feature_count_without_documents(spark):
    assert features.auto_feature_count(spark.createDataFrame([], "id long, text string")).first().features == 40


def test_labels_depend_on_the_feature(spark):
    rows = [({"Aspect": "Imp"},), ({"Mood": "Imp"},), ({"Case": "Nom,Acc"},), ({"VerbForm": "Sup"},), ({"Degree": "Sup"},), ({"Case": "Gen"},), ({"X": "Perf"},), ({},), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "f map<string,string>").select(conllu.feature_label(F.col("f"))).collect()]
    assert found == ["aspetto: imperfettivo", "modo: imperativo", "caso: nominativo, accusativo", "forma verbale: supino", "grado: superlativo", "caso: genitivo", "X: Perf", "non specificata", "non specificata"]


def test_runs_are_written_and_read_with_nested_parameters(spark, docs):
    path = f"{shared_folder(spark)}/runs"
    nested = {"a": {"b": [1, 2]}, "list": ["x"], "n": 1.5}
    assert [corpus.log_run(spark, path, "pipeline", [1, 2], nested), corpus.log_run(spark, path, "diff", [3], {})] == [1, 2]
    log = corpus.run_log(spark, path)
    r = corpus.run_by_id(log, 1).select("kind", "document_ids", F.to_json("parameters").alias("p"), F.variant_get("parameters", "$.a.b[1]", "int").alias("x")).first()
    assert (r.kind, r.document_ids, r.x) == ("pipeline", [1, 2], 2) and r.p == '{"a":{"b":[1,2]},"list":["x"],"n":1.5}'
    titled = docs.withColumn("title", F.concat(F.lit("t"), "id"))
    assert {r.run_id: r.titles for r in corpus.run_history(log, titled).collect()} == {1: ["t1", "t2"], 2: ["t3"]}
    odd = spark.createDataFrame([(1, "k", "[1", "[1, {}]", ""), (2, "k", None, "{x", ""), (3, "k", "[]", None, "")], corpus.RUN_SCHEMA)
    assert [corpus.run_by_id(odd, i).select(F.to_json("parameters")).first()[0] for i in (1, 2, 3)] == ["[1,{}]", "{}", "{}"]


def test_lists_of_runs_are_few_rows_and_texts_without_an_id_are_found(spark):
    rows = [(i, f"word{i} Section of it") for i in range(500)] + [(None, "a SECTION OF none"), (7, "another section of seven")]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    found = concordance.gram_index(docs, shared_folder(spark), 4)
    assert spark.table(found.postings).where(F.col("gram").isin(concordance.grams("sec").tolist())).count() <= 8
    assert sorted(map(repr, found.kwic("tion of", limit=1000).collect())) == sorted(map(repr, concordance.kwic(docs, "tion of", limit=1000).collect()))
    assert found.candidates("tion of").count() == 500
    found.drop()
