"""Listing rows, the audit of a project, and changes that are logged as runs."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import conllu, corpus
from lexmill.queries import shared_folder

SCHEMA = "id long, title string, author string, source_name string, is_demo int, structure_json string, text string, conllu string, conllu_source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "De aquis", "Frontinus", "frontino.pdf", 1, '[{"level": 1, "children": ["a"]}]', "Terram et  vineam", "", ""),
        (2, "Charta", None, None, 0, "{broken", None, " \n", None),
        (3, "FRONTIN", "x", "b.txt", None, None, "", "1\ta", "import"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_listing_has_all_metadata(docs):
    found = {r.id: r for r in corpus.serialized(docs).collect()}
    assert set(corpus.LISTED) <= set(found[1].asDict()) and "text" not in found[1].asDict()
    assert [(found[i].author, found[i].source_name, found[i].is_demo, found[i].has_syntax, found[i].period) for i in (1, 2, 3)] == [
        ("Frontinus", "frontino.pdf", True, False, ""), ("", "", False, False, ""), ("x", "b.txt", False, True, ""),
    ]
    assert [found[i].token_count for i in (1, 2, 3)] == [3, 0, 0]


def test_listing_with_texts_has_the_structure(docs):
    shown = corpus.serialized(docs, include_text=True).withColumn("child", F.try_variant_get("structure", "$[0].children[0]", "string"))
    found = {r.id: r for r in shown.withColumn("structure", F.to_json("structure")).collect()}
    assert found[1].child == "a" and found[1].normalized_text == "Terram et vineam"
    assert found[2].structure == found[3].structure == "[]"


def test_audit_of_a_project(docs):
    audit = lambda d, *rest: tuple(corpus.project_audit(d, *rest).first())
    assert audit(docs, "frontin", 7, 3, ("bad",)) == (3, 7, 3, ["bad"], True)
    assert audit(docs.where("id = 2")) == (1, 0, 0, [], False)
    assert audit(docs.where("id = 3").drop("source_name")) == (1, 0, 0, [], True)
    assert audit(docs.where("id = 1"), "FRONTINO") == (1, 0, 0, [], True) and audit(docs.limit(0)) == (0, 0, 0, [], False)


def test_one_document(docs):
    assert [r.title for r in corpus.by_id(docs, 2).collect()] == ["Charta"] and corpus.by_id(docs, 8).isEmpty()


def test_changes_and_parses_are_logged(spark, docs):
    path = f"{shared_folder(spark)}/runs"
    corpus.update_document(docs, 1, path, title="New")
    corpus.update_document(docs, 1, path, text=" Terram et  vineam ")
    corpus.update_document(docs, 2, path, text="text for none")
    conllu.parse_stored(docs, 1, "rules", path)
    with pytest.raises(ValueError):
        corpus.update_document(docs, 1, path, text=" ")
    with pytest.raises(ValueError):
        conllu.parse_stored(docs, 3, "rules", path)  # no token, so no sentence
    found = [(r.id, r.kind, r.document_ids, r.parameters) for r in corpus.run_log(spark, path).orderBy("id").collect()]
    assert found == [
        (1, "document_edit", "[1]", '{"text_changed": false}'), (2, "document_edit", "[1]", '{"text_changed": false}'),
        (3, "document_edit", "[2]", '{"text_changed": true}'), (4, "parser", "[1]", '{"parser": "rules", "source": "lemma rules"}'),
    ]
