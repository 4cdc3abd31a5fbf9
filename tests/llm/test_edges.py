"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import corpus_pipeline
import pytest
from conftest import SF_DIR

from lexmill.llm import byte_bpe, decontam, langid, line_dedup, mixing, quality, sharding, simhash, substring, token_counts, warc
from lexmill.llm.queries import RANKS

CLASH = ["words", "key", "keys", "h", "bytes", "mark", "id", "kept", "prefix", "n", "fp", "common", "rank", "target", "position"]
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ROWS = [
    (None, None, None, None),
    (None, "a b c", "en", None),
    (1, "", None, "s"),
    (1, "", None, "s"),
    (2, None, "en", "s"),
    (3, " \n\t ", "de", "t"),
    (4, LONG, "en", "t"),
    (5, LONG, "en", None),
    (6, "one line\n" * 40, "xx", "t"),
    (7, "x" * 200_000, "en", "t"),
    (8, "üñí 日本 😀 " * 30, "en", "t"),
]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH) for r in rows], schema)


def items(spark, rows=((1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (None, None), (2, ""), (3, "b C"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def ranks():
    with open(RANKS, "rb") as f:
        return f.read()


OPERATORS = {
    "sharding": lambda s, d: sharding.shards(d, 10_000),
    "line_dedup": lambda s, d: line_dedup.drop_common_lines(d, 2),
    "quality": lambda s, d: quality.quality_report(d),
    "decontam": lambda s, d: decontam.contamination(d, items(s)),
    "no_items": lambda s, d: decontam.contamination(d, items(s, ())),
    "langid": lambda s, d: langid.identify(d),
    "mixing": lambda s, d: mixing.mixture_report(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "substring": lambda s, d: substring.remove_repeated_passages(d),
    "token_counts": lambda s, d: token_counts.recount(d, ranks()),
    "byte_bpe": lambda s, d: byte_bpe.round_trip(d, ranks()),
    "warc": lambda s, d: warc.round_trip(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", *CLASH)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_per_row(spark, name):
    out = OPERATORS[name](spark, frame(spark, ROWS)).collect()
    first = [r[0] for r in out]
    assert sorted(map(str, first)) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).collect() == []


def test_passages_go_from_the_larger_doc_id_alone(spark):
    out = {r.doc_id: r for r in substring.remove_repeated_passages(frame(spark, ROWS)).where("doc_id > 3").collect()}
    assert out[4].n_removed == 0 and out[5].n_removed == out[5].n_words == 60_000 and out[5].kept_text == ""


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_keep_all_columns(spark, rows):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = frame(spark, rows)
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert out.count() <= 3 * len(rows)


def test_one_document_of_each_group_stays(spark):
    out = simhash.drop_near_duplicates(frame(spark, ROWS)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [1, 4, 6, 7, 8]
