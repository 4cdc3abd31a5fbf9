"""Scalar text functions on hand-made edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import normalize_whitespace, tokenize, trigrams
from lexmill.operators import lexicon

TEXTS = [None, "", " \n\n ", "a b\r\n\r\n c\td ", "Straße", "12a b² ⅷ x_y", "😀 beta", "ab", "a  \n b c"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def test_trigrams_are_those_of_the_one_line_text(docs):
    found = {r.id: r.g for r in docs.select("id", trigrams(F.col("text")).alias("g")).collect()}
    for i, text in enumerate(TEXTS):
        line = re.sub(r"\s+", " ", (text or "").lower().replace("ß", "ss")).strip()
        assert found[i] == [line[j : j + 3] for j in range(len(line) - 2) if line[j : j + 3].strip()]


def test_tokens_are_letters_and_numerics_but_no_digits(docs):
    found = {r.id: r.t for r in docs.select("id", tokenize(F.col("text")).alias("t")).collect()}
    assert found[5] == ["a", "b²", "ⅷ", "x", "y"] and found[4] == ["strasse"] and found[0] == found[2] == []


def test_paragraphs_survive_and_blanks_collapse(docs):
    found = {r.id: r.t for r in docs.select("id", normalize_whitespace(F.col("text")).alias("t")).collect()}
    assert found[3] == "a b\n\nc d" and found[2] == ""


def test_summary_of_blank_texts_divides_by_nothing(docs):
    found = {r.id: r for r in lexicon.summary(docs).collect()}
    assert len(found) == len(TEXTS) and found[2].token_count == 0 and found[2].ttr == 0
