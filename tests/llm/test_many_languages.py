"""Every language of the labelled rows is learned, however many there are."""

import random

from lexmill.llm import langid, quality


def frame(spark, languages, texts):
    rng, rows = random.Random(3), []
    for i in range(languages):
        words = ["".join(rng.choices([chr(0x4E00 + 20 * i + k) for k in range(20)], k=rng.randint(2, 5))) for _ in range(50)]
        rows += [(len(rows) + k, " ".join(rng.choices(words, k=60)), f"l{i:03}") for k in range(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_all_languages_are_learned(spark):
    assert langid.fit(frame(spark, 70, 8)).languages == [f"l{i:03}" for i in range(70)]


def test_all_languages_have_histograms(spark):
    assert quality.language_references(frame(spark, 300, 1)).where("lang like 'l%'").count() == 300
