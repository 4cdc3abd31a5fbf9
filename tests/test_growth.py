"""What a task holds and what is shuffled must not grow faster than the corpus."""

import re
from collections import Counter

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from lexmill import queries
from lexmill.functions.text import apply_profile
from lexmill.operators import conllu, features, lexicon


def shuffles(df, capsys):
    """The hash exchanges of a plan that has not run."""
    capsys.readouterr()
    df.explain()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", capsys.readouterr().out)


def test_tasks_get_so_much_text_however_much_there_is(spark, monkeypatch):
    docs = queries.docs(spark, SF_DIR)
    monkeypatch.setattr(lexicon, "TASK_BYTES", 10_000)
    few = lexicon.tokens(docs.limit(50)).rdd.getNumPartitions()
    many = [df.rdd.getNumPartitions() for df in (lexicon.tokens(docs), lexicon.trigram_counts(docs), conllu.to_conllu(docs), conllu.parse_tokens(docs))]
    assert min(many) > 2 * few and len(set(many)) == 1


@pytest.mark.parametrize("name", ["collocations_top15", "head_lookup", "lemma_layers"])
def test_tokens_are_not_shuffled_again(name, spark, capsys):
    found = shuffles(queries.QUERIES[name](spark, SF_DIR), capsys)
    assert found and all(re.match(r"id#\d+L?, \d+$", x) for x in found)


@pytest.mark.parametrize("kind", ["words", "char3", "content", "function"])
def test_the_grid_of_features_is_not_shuffled(kind, spark, capsys):
    assert len(shuffles(features.feature_table(queries.docs(spark, SF_DIR), kind), capsys)) == 1


def test_documents_without_an_id_or_a_counted_word_have_their_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha beta"), (2, ""), (3, "of"), (None, "alpha gamma")], "id long, text string")
    rows = features.feature_table(docs, "content", 2).collect()
    assert {(r.id, r.feature, r.feature_rank, r.cnt) for r in rows} == {(i, f, k, n) for i, c in ((1, (2, 2)), (2, (0, 0)), (3, (0, 0)), (None, (0, 0))) for (k, f), n in zip(enumerate(("alpha", "beta")), c, strict=True)}


def test_heads_of_repeated_and_missing_numbers_are_those_of_a_join(spark):
    rows = [(1, 0, 1, "a", 0), (1, 0, 2, "b", 1), (1, 0, 2, "c", 1), (1, 0, 3, "d", 2), (1, 1, 1, "e", 9), (None, 0, 1, "f", 1), (2, 0, None, "g", None)]
    parsed = spark.createDataFrame(rows, "id long, sent int, token_id int, form string, head int")
    found = sorted(map(repr, (tuple(r) for r in conllu.heads(parsed).select("id", "sent", "token_id", "form", "head_form").collect())))
    assert found == sorted(map(repr, [(1, 0, 1, "a", None), (1, 0, 2, "b", "a"), (1, 0, 2, "c", "a"), (1, 0, 3, "d", "b"), (1, 0, 3, "d", "c"), (1, 1, 1, "e", None), (None, 0, 1, "f", None), (2, 0, None, "g", None)]))


def test_collocations_are_hashed_not_sorted(spark):
    plan = queries.QUERIES["collocations_top15"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_heads_carry_no_other_columns(spark):
    plan = queries.QUERIES["head_lookup"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search("upos|xpos|misc|features", plan)


def test_grams_are_never_rows_and_are_those_of_plain_code(spark):
    texts = [(1, "Ab  abab\nA😀b a"), (1, "ab"), (2, ""), (3, None), (None, "zzz zzz abab"), (4, "İab ab")]
    docs = spark.createDataFrame(texts, "id long, text string")
    table = features.feature_table(docs, "char3", 4)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan
    grams = {}
    for i, r in enumerate(docs.select("id", apply_profile(F.col("text"), one_line=True).alias("t")).collect()):
        grams[i] = (r.id, [r.t[k : k + 3] for k in range(len(r.t) - 2)])
    total, first = Counter(), {}
    for id_, own in grams.values():
        for at, g in enumerate(own):
            total[g] += 1
            first[g] = min(first.get(g, (9, 0, 0)), (id_ is not None, id_ or 0, at))
    top = sorted(total, key=lambda g: (-total[g], first[g]))[:4]
    counts, sizes = Counter(), Counter({id_: 0 for id_, _ in grams.values()})
    for id_, own in grams.values():
        if id_ is not None:
            counts.update((id_, g) for g in own)
            sizes[id_] += len(own)
    want = {(id_, g, k, counts[id_, g], counts[id_, g] * 10000.0 / max(1, sizes[id_])) for id_ in sizes for k, g in enumerate(top)}
    rows = table.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
