"""Counts taken in blocks of text, and estimation on counts that lie by their last word."""

import pytest

from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.operators import prune
from textloom.plans import counting as P

D = "/root/testdata/sf0.001"
SENTS = [(0, ["a", "b", "a"]), (0, ["b", "c"]), (1, ["a", "b", "c", "d"]), (1, ["<s>", "d", "a"]), (2, ["c", "</s>"]), (2, ["<s>"]), (3, ["a", "<s>", "b"])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def dealt(spark):
    return spark.createDataFrame(SENTS, "block int, words array<string>").repartition(4, "block")


@pytest.mark.parametrize("order", [2, 3])
def test_counts_in_blocks_are_the_counts(dealt, order):
    rows = lambda df: {(r["ord"], r["ctx"], r["w"]): r["cnt"] for r in df.collect()}
    assert rows(C.count_ngrams(dealt, order, block="block")) == rows(C.count_ngrams(dealt, order))


def test_the_text_and_one_row_per_place_are_all_that_is_dealt(spark):
    assert plan(P.counted(spark, D, 3)).count("Exchange hashpartitioning") == 2
    # neither the counts for Kneser-Ney nor a word's own count beside its n-grams need another exchange
    assert plan(E.with_unigram(P.counted(spark, D, 3))).count("Exchange hashpartitioning") == 2
    assert plan(C.kn_counts(P.counted(spark, D, 3), 3)).count("Exchange hashpartitioning") == 2


def test_lines_are_not_split_for_a_condition(spark):
    assert "size(" not in plan(P.counted(spark, D, 2))


def test_a_trained_model_holds_the_lower_order(dealt):
    model = E.train(C.count_ngrams(dealt, 2), 2, "wb")
    rows = lambda df: {(r["ctx"], r["w"]): (round(r["logp"], 9), round(r["lowlog"], 9), round(r["bow"], 9)) for r in df.collect()}
    met = prune.with_lower(model, 2)
    assert "Join" not in plan(met)
    assert rows(met) == rows(prune.with_lower(type(model)(2, model.probs, model.bows), 2))
