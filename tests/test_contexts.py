"""Models for given events count only what the events can ask for, and tell the same."""

import pytest

from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.operators import score as R
from textloom.plans import modelling as P

D = "/root/testdata/sf0.001"
SENTS = [(0, ["a", "b", "a"]), (0, ["b", "c"]), (1, ["a", "b", "c", "d"]), (1, ["<s>", "d", "a"]), (2, ["c", "</s>"]), (2, ["<s>"]), (3, ["a", "<s>", "b"]), (3, ["a", "b", "c"])]


@pytest.fixture
def dealt(spark):
    return spark.createDataFrame(SENTS, "block int, words array<string>").repartition(4, "block")


@pytest.fixture
def events(spark):
    return R.events_of(spark.createDataFrame([(["a", "b", "c"],), (["x", "a"],)], "words array<string>"), 3)


@pytest.mark.parametrize("order", [2, 3])
def test_counts_behind_contexts_are_all_counts_behind_them(dealt, events, order):
    contexts = R.contexts_of(events, order)
    asked = {r["ctx"] for r in contexts.collect()}
    assert {"<s>", "a", "b", "x"} <= asked and "d" not in asked
    every = {(r["ord"], r["ctx"], r["w"]): r["cnt"] for r in C.count_ngrams(dealt, order, block="block").collect()}
    some = {(r["ord"], r["ctx"], r["w"]): r["cnt"] for r in C.count_ngrams(dealt, order, block="block", contexts=contexts).collect()}
    assert some == {k: n for k, n in every.items() if k[0] == 1 or k[1] in asked} and len(some) < len(every)


@pytest.mark.parametrize("order", [2, 3])
def test_a_model_of_contexts_scores_alike(dealt, events, order):
    rows = lambda m: sorted((r["ctx"], r["w"], r["logp"], r["hit"]) for r in R.lookup(events, m).collect())
    whole = E.train(C.count_ngrams(dealt, order, block="block"), order, "wb")
    assert rows(E.train(C.count_ngrams(dealt, order, block="block", contexts=R.contexts_of(events, order)), order, "wb")) == rows(whole)


def test_many_contexts_ask_for_the_whole_model(events):
    assert R.contexts_of(events, 3, most=2) is None


def test_contexts_need_blocks(dealt, events):
    with pytest.raises(ValueError):
        C.count_ngrams(dealt, 2, contexts=R.contexts_of(events, 2))


def test_models_of_the_held_out_text_hold_its_contexts_only(spark):
    ev = P.held_out_events(spark, D)
    asked = {r["ctx"] for r in ev.select("ctx").distinct().collect()}
    for m in (P.wb_model(spark, D, events=ev), *P.two_models(spark, D, ev)):
        assert {r["ctx"] for r in m.probs.where("ord = 2").select("ctx").distinct().collect()} <= asked
