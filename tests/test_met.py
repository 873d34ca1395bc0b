"""Several models' n-grams meet once, dealt by their context."""

import math

import pytest

from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.operators import prune
from textloom.operators import rewrite as W
from textloom.operators import score as R

A = [["a", "b", "a"], ["b", "c"], ["a", "b", "c", "d"], ["d", "a"], ["a", "b", "c"]]
B = [["a", "c"], ["c", "c", "b"], ["e", "a", "b"], ["a", "c", "b"]]


@pytest.fixture(params=[2, 3])
def models(spark, request):
    sents = lambda s: spark.createDataFrame([(x,) for x in s], "words array<string>")
    return [E.train(C.count_ngrams(sents(s), request.param, block=None), request.param, "wb", min_counts={2: 1, 3: 1}) for s in (A, B)]


def probs(df, n, cols=("logp",)):
    return {(r["ctx"], r["w"]): tuple(round(r[c], 9) if math.isfinite(r[c]) else r[c] for c in cols) for r in df.collect() if n is None or r["ord"] == n}


@pytest.mark.parametrize("n", [2, 3])
def test_met_is_every_lookup(models, n):
    if n > models[0].order:
        return
    got = R.met(models, n)
    keys = models[0].probs.where(f"ord = {n}").select("ctx", "w").union(models[1].probs.where(f"ord = {n}").select("ctx", "w")).distinct()
    for k, m in enumerate(models):
        want = probs(R.lookup(keys, m), None)
        assert probs(got, None, (f"own{k}",)) == want
        held = set(probs(m.probs, n))
        assert {(r["ctx"], r["w"]) for r in got.where(f"has{k}").collect()} == held


def test_a_mixture_and_a_rescored_model(models):
    n = models[0].order
    mixed = prune.mix(models, [0.6, 0.4])
    each = [probs(R.lookup(mixed.probs.select("ctx", "w"), m), None) for m in models]
    for key, (p,) in probs(mixed.probs, None).items():
        want = sum(x * 10 ** e[key][0] for x, e in zip((0.6, 0.4), each, strict=True))
        assert abs(10**p - want) < 1e-7
    sums = R.prob_sums(mixed.probs.where(f"ord = {n}").select("ctx"), mixed)
    assert all(abs(r["total"] - 1) < 1e-6 for r in sums.collect())
    other = W.rescored(models[0], models[1])
    assert probs(other.probs, n) == probs(R.lookup(models[0].probs.where(f"ord = {n}").select("ord", "ctx", "w"), models[1]), n)


def test_a_mixture_deals_its_rows_by_word_and_by_context_only(models):
    plan = R.met(models, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(ctx") == 1  # grouping and windows by context need no dealing of their own


def test_sums_over_the_vocabulary_look_nothing_up(models, monkeypatch):
    """They did look up every n-gram behind the contexts in every model, and wrote the pairs for it."""
    monkeypatch.setattr(R, "cut", lambda df: pytest.fail("a table was written"))
    contexts = models[0].probs.where("ord = 2").select("ctx")
    assert all(abs(r["total"] - 1) < 1e-6 for r in R.prob_sums(contexts, models[1]).collect())
    R.vocabulary_sums(contexts, models, [0.5, 0.5]).collect()
