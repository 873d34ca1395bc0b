"""Factored counts taken in blocks, behind the parents' values that are asked for."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import factored as X


@pytest.fixture(scope="module")
def tokens(spark):
    # no speaker says every word: what a context that has seen all words leaves is rounding noise
    rows = [(i % 5, ["a", "b", None, "c"][i // 7 % 4], f"s{i % 3}", None if i % 10 == 0 else f"w{(i * i + i % 3 * 2) % 13}") for i in range(150)]
    return spark.createDataFrame(rows, "block int, h string, l string, w string").repartition(4, "block").cache()


def counts(df):
    return {(r["node"], r["h"], r["l"], r["w"]): r["cnt"] for r in df.collect()}


def test_counts_in_blocks_and_among_values(spark, tokens):
    spec = X.Spec("w", ("h", "l"))
    every = counts(X.node_counts(tokens, spec, spec.under(3)))
    assert counts(X.node_counts(tokens, spec, spec.under(3), "block")) == every
    asked = spark.createDataFrame([("a",), (None,), ("new",)], "h string")
    some = counts(X.node_counts(tokens, spec, spec.under(3), "block", {"h": asked}))
    assert some == {k: n for k, n in every.items() if not k[0] & 1 or k[1] in ("a", X.NULL)} and len(some) < len(every)
    with pytest.raises(ValueError):
        X.node_counts(tokens, X.Spec("w", ("h", "l"), {3: X.Node(method="kn")}), [0, 1, 2, 3], "block", {"h": asked})


def test_a_model_of_the_values_asked_for_scores_alike(spark, tokens):
    spec = X.Spec("w", ("h", "l"))
    events = tokens.select("l", "w").where("w is not null").distinct().crossJoin(spark.createDataFrame([("a",), ("new",)], "h string"))
    few = X.node_counts(tokens, spec, spec.under(3), "block", {"h": events.select("h")})
    rows = lambda m: sorted((r["h"], r["l"], r["w"], round(r["logp"], 12)) for r in m.score(events).collect())
    assert rows(X.estimate(tokens, spec, counts=few)) == rows(X.estimate(tokens, spec))


def test_a_node_is_written_once_and_nothing_is_counted_apart(spark, tokens, monkeypatch):
    spec, written = X.Spec("w", ("h", "l")), []
    monkeypatch.setattr(X, "cut", lambda df, keep=X.cut: written.append(df.columns) or keep(df))
    m = X.estimate(tokens, spec, counts=X.node_counts(tokens, spec, spec.under(3), "block").where(F.lit(True)))
    assert sum("p" in c and "_raw" in c for c in written) == 4  # each was written twice
    assert set(m.sizes) == {"w"}  # values are counted for the strategies that ask for them
