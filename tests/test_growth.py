"""What is written, read and shuffled grows with the text, and no faster."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.operators import score as R
from textloom.plans import counting
from textloom.plans.session import cut

SENTS = [["a", "b", "a"], ["b", "c"], ["a", "b", "c", "d"], ["<s>", "d", "a"], ["c", "</s>"], ["the"], ["a", "the", "of", "b"]]


@pytest.fixture
def sents(spark):
    return spark.createDataFrame([(s,) for s in SENTS], "words array<string>")


def bounded(words):
    return (["<s>"] if words[0] != "<s>" else []) + words + (["</s>"] if words[-1] != "</s>" else [])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_is_a_table_whose_columns_are_read_alone(spark):
    kept = cut(spark.range(10).select(F.col("id").alias("a"), F.lit("x").alias("b")))
    assert kept.dtypes == [("a", "bigint"), ("b", "string")]
    assert "ReadSchema: struct<a:bigint>" in plan(kept.select("a"))
    assert cut(kept.where("a < 0")).count() == 0


def test_counts_do_without_functions_over_nested_arrays(sents):
    got = C.count_ngrams(sents, 3)
    want = Counter()
    for s in map(bounded, SENTS):
        want.update((n, " ".join(s[j - n + 1 : j]), s[j]) for j in range(len(s)) for n in (1, 2, 3) if j + 1 >= n)
    assert {(r["ord"], r["ctx"], r["w"]): r["cnt"] for r in got.collect()} == want
    assert "lambda" not in plan(got)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stop_counts_touch_each_place_once(sents, order):
    want = Counter()
    for s in map(bounded, SENTS):
        for j, w in enumerate(s):
            near = [x for x in s[:j] if x not in ("the", "of")]
            want.update((n, " ".join(near[len(near) - n + 1 :]) if n > 1 else "", w) for n in range(1, min(order, len(near) + 1) + 1))
    got = C.stop_counts(sents, order, ["the", "of"])
    assert {(r["ord"], r["ctx"], r["w"]): r["cnt"] for r in got.collect()} == want


def test_stop_counts_of_a_long_line(spark):
    line = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), (i % 7).cast("string"))).alias("words"))
    assert C.stop_counts(line, 2, ["w0"]).agg(F.sum("cnt")).first()[0] == 2 * 60_002 - 1


@pytest.mark.parametrize("name", ["kn_counts", "recomputed_lower", "min_count_filter", "meta_counts"])
def test_the_text_is_read_once(spark, name):
    got = counting.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "documents" not in plan(got)  # the counts were written first


def test_a_trained_model_is_scanned_without_joins(sents):
    model = E.train(C.count_ngrams(sents, 3), 3, "wb", min_counts={2: 1, 3: 2})
    assert "Join" not in plan(model.probs) and "Exchange" not in plan(model.probs)
    totals = model.probs.where("ord = 2").groupBy("ctx").agg(F.sum(F.pow(F.lit(10.0), "logp")).alias("s")).collect()
    assert all(r["s"] < 1 + 1e-9 for r in totals)
    # contexts all of whose trigrams are rare keep their weight of one
    contexts = {r["ctx"] for r in C.count_ngrams(sents, 3).where("ord = 3 and ctx not like '%</s>'").collect()}
    assert {r["ctx"] for r in model.bows.where("len = 2").collect()} == contexts


def test_few_events_are_sent_to_the_model(sents):
    model = E.train(C.count_ngrams(sents, 2), 2, "wb")
    events = R.events_of(sents.limit(2), 2)
    one = {(r["ctx"], r["w"]): (round(r["logp"], 9), r["hit"]) for r in R.lookup(events, model).collect()}
    every = {(r["ctx"], r["w"]): (round(r["logp"], 9), r["hit"]) for r in R.lookup(events.distinct(), model, every=True).collect()}
    assert one == every
    assert plan(R.lookup(events, model)).count("LeftSemi") >= 3
