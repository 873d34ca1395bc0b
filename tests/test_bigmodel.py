"""Estimation over bucketed counts: the model of the estimation in memory, and no exchange once counts are written."""

import random

import pytest

from textloom.operators import bigmodel as B
from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.plans.session import cut


@pytest.fixture(scope="module")
def counted(spark):
    rnd = random.Random(2)
    words = ["the", "cat", "dog", "sat", "ran", "on", "mat", "a"]
    sents = [(i, [rnd.choice(words[: rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 9))]) for i in range(150)]
    return cut(C.count_ngrams(spark.createDataFrame(sents, "k int, words array<string>"), 3))


@pytest.mark.parametrize(("method", "more"), [("wb", {"interpolate": True}), (["wb", "kn", "kn"], {"interpolate": True, "min_counts": {3: 2}}), ("gt", {"min_counts": {2: 3, 3: 2}})])
def test_same_model_as_in_memory(spark, counted, method, more):
    want, got = E.train(counted, 3, method, **more), B.train(counted, 3, method, buckets=4, **more)
    rows = lambda m: {(r.ord, r.ctx, r.w): r.logp for r in m.probs.collect()}
    a, b = rows(want), rows(got)
    assert set(a) == set(b)
    assert all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-9 for k in a)
    x, y = ({(r.len, r.ctx): r.bow for r in m.bows.collect()} for m in (want, got))
    assert {k for k in x if k in y} == set(y)
    assert all(x[k] == y[k] or abs(x[k] - y[k]) < 1e-9 for k in y)


def test_no_exchange_after_the_counts_are_written(spark, counted):
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        uni = cut(C.count_ngrams(spark.createDataFrame([(["a"],)], "words array<string>"), 1).selectExpr("w", "0.1D as p"))
        levels = {n: B.write_buckets(B.folded(B.level_rows(counted, n, uni), 1), 4) for n in (2, 3)}
        with B.joins_inside_buckets(spark):
            from textloom.operators.discount import WittenBell

            rows = B.write_buckets(B.discounted(B.with_lower(levels[2], 2, {}, {}), WittenBell(True), 9), 4, deal=False)
            bows = B.write_buckets(E.backoff_weights(rows, 9, B.KEYS), 4, deal=False)
            three = B.discounted(B.with_lower(levels[3], 3, {2: rows}, {2: bows}), WittenBell(True), 9)
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in (three, E.backoff_weights(three, 9, B.KEYS))]
        assert all("Exchange" not in p and "Bucketed: true" in p for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
