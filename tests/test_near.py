"""Estimation over n-grams dealt by the nearest word tells what the general way tells, and deals and writes far less."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.operators import near as N
from textloom.operators import score as R
from textloom.plans import counting as K
from textloom.plans import modelling as P
from textloom.plans.session import cut

D = "/root/testdata/sf0.001"
ALL = ["a", "a", "a", "b", "a", "c", "a", "d", "a"]  # every word, and in the end the sentence's end, stands behind "a"
ODD = [
    (0, "x", ALL), (0, "x", ["b", "c"]), (1, "y", ["a", "b", "c", "d"]), (1, None, ["<s>", "d", "a"]), (2, "y", ["c", "</s>"]), (2, "y", ["<s>"]), (2, "", ["d"]),
    (3, "x", ["a", "<s>", "b"]), (3, "y", ["a", "</s>", "b", "c"]), (3, "z", ["b", "<unk>", "c", "-pau-", "d"]), (3, "x", ["c", "__META__1", "a"]), (1, "x", ["a", "b", "c"]), (2, "x", ["b", "a", "b", "a"]),
]
LONGER = [(k % 4, "x", [*ALL, "d", "d", "d"]) for k in range(6)]  # trigrams found more than once
WIDE = [*ODD[:1], *ODD[:1], *LONGER[:2]]


def general_stats(sents):
    """The way over a written model and all events."""
    by_lang = cut(C.count_ngrams(sents, 2, by=["lang"], block="block"))
    model = E.train(by_lang.groupBy("ord", "ctx", "w").agg(F.sum("cnt").alias("cnt")), 2, "wb")
    scored = R.lookup(by_lang.where("ord = 2").select("lang", "ctx", "w", F.col("cnt").alias("n")), model, every=True)
    return R.text_stats(scored, ["lang"], weight=F.col("n"))


def stats_of(df):
    return {r["lang"]: (r["sentences"], r["words"], r["oovs"], r["zeroprobs"], round(r["logprob"], 9)) for r in df.collect()}


def moved(spark, run):
    """Bytes that a run shuffles and writes."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(x.shuffleWriteBytes() + x.outputBytes() for x in (stages.apply(k) for k in range(stages.size())))

    before = total()
    run()
    return total() - before


@pytest.fixture
def dealt(spark):
    return lambda rows: spark.createDataFrame(rows, "block int, lang string, words array<string>").repartition(4, "block")


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[1:4], ODD + LONGER])
def test_a_text_under_its_own_model_by_kind(dealt, rows):
    sents, asked = dealt(rows), []

    def model_for(events):
        asked.append({(r["ctx"], r["w"]) for r in events.collect()})
        return E.train(C.count_ngrams(sents, 2, block="block"), 2, "wb")

    assert stats_of(N.text_by_itself(sents, C.count_ngrams(sents, 1), "lang", model_for)) == stats_of(general_stats(sents))
    if rows is ODD:
        assert {("</s>", "b"), ("b", "<unk>"), ("a", "<s>")} <= asked[0] and ("b", "c") not in asked[0]
    if rows == ODD[:1]:
        assert {w for c, w in asked[0] if c == "a"} == {"a", "b", "c", "d", "</s>"}  # a wide context


def test_an_empty_text_by_kind(dealt):
    sents = dealt(ODD[:0])
    assert N.text_by_itself(sents, C.count_ngrams(sents, 1), "lang", None).count() == 0


def test_flagship_moves_less_than_half_of_the_general_way(spark):
    P.q_flagship(spark, D).count()
    new = moved(spark, lambda: P.q_flagship(spark, D).collect())
    assert 2 * new < moved(spark, lambda: general_stats(K.blocks(spark, D)).collect())


@pytest.mark.parametrize("rows", [ODD + LONGER, WIDE, ODD + ODD[1:]])
def test_trigrams_and_their_weights(dealt, rows):
    sents, asked = dealt(rows), []

    def model_for(events):
        asked.append({r["ctx"] for r in events.collect()})
        return E.train(C.count_ngrams(sents, 2, block="block"), 2, "wb")

    whole = E.train(C.count_ngrams(sents, 3, block="block"), 3, "wb")
    shown = lambda df: sorted((r["ctx"], r["w"], round(r["logp"], 9), round(r["lowlog"], 9), round(r["bow"], 9)) for r in df.collect())
    top = N.top_trigrams(sents, C.count_ngrams(sents, 1), model_for).cache()
    assert shown(top) == shown(whole.lower[3].select("ctx", "w", "logp", "lowlog", "bow")) and top.count()
    firsts = [r["ctx"] for r in top.where("one").collect()]
    assert sorted(firsts) == sorted({r["ctx"] for r in top.collect()})
    if rows == WIDE:
        assert asked == [{"a"}]  # all words stand behind "a", so single words decide its probabilities


def general_bows(spark, d):
    m = P.wb_model(spark, d, 3)
    return m.bows.where("len = 2").join(m.probs.where("ord = 3").select("ctx").distinct(), "ctx", "left_semi").select("ctx", (F.round("bow", 6) + 0.0).alias("bow"))


def test_trigram_bows_moves_less_than_half_of_the_general_way(spark):
    new, old = [], []
    P.q_trigram_bows(spark, D).count()
    least = moved(spark, lambda: new.extend(P.q_trigram_bows(spark, D).collect()))
    assert 2 * least < moved(spark, lambda: old.extend(general_bows(spark, D).collect()))
    assert sorted(map(tuple, new)) == sorted(map(tuple, old)) and new


def test_wb_trigram_model_moves_less_than_half_of_the_general_way(spark):
    new, old = [], []
    P.q_wb_trigram(spark, D).count()
    least = moved(spark, lambda: new.extend(P.q_wb_trigram(spark, D).collect()))
    assert 2 * least < moved(spark, lambda: old.extend(P.shown_probs(P.wb_model(spark, D, 3), 3).collect()))
    assert sorted(map(tuple, new)) == sorted(map(tuple, old)) and new


def test_large_texts_are_dealt_in_more_parts(spark, dealt):
    size = sum(len((r["text"] or "").encode()) for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect())
    assert K.parts_of(spark, D, size) == 4 and K.parts_of(spark, D, size // 9) >= 9
    assert N.dealt(dealt(ODD), 3, parts=9).rdd.getNumPartitions() == 9
    shown = lambda df: sorted((r["near"], r["first"], r["w"], r["n"]) for r in df.collect())
    assert shown(N.dealt(dealt(ODD), 3, parts=9)) == shown(N.dealt(dealt(ODD), 3))
