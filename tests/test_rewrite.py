"""Model transformations and the driver contract."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.operators import rewrite as W
from textloom.operators import score as R


@pytest.fixture(scope="module")
def model(spark):
    sents = spark.createDataFrame([(i, w.split()) for i, w in enumerate(["a b c", "a c", "b c a", "c a b", "a b"])], "doc_id int, words array<string>")
    return E.train(C.count_ngrams(sents, 2), 2, "wb").persist()


def total(model, ctx):
    return R.prob_sums(model.probs.sparkSession.createDataFrame([(ctx,)], "ctx string"), model).first()["total"]


def test_models_stay_normalised(spark, model):
    assert abs(total(W.rescored(model, model), "a") - 1) < 1e-6
    assert abs(total(W.with_least_backoff(model, 0.5), "a") - 1) < 1e-6
    assert abs(total(W.with_empty_sentence(model, 0.2), "<s>") - 1) < 1e-6
    changed = W.change_vocabulary(model, spark.createDataFrame([("a",), ("b",), ("new",)], "w string"))
    assert {r["w"] for r in changed.probs.where("ord = 1").collect()} == {"a", "b", "new", "<s>", "</s>"}
    p = {(r["ctx"], r["w"]): 10 ** r["logp"] for r in W.with_empty_sentence(model, 0.2).probs.collect()}
    q = {(r["ctx"], r["w"]): 10 ** r["logp"] for r in model.probs.collect()}
    # every word is seen after the start now, so what back-off no longer takes is scaled in
    assert math.isclose(p[("<s>", "</s>")] / p[("<s>", "a")], 0.2 / (0.8 * q[("<s>", "a")]))


def test_multiwords_follow_the_chain_rule(spark, model):
    got = {r["ctx"]: r["logp"] for r in W.multiword_model(model, spark.createDataFrame([("a_b",)], "w string")).collect()}
    p = {(r["ctx"], r["w"]): r["logp"] for r in model.probs.collect()}
    assert math.isclose(got["c"], p[("c", "a")] + p[("a", "b")]) and math.isclose(got[""], p[("", "a")] + p[("a", "b")])
    plain = spark.createDataFrame([(1, ["a", "b", "c"])], "i int, words array<string>")
    joined = spark.createDataFrame([(1, ["a_b", "c"])], "i int, words array<string>")
    scores = [W.multiword_scores(x, model, ["i"]).first()["logprob"] for x in (plain, joined)]
    assert math.isclose(*scores)


def test_sub_model_and_dummy_weights(model):
    assert W.sub_model(model, 1).probs.where("ord > 1").count() == 0
    assert W.with_dummy_weights(model).bows.where("ctx = '</s>' and bow = 0").count() == 1
    assert W.subset(model, model.probs.where("ord = 2").select("ctx", "w").where("ctx = 'a'")).probs.count() < model.probs.count()


def test_vocabulary_choice(spark):
    a, b = (spark.createDataFrame(x, "w string, cnt long") for x in ([("x", 5), ("y", 5)], [("z", 5), ("q", 1)]))
    target = spark.createDataFrame([("x", 10), ("y", 10), ("z", 1)], "w string, cnt long")
    assert W.rank_vocabulary({"a": a, "b": b}, target) == [("a", 20), ("b", 1)]
    weights, lam = W.select_vocabulary({"a": a, "b": b}, target)
    assert lam["a"] > lam["b"] and weights.count() == 4


def test_plain_text(spark):
    words = 'hi ,COMMA 50 %PERCENT /SLASH me @AT-SIGN x .POINT y .PERIOD "DOUBLE-QUOTE a "DOUBLE-QUOTE -HYPHEN --DASH ...ELLIPSIS &AMPERSAND'.split()
    rows = [(1, 1, words), (1, 2, ["<p>", "x"]), (1, 3, ['"DOUBLE-QUOTE', "b", *['"DOUBLE-QUOTE'] * 3]), (2, 1, ['"DOUBLE-QUOTE'])]
    got = {(r.doc_id, r.sent_id): r.words for r in W.plain_sentences(spark.createDataFrame(rows, "doc_id int, sent_id int, words array<string>")).collect()}
    assert got[1, 1] == "hi 50 percent slash me at x point y quote a and".split()
    assert got[1, 3] == ["b", "quote"] and got[2, 1] == ["quote"] and (1, 2) not in got


def test_lines_by_byte_order_mark(spark, tmp_path):
    for name, code, mark in (("a", "utf-16-le", b"\xff\xfe"), ("b", "utf-16-be", b"\xfe\xff"), ("c", "utf-8", b"\xef\xbb\xbf"), ("d", "utf-8", b"")):
        (tmp_path / f"{name}.txt").write_bytes(mark + f"h\u00e9 {name}\r\n\nzwei \u6f22\n".encode(code))
    (tmp_path / "e.txt").write_bytes(b"")
    from textloom.sources.text import read_marked_lines

    got = sorted((r.file[-5:], r.words) for r in read_marked_lines(spark, str(tmp_path)).collect())
    assert got == [(f"{n}.txt", w) for n in "abcd" for w in ([f"h\u00e9", n], ["zwei", "\u6f22"])]


def test_discount_files():
    from textloom.operators import discount as D

    gt = D.GoodTuring(False, 2, 3, {1: 0.5, 2: 0.75, 3: 1.0})
    assert D.write_parameters(gt) == "mincount 2\nmaxcount 3\ndiscount 1 0.5\ndiscount 2 0.75\ndiscount 3 1.0\n"
    assert D.read_parameters(D.write_parameters(gt), "gt") == gt
    for m, kind in ((D.KneserNey(True, 1, 0.3), "kn"), (D.ModifiedKneserNey(True, 2, 0.5, 1.0, 1.25), "mkn")):
        assert D.read_parameters(D.write_parameters(m), kind, True) == m
    for wrong in ("colour 1", "discount 1", "maxcount 2 3"):
        with pytest.raises(ValueError):
            D.read_parameters(wrong, "gt")
    with pytest.raises(ValueError):
        D.write_parameters(D.WittenBell())


def test_contract():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 100
