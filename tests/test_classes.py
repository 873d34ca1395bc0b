"""Multiword classes: matching in text and expansion of class models, against enumeration."""

import math
import random
from collections import defaultdict

import pytest

from textloom.operators import counts as C
from textloom.operators import estimate as E
from textloom.operators import rewrite as W
from textloom.operators import score as R
from textloom.operators.score import Model

SHAPE = "class string, p double, expansion array<string>"


def replaced(words, classes):
    table = {}
    for c, p, e in sorted(classes, key=lambda x: (-x[1], x[0])):
        table.setdefault(tuple(e), c)
    out, at, used = [], 0, []
    while at < len(words):
        size = max((n for n in range(1, len(words) - at + 1) if tuple(words[at : at + n]) in table), default=0)
        if size:
            used.append((at + 1, size, table[tuple(words[at : at + size])]))
        out.append(table[tuple(words[at : at + size])] if size else words[at])
        at += size or 1
    return out, used


CLASSES = [("AA", 0.5, ["a", "a"]), ("AB", 0.5, ["a", "b"]), ("LONG", 1.0, ["a", "b", "a", "c"]), ("B", 0.3, ["b"]), ("C", 0.6, ["b"]), ("BA", 1.0, ["b", "a"]), ("CITY", 0.9, ["new", "york"])]


def test_leftmost_longest_matches(spark):
    rnd = random.Random(3)
    sents = [(i, [rnd.choice("aabbc") for _ in range(rnd.randint(0, 40))]) for i in range(40)]
    sents += [(90, ["a"] * 70), (91, ["a", "b"] * 30 + ["a", "c"]), (92, "new york new new york york".split())]
    df = spark.createDataFrame(sents, "k int, words array<string>")
    classes = spark.createDataFrame(CLASSES, SHAPE)
    got = {r.k: r.words for r in C.class_replaced(df, classes, ["k"]).collect()}
    assert got == {k: replaced(ws, CLASSES)[0] for k, ws in sents if ws}
    spans = defaultdict(list)
    for r in C.class_spans(df, classes, ["k"]).collect():
        spans[r.k].append((r.at, r.size, r["class"]))
    assert {k: sorted(v) for k, v in spans.items()} == {k: replaced(ws, CLASSES)[1] for k, ws in sents if replaced(ws, CLASSES)[1]}


def test_expansion_probabilities_and_counts(spark):
    classes = spark.createDataFrame(CLASSES, SHAPE)
    df = spark.createDataFrame([(1, "a a a b new york b".split())], "k int, words array<string>")
    got = {(r["class"], tuple(r.expansion)): (r.n, r.p) for r in C.expansion_probabilities(C.class_spans(df, classes, ["k"]), classes).collect()}
    assert got["AA", ("a", "a")] == (1, 1.0) and got["C", ("b",)] == (1, 1.0) and got["B", ("b",)] == (0, 1.0) and len(got) == 7
    counts = spark.createDataFrame([(2, "new", "york", 3), (1, "", "b", 2), (3, "a new", "york", 1), (2, "q", "b", 5)], "ord int, ctx string, w string, cnt long")
    got = {(r.ord, r.ctx, r.w): r.cnt for r in C.class_replaced_counts(counts, classes).collect()}
    assert got == {(1, "", "CITY"): 3, (1, "", "C"): 2, (2, "a", "CITY"): 1, (2, "q", "C"): 5}


def test_no_classes(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "k int, words array<string>")
    assert C.class_replaced(df, spark.createDataFrame([], SHAPE), ["k"]).first().words == ["a", "b"]


def enumerate_expansion(probs, look, classes):
    """Joint probabilities of all windows by nested loops; ``look(w, ctx)`` is the class model's probability."""
    ways = defaultdict(list)
    for c, p, e in classes:
        ways[c].append((p, e))

    def chain(words):
        p = 1.0
        for j, w in enumerate(words):
            p *= look("</s>", ()) if j == 0 and w == "<s>" else look(w, tuple(words[:j]))
        return p

    joint = defaultdict(float)
    for (ctx, w), q in probs.items():
        if q <= 0:
            continue
        expanded = [(chain(ctx) * q, [], 0, 0)]
        for k, t in enumerate([*ctx, w]):
            expanded = [(p * x, [*ws, *e], len(e) if k == 0 else f, len(e)) for p, ws, f, _ in expanded for x, e in (ways[t] or [(1.0, [t])])]
        for p, ws, f, z in expanded:
            for a in range(f):
                for b in range(z):
                    if window := tuple(ws[a : len(ws) - b]):
                        joint[window] += p
    for g in joint:
        if (g[:-1], g[-1]) not in probs:
            joint[g] += chain(g)
    out = {}
    for g, p in joint.items():
        if g == ("<s>",):
            continue
        total = sum(x for h, x in joint.items() if h[:-1] == g[:-1] and h != ("<s>",))
        of = look("</s>", ()) if g[:-1] == ("<s>",) else joint.get(g[:-1], 0.0)
        out[g] = p / (max(total, of) if g[:-1] else total)
    return out


def test_expansion_equals_enumeration(spark, order=2, longest=3):
    # x is a word of two classes, "new york" an expansion of two words, w a word that is no class
    rnd = random.Random(order)
    sents = spark.createDataFrame([(i, [rnd.choice(["A", "B", "w", "A"]) for _ in range(rnd.randint(1, 5))]) for i in range(25)], "k int, words array<string>")
    m = E.train(C.count_ngrams(sents, order), order, "wb").persist()
    classes = [("A", 0.5, ["x"]), ("A", 0.3, ["y"]), ("A", 0.2, ["new", "york"]), ("B", 0.2, ["x"]), ("B", 0.8, ["z"])]
    probs = {(tuple(r.ctx.split()), r.w): 10**r.logp if r.logp > R.ZERO else 0.0 for r in m.probs.collect()}
    bows = {tuple(r.ctx.split()): 10**r.bow for r in m.bows.collect()}

    def look(w, ctx):
        ctx = ctx[-(order - 1) :] if order > 1 else ()
        if (ctx, w) in probs:
            return probs[ctx, w]
        return bows.get(ctx, 1.0) * look(w, ctx[1:]) if ctx else 0.0

    want = enumerate_expansion(probs, look, classes)
    made = W.expand_classes(m, spark.createDataFrame(classes, SHAPE), longest)
    got = {tuple([*r.ctx.split(), r.w]): 10**r.logp for r in made.probs.collect() if r.w != "<s>" and r.logp > R.ZERO}
    want = {g: p for g, p in want.items() if p > 0 and len(g) <= longest}
    assert made.order == longest and set(got) == set(want)
    by = defaultdict(list)
    for g in got:
        by[g[:-1]].append(g)
    for ctx, grams in by.items():
        scale = got[grams[0]] / want[grams[0]]
        # a context whose words have all the lower order's mass leaves nothing to back off to, and is scaled to one
        assert scale == pytest.approx(1, rel=1e-6) or ctx and sum(got[g] for g in grams) == pytest.approx(1, rel=1e-6)
        for g in grams:
            assert got[g] == pytest.approx(scale * want[g], rel=1e-6)
    sums = {}
    for r in R.prob_sums(spark.createDataFrame([("",), ("x",), ("new",), ("w",)], "ctx string"), made).collect():
        sums[r.ctx] = r.total
    assert all(abs(t - 1) < 1e-5 for t in sums.values())


def test_word_in_two_classes(spark):
    logs = lambda rows: [(len(c.split()) + 1, c, w, math.log10(p)) for c, w, p in rows]
    probs = spark.createDataFrame(logs([("", "A", 0.5), ("", "B", 0.3), ("", "</s>", 0.2), ("A", "B", 0.7), ("B", "A", 0.6)]), "ord int, ctx string, w string, logp double")
    m = Model(2, probs, spark.createDataFrame([], "len int, ctx string, bow double"))
    classes = spark.createDataFrame([("A", 0.5, ["x"]), ("A", 0.5, ["y"]), ("B", 0.2, ["x"]), ("B", 0.8, ["z"])], SHAPE)
    got = {(r.ctx, r.w): 10**r.logp for r in W.expand_classes(m, classes).probs.collect()}
    assert got["x", "z"] == pytest.approx(0.14 / 0.31) and got["x", "y"] == pytest.approx(0.018 / 0.31)
