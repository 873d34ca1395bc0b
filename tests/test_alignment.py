"""Alignment expressions against the edit table written out."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import alignment as A
from textloom.kernels import align as K


def pairs(seed, n=40):
    rnd = random.Random(seed)
    words = lambda: [rnd.choice("aabcd") for _ in range(rnd.randint(0, 9))]
    return [(k, words(), words()) for k in range(n)] + [(90, [], []), (91, None, ["a"]), (92, ["a"], None), (93, list("abc") * 12, list("acb") * 11)]


def test_alignment_equals_the_table(spark):
    rows = pairs(1)
    df = spark.createDataFrame(rows, "k int, r array<string>, h array<string>")
    got = {x.k: [(s.kind, s.ref, s.hyp) for s in x.s] for x in df.select("k", A.alignment(F.col("r"), F.col("h")).alias("s")).collect()}
    for k, r, h in rows:
        r, h = r or [], h or []
        want = [(kind, r[i] if i >= 0 else None, h[j] if j >= 0 else None) for kind, i, j in K.align(r, h)[1]]
        assert got[k] == want


def test_costs_given(spark):
    df = spark.createDataFrame([(["a", "x"], ["b", "y"])], "r array<string>, h array<string>")
    cost = lambda r, h: F.when(r == "a", 1.0).otherwise(9.0)
    got = df.select(A.alignment(F.col("r"), F.col("h"), cost).alias("s")).first().s
    assert sorted(s.kind for s in got) == ["del", "ins", "sub"]


@pytest.mark.parametrize(
    ("ref", "hyp", "want"),
    [
        ("Hello <b> big world <c>", "hello big world", "hello <b> big world <c>"),
        ("hello <b> world", "hello <x> world", "hello <x> world"),
        ("one <a> two three <t>", "one three four", "one <a> three four <t>"),
        ("", "a b", "a b"),
        ("a <t>", "", "<t>"),
    ],
)
def test_tags_go_where_their_words_are(spark, ref, hyp, want):
    df = spark.createDataFrame([(ref.split(), hyp.split())], "r array<string>, h array<string>")
    assert " ".join(df.select(A.transferred_tags(F.col("r"), F.col("h")).alias("w")).first().w) == want


def transferred(ref, hyp):
    """Tags by the edit table written out."""
    tag = lambda w: w.startswith("<") and w.endswith(">")

    def prepared(words):
        out = []
        for k, w in enumerate(words):
            out.append(w if tag(w) else w.lower())
            if not tag(w) and not (k + 1 < len(words) and tag(words[k + 1])):
                out.append("<default>")
        return out

    r, h = prepared(ref), prepared(hyp)
    cost = {(0, 0): (0.0, None)}
    for i in range(len(r) + 1):
        for j in range(len(h) + 1):
            ways = []
            if i and j:
                x, y = r[i - 1], h[j - 1]
                ways.append((cost[i - 1, j - 1][0] + (0 if x == y else 1 if tag(x) and tag(y) else 7 if tag(x) or tag(y) else 4), 0))
            if i:
                ways.append((cost[i - 1, j][0] + 3, 1))
            if j:
                ways.append((cost[i, j - 1][0] + 3, 2))
            if ways:
                cost[i, j] = min(ways)
    out, i, j = [], len(r), len(h)
    while i or j:
        move = cost[i, j][1]
        x, y = r[i - 1] if move != 2 else None, h[j - 1] if move != 1 else None
        if y and y != "<default>":
            out.append(y)
        elif x and tag(x) and x != "<default>":
            out.append(x)
        i, j = i - (move != 2), j - (move != 1)
    return out[::-1]


def test_transfer_by_brute_force(spark):
    from textloom.operators import nbest as N

    rnd = random.Random(7)
    words = lambda: [rnd.choice(["a", "B", "c", "<t>", "<u>"]) for _ in range(rnd.randint(0, 7))]
    rows = [(f"u{k}", words(), words()) for k in range(40)]
    refs = spark.createDataFrame([(u, r) for u, r, _ in rows], "utt string, words array<string>")
    hyps = spark.createDataFrame([(u, 1, h) for u, _, h in rows], "utt string, rank int, words array<string>")
    got = {x.utt: x.words for x in N.tag_transfer(hyps, refs).collect()}
    assert got == {u: transferred(r, h) for u, r, h in rows}
