"""Word alignment as one column expression.

The edit table is filled by anti-diagonals: the cells of one need only the two before it, so each is one ``transform`` over
the reference's places, and a fold over the diagonals keeps them with a back pointer per cell. A second fold
follows the pointers from the end. No Python runs, and a pair of sequences costs the product of their lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Costs of substitution, deletion and insertion in alignments.
SUBSTITUTION, DELETION, INSERTION = 4.0, 3.0, 3.0
CELL = "struct<c:double,m:int>"
STEP = "array<struct<kind:string,ref:string,hyp:string>>"
#: Moves in the order that equal costs take.
DIAGONAL, UP, LEFT = 0, 1, 2


def alignment(ref: Column, hyp: Column, substitution: Callable[[Column, Column], Column] | None = None, deletion: float = DELETION, insertion: float = INSERTION) -> Column:
    """Steps (``kind`` cor, sub, del or ins, ``ref``, ``hyp``) of the cheapest alignment; null sequences are empty.

    Of equal costs a match or substitution goes before a deletion before an insertion, seen from the end. ``substitution``
    gives the cost of two different words.
    """
    empty = F.array().cast("array<string>")
    # the sequences are named once, as the only element of an array, so that what they are made by runs once
    pair = F.array(F.struct(F.coalesce(ref, empty).alias("r"), F.coalesce(hyp, empty).alias("h")))
    return F.flatten(F.transform(pair, lambda p: _aligned(p["r"], p["h"], substitution, deletion, insertion)))


def _aligned(ref: Column, hyp: Column, substitution: Callable[[Column, Column], Column] | None, deletion: float, insertion: float) -> Column:
    n, m = F.size(ref), F.size(hyp)
    far = F.lit(float("inf"))
    places = F.sequence(F.lit(0), n)
    apart = substitution or (lambda r, h: F.lit(SUBSTITUTION))

    def cell(table: Column, d: Column, i: Column) -> Column:
        j = d - i
        one, two = F.get(table, d - 1), F.get(table, d - 2)
        cost = lambda diagonal, k: F.coalesce(F.when(k >= 0, F.get(diagonal, k)["c"]), far)
        r, h = F.get(ref, i - 1), F.get(hyp, j - 1)
        inside = (j >= 0) & (j <= m)
        options = [(cost(two, i - 1) + F.when(r == h, 0.0).otherwise(apart(r, h)), (i > 0) & (j > 0)), (cost(one, i - 1) + F.lit(deletion), i > 0), (cost(one, i) + F.lit(insertion), j > 0)]
        ranked = [F.struct(F.when(inside & may, c).otherwise(far).alias("c"), F.lit(k).alias("m")) for k, (c, may) in enumerate(options)]
        return F.least(*ranked).cast(CELL)

    start = F.array(F.transform(places, lambda i: F.struct(F.when(i == 0, 0.0).otherwise(far).alias("c"), F.lit(0).alias("m")))).cast(f"array<array<{CELL}>>")
    diagonals = F.filter(F.sequence(F.lit(0), n + m), lambda d: d > 0)
    table = F.aggregate(diagonals, start, lambda t, d: F.concat(t, F.array(F.transform(places, lambda i: cell(t, d, i)))))
    # the table is named once as well, so that it is filled once
    return F.flatten(F.transform(F.array(table), lambda t: _trace(t, ref, hyp, n, m)))


def _trace(table: Column, ref: Column, hyp: Column, n: Column, m: Column) -> Column:
    zero = F.struct(n.alias("i"), m.alias("j"), F.array().cast(STEP).alias("path"))

    def back(s: Column, _: Column) -> Column:
        i, j = s["i"], s["j"]
        move = F.get(F.get(table, i + j), i)["m"]
        r, h = F.get(ref, i - 1), F.get(hyp, j - 1)
        kind = F.when(move == UP, "del").when(move == LEFT, "ins").when(r == h, "cor").otherwise("sub")
        step = F.struct(kind.alias("kind"), F.when(move != LEFT, r).alias("ref"), F.when(move != UP, h).alias("hyp"))
        moved = F.struct((i - F.when(move != LEFT, 1).otherwise(0)).alias("i"), (j - F.when(move != UP, 1).otherwise(0)).alias("j"), F.concat(F.array(step), s["path"]).cast(STEP).alias("path"))
        return F.when(i + j > 0, moved).otherwise(s)

    return F.aggregate(F.filter(F.sequence(F.lit(0), n + m), lambda d: d > 0), zero, back, lambda s: s["path"])


def step_count(steps: Column, kind: str) -> Column:
    return F.size(F.filter(steps, lambda s: s["kind"] == kind)).cast("long")


# ---- tags ----

DEFAULT_TAG = "<default>"


def is_tag(word: Column) -> Column:
    return word.startswith("<") & word.endswith(">") & (F.length(word) > 1)


def with_default_tags(words: Column) -> Column:
    """Words in lower case, each followed by its tag: the one that follows, or ``<default>``; tags stay as they are."""
    low = F.transform(words, lambda w: F.when(is_tag(w), w).otherwise(F.lower(w)))
    last = lambda i: F.coalesce(is_tag(F.get(low, i + 1)), F.lit(False))
    return F.flatten(F.transform(low, lambda w, i: F.when(is_tag(w) | last(i), F.array(w)).otherwise(F.array(w, F.lit(DEFAULT_TAG)))))


def transferred_tags(ref: Column, hyp: Column) -> Column:
    """The hypothesis' words with the tags of the reference: a tag goes where its place is aligned with none of the hypothesis' own.

    Words align with words and tags with tags (a tag for another one costs 1, a word for a tag more than leaving both out).
    """
    cost = lambda r, h: F.when(is_tag(r) & is_tag(h), 1.0).when(is_tag(r) | is_tag(h), DELETION + INSERTION + 1).otherwise(SUBSTITUTION)
    steps = alignment(with_default_tags(ref), with_default_tags(hyp), cost)
    told = lambda w: w.isNotNull() & (w != DEFAULT_TAG)
    merged = F.transform(steps, lambda s: F.when(told(s["hyp"]), s["hyp"]).when(told(s["ref"]) & is_tag(s["ref"]), s["ref"]))
    return F.filter(merged, lambda w: w.isNotNull())
