"""Iterative estimation: mixture weights, count models, skip models, word classes.

Per-iteration work is one distributed aggregate; the driver holds only parameters (weights per model, per
bucket, or per iteration's step).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.sequences import but_last, first_word, gram, last_word, shorter, suffix, to_log
from textloom.operators.discount import WittenBell
from textloom.operators.estimate import estimate
from textloom.operators.score import Model, context_length, lookup
from textloom.plans.session import cut
from textloom.schema import BOS, EOS


def best_mix(scored: DataFrame, columns: Sequence[str], start: Sequence[float] | None = None, precision: float = 1e-4, max_rounds: int = 100, weight: str | None = None) -> list[float]:
    """Mixture weights that maximise the likelihood of tokens with a probability column per model; tokens zero in all are left out."""
    k = len(columns)
    lam = list(start or [1.0 / k] * k)
    amount = F.col(weight) if weight else F.lit(1.0)
    rows = cut(scored.where(F.greatest(*[F.col(c) for c in columns]) > 0 if k > 1 else F.col(columns[0]) > 0).select(*columns, amount.alias("_n")))
    for _ in range(max_rounds):
        new = mix_step(rows, columns, lam)
        done = max(abs(a - b) for a, b in zip(new, lam, strict=True)) <= precision
        lam = new
        if done:
            break
    return lam


def mix_step(rows: DataFrame, columns: Sequence[str], lam: Sequence[float]) -> list[float]:
    parts = [F.lit(float(x)) * F.col(c) for x, c in zip(lam, columns, strict=True)]
    whole = sum(parts[1:], parts[0])
    got = rows.agg(*[F.sum(F.col("_n") * p / whole) for p in parts], F.sum("_n")).first()
    return [x / got[-1] for x in got[:-1]]


def sentence_mix(scored: DataFrame, columns: Sequence[str], sentence: Sequence[str], **options) -> list[float]:
    """Mixture weights over whole sentences: log probability columns are summed per sentence, then shifted by the best."""
    sums = scored.groupBy(*sentence).agg(*[F.sum(c).alias(c) for c in columns])
    top = F.greatest(*[F.col(c) for c in columns])
    probs = sums.select(*[F.when(top == float("-inf"), 0.0).otherwise(F.pow(F.lit(10.0), F.col(c) - top)).alias(c) for c in columns])
    return best_mix(probs, columns, **options)


# ---- count-based interpolation (Jelinek-Mercer) ----


def count_model_features(events: DataFrame, counts: DataFrame, order: int, buckets: int, modulus: int, v: int) -> DataFrame:
    """``r1..rN``: relative frequencies at each order; ``b1..bN``: buckets of the context counts (-1 unseen)."""
    out = events.withColumn("_len", context_length(F.col("ctx")))
    for n in range(1, order + 1):
        level = counts.where((F.col("ord") == n) & (F.col("w") != BOS))
        total = level.groupBy(F.col("ctx").alias(f"_tc{n}")).agg(F.sum("cnt").alias(f"_t{n}"))
        level = level.select(F.col("ctx").alias(f"_c{n}"), F.col("w").alias(f"_w{n}"), F.col("cnt").alias(f"_n{n}"))
        out = out.withColumn(f"_k{n}", F.when(F.col("_len") >= n - 1, suffix(F.col("ctx"), n - 1)))
        out = out.join(level, (F.col(f"_k{n}") == F.col(f"_c{n}")) & (F.col("w") == F.col(f"_w{n}")), "left").join(total, F.col(f"_k{n}") == F.col(f"_tc{n}"), "left")
        out = out.withColumn(f"r{n}", F.coalesce(F.col(f"_n{n}") / F.col(f"_t{n}"), F.lit(0.0)))
        out = out.withColumn(f"b{n}", F.coalesce(F.least(F.floor(F.col(f"_t{n}") / modulus), F.lit(buckets - 1)), F.lit(-1)).cast("int"))
    return out.select(*events.columns, F.lit(1.0 / v).alias("r0"), *[c for n in range(1, order + 1) for c in (f"r{n}", f"b{n}")])


def count_model_prob(order: int, lam: dict[tuple[int, int], float]) -> tuple[Column, list[Column]]:
    """The interpolated probability and each order's share of it."""
    p, shares = F.col("r0"), [F.col("r0")]
    for n in range(1, order + 1):
        weight = F.lit(0.0)
        for (o, b), value in lam.items():
            if o == n:
                weight = F.when(F.col(f"b{n}") == b, F.lit(float(value))).otherwise(weight)
        own = weight * F.col(f"r{n}")
        shares = [s * (1 - weight) for s in shares] + [own]
        p = (1 - weight) * p + own
    return p, shares


def fit_count_model(features: DataFrame, order: int, buckets: int, rounds: int = 20, delta: float = 1e-3) -> dict[tuple[int, int], float]:
    """Weights by bucket and order, by expectation maximisation on held-out events."""
    lam = {(n, b): 0.5 for n in range(1, order + 1) for b in range(buckets)}
    rows = cut(features)
    last = -math.inf
    for _ in range(rounds):
        p, shares = count_model_prob(order, lam)
        scored = rows.withColumn("_p", p)
        value = scored.where("_p > 0").agg(F.sum(F.log("_p"))).first()[0] or 0.0
        new = {}
        for n in range(1, order + 1):
            # mass that reaches order n: what n keeps and what it hands down
            reach = sum(shares[1 : n + 1], shares[0]) / F.col("_p")
            keep = shares[n] / F.col("_p")
            for r in scored.where(F.col(f"b{n}") >= 0).where("_p > 0").groupBy(F.col(f"b{n}").alias("b")).agg(F.sum(keep).alias("k"), F.sum(reach).alias("r")).collect():
                if r["r"]:
                    new[(n, r["b"])] = r["k"] / r["r"]
        lam |= new
        if value - last < delta * abs(value):
            break
        last = value
    return lam


# ---- skip model ----


def fit_skip(counts: DataFrame, order: int, rounds: int = 5, start: float = 0.5, delta: float = 1e-3) -> tuple[Model, DataFrame]:
    """A skip model by EM from counts of one order more: contexts used whole or without their last word."""
    full = cut(counts.where((F.col("ord") == order + 1) & (F.col("w") != BOS)).select("ctx", "w", F.col("cnt").cast("double").alias("cnt")))
    methods = {n: WittenBell() for n in range(1, order + 1)}
    model = estimate(counts.where(F.col("ord") <= order), order, methods)
    skip = cut(full.select(last_word(F.col("ctx")).alias("w")).distinct().withColumn("p", F.lit(start)))
    last = -math.inf
    for _ in range(rounds):
        whole = full.select(F.col("ctx").alias("_c"), shorter(F.col("ctx")).alias("ctx"), "w", "cnt")
        whole = cut(lookup(whole, model, "_a").withColumn("_last", last_word(F.col("_c"))))  # the next lookup reads it twice
        moved = lookup(whole.withColumn("_own", F.col("ctx")).withColumn("ctx", but_last(F.col("_c"))), model, "_b")
        rate = skip.select(F.col("w").alias("_s"), F.col("p").alias("_q"))
        rows = moved.join(rate, F.col("_last") == F.col("_s"))
        a, b = (1 - F.col("_q")) * F.pow(F.lit(10.0), F.col("_alogp")), F.col("_q") * F.pow(F.lit(10.0), F.col("_blogp"))
        rows = cut(rows.withColumn("_tot", a + b).withColumn("_post", F.when(a + b > 0, b / (a + b)).otherwise(0.5)))
        value = rows.where("_tot > 0").agg(F.sum(F.col("cnt") * F.log("_tot"))).first()[0]
        skip = cut(rows.groupBy(F.col("_last").alias("w")).agg((F.sum(F.col("cnt") * F.col("_post")) / F.sum("cnt")).alias("p")))
        soft = rows.select(F.col("_own").alias("ctx"), "w", (F.col("cnt") * (1 - F.col("_post"))).alias("cnt")).unionByName(rows.select("ctx", "w", (F.col("cnt") * F.col("_post")).alias("cnt")))
        top = soft.groupBy("ctx", "w").agg(F.sum("cnt").alias("cnt")).where("cnt > 0").select(F.lit(order).alias("ord"), "ctx", "w", "cnt")
        top = top.where(F.size(F.split("ctx", " ")) == order - 1) if order > 1 else top
        soft_counts = counts.where(F.col("ord") < order).select("ord", "ctx", "w", F.col("cnt").cast("double").alias("cnt")).unionByName(top)
        model = estimate(soft_counts, order, methods)
        if value - last < delta * abs(value):
            break
        last = value
    return model, skip


# ---- word classes ----


class ClassMerger:
    """Greedy merging by least loss of bigram mutual information: words enter one by one, one best merge follows each.

    Held are the counts between at most ``classes + 1`` classes and four bytes a word: the word it was merged into.
    """

    def __init__(self, classes: int):
        self.classes, self.counts = classes, np.zeros((0, 0))
        self.parent = np.zeros(1024, np.int32)
        self.size = 0
        self.heads: list[int] = []
        self.slots: dict[int, int] = {}

    def slot(self, word: int) -> int:
        head = word
        while self.parent[head] != head:
            head = int(self.parent[head])
        while self.parent[word] != head:
            self.parent[word], word = head, int(self.parent[word])
        return self.slots[head]

    def add(self, pairs: Iterable[tuple[int, int, float]]) -> None:
        """The next word, with the counts of its bigrams with itself and with earlier words, as places in the order of words."""
        if self.size == len(self.parent):
            self.parent = np.concatenate([self.parent, np.zeros_like(self.parent)])
        self.parent[self.size] = self.size
        self.slots[self.size] = len(self.heads)
        self.heads.append(self.size)
        self.size += 1
        self.counts = np.pad(self.counts, (0, 1))
        for first, second, n in pairs:
            self.counts[self.slot(first), self.slot(second)] += n
        if len(self.heads) > self.classes:
            a, b = self.best()
            n = self.counts
            n[a] += n[b]
            n[:, a] += n[:, b]
            self.counts = np.delete(np.delete(n, b, 0), b, 1)
            self.parent[self.heads[b]] = self.heads[a]
            del self.heads[b]
            self.slots = {h: i for i, h in enumerate(self.heads)}

    def best(self) -> tuple[int, int]:
        """The pair of classes whose merging loses least, the first of equals."""
        n, k = self.counts, len(self.heads)
        plog = lambda x: x * np.log(np.where(x > 0, x, 1.0))
        cells, left, right, own = plog(n), n.sum(1), n.sum(0), np.diag(n)
        rows, cols, sides = cells.sum(1), cells.sum(0), plog(left) + plog(right)
        least, pick = math.inf, (0, 1)
        step = max(1, 2**22 // (k * k))
        for at in range(0, k, step):
            a = slice(at, at + step)
            kept = plog(n[a, None, :] + n[None, :, :]).sum(2) - rows[a, None] - rows[None, :]
            kept += plog(n.T[a, None, :] + n.T[None, :, :]).sum(2) - cols[a, None] - cols[None, :]
            # the four cells where the two classes meet are in rows and in columns
            ab, ba, aa, bb = n[a], n.T[a], own[a, None], own[None, :]
            kept += plog(aa + ab + ba + bb) - plog(aa + ba) - plog(ab + bb) - plog(aa + ab) - plog(ba + bb)
            kept += plog(aa) + plog(ab) + plog(ba) + plog(bb)
            margins = plog(left[a, None] + left[None, :]) + plog(right[a, None] + right[None, :]) - sides[a, None] - sides[None, :]
            loss = np.where(np.arange(k)[None, :] > np.arange(k)[a, None], margins - kept, math.inf)
            i, j = divmod(int(np.argmin(loss)), k)
            if loss[i, j] < least - 1e-12:
                least, pick = float(loss[i, j]), (at + i, j)
        return pick

    def assignment(self) -> np.ndarray:
        return np.array([self.slot(i) for i in range(self.size)], np.int32)


def induce_classes(bigrams: DataFrame, classes: int) -> DataFrame:
    """``w``, ``class`` of every word, by :class:`ClassMerger` in order of frequency.

    Words are numbered and bigrams sorted by Spark; the driver reads the bigrams as a stream, each with the later of
    its two words, and never holds them or the words. The search is a sequence by definition, one word after another.
    """
    spark = bigrams.sparkSession
    words = cut(bigrams.where(~F.col("w").isin(BOS, EOS)).groupBy("w").agg(F.sum("cnt").alias("n")).orderBy(F.desc("n"), "w").select("w"))
    placed = words.select("w", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [(p, sum(n for _, n in sizes[:i]) - (p << 33)) for i, (p, _) in enumerate(sizes)]
    known = cut(placed.join(spark.createDataFrame(starts, "_p int, _s long"), "_p").select("w", (F.col("_m") + F.col("_s")).alias("place")))
    inner = bigrams.join(known.withColumnRenamed("place", "b"), "w").join(known.select(F.col("w").alias("ctx"), F.col("place").alias("a")), "ctx")
    pairs = cut(inner.select(F.greatest("a", "b").alias("later"), "a", "b", "cnt").orderBy("later"))
    merger = ClassMerger(classes)
    for later, group in itertools.groupby(pairs.toLocalIterator(), key=lambda r: r["later"]):
        while merger.size < later:  # words that meet no word before them
            merger.add([])
        merger.add((r["a"], r["b"], float(r["cnt"])) for r in group)
    while merger.size < sum(n for _, n in sizes):
        merger.add([])
    found = pd.DataFrame({"place": np.arange(merger.size, dtype=np.int64), "class": merger.assignment()})
    return known.join(spark.createDataFrame(found, "place long, class int"), "place").select("w", "class")


def merge_classes(matrix: dict[int, dict[int, float]], words: Sequence[str], classes: int) -> dict[str, int]:
    """The classes of few words from their bigram counts, by place in ``words``."""
    merger = ClassMerger(classes)
    for i in range(len(words)):
        merger.add((a, b, n) for a, row in matrix.items() for b, n in row.items() if max(a, b) == i)
    return dict(zip(words, map(int, merger.assignment()), strict=True))


def class_definitions(counts: DataFrame, assignment: DataFrame) -> DataFrame:
    """``class``, ``w``, ``p`` = share of the word in its class; ``assignment`` has ``w`` and ``class``."""
    one = counts.where(F.col("ord") == 1).select("w", "cnt").join(assignment, "w")
    whole = one.groupBy("class").agg(F.sum("cnt").alias("_t"))
    return one.join(whole, "class").select("class", "w", (F.col("cnt") / F.col("_t")).alias("p"))


__all__ = ["best_mix", "first_word", "fit_count_model", "fit_skip", "gram", "induce_classes", "merge_classes", "mix_step", "sentence_mix"]
