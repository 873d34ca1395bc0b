"""Pruning, static mixtures and quantisation of back-off models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import gram, shorter, to_log
from textloom.operators.estimate import fill_contexts, renormalise, renormalised
from textloom.operators.score import ZERO, Model, context_log_prob, lookup, met
from textloom.plans.session import cut
from textloom.schema import EPSILON


def with_lower(model: Model, n: int) -> DataFrame:
    """N-grams of an order with ``p``, the lower order's log probability ``lowlog`` and their context's ``bow``."""
    if model.lower:  # estimation met them already
        return model.lower[n].where(F.col("logp") > ZERO).withColumn("p", F.pow(F.lit(10.0), F.col("logp")))
    level = model.probs.where((F.col("ord") == n) & (F.col("logp") > ZERO))
    keys = level.select("ord", F.col("ctx").alias("_full"), shorter(F.col("ctx")).alias("ctx"), "w", F.col("logp").alias("_own"))
    low = lookup(keys, Model(n - 1, model.probs.where(F.col("ord") < n), model.bows.where(F.col("len") < n - 1)), every=True)
    rows = low.select("ord", F.col("_full").alias("ctx"), "w", F.col("_own").alias("logp"), F.col("logp").alias("lowlog"))
    bows = model.bows.where(F.col("len") == n - 1).select("ctx", "bow")
    return rows.join(bows, "ctx", "left").withColumn("bow", F.coalesce("bow", F.lit(0.0))).withColumn("p", F.pow(F.lit(10.0), F.col("logp")))


def entropy_costs(model: Model, n: int, history: Model | None = None) -> DataFrame:
    """``change``: relative change of perplexity if the n-gram alone were dropped."""
    rows = with_lower(model, n)
    low = F.pow(F.lit(10.0), F.col("lowlog"))
    context = Window.partitionBy("ctx")  # the rows lie by context, from the join with its weight
    settle = lambda x: F.when(F.abs(x) < EPSILON, 0.0).otherwise(x)
    sums = rows.withColumns({"_num": settle(1 - F.sum("p").over(context)), "_den": settle(1 - F.sum(low).over(context))}).where("_num >= 0 and (_den > 0 or _num <= 3e-6)")
    contexts = context_log_prob(model.probs.where((F.col("ord") == n) & (F.col("logp") > ZERO)), history or model, (history or model).order)
    rows = sums.join(contexts, "ctx")
    new = F.log10(F.col("_num") + F.col("p")) - F.log10(F.col("_den") + low)
    moved = F.col("lowlog") + new - F.col("logp")
    stay = F.when(F.col("_num") == 0, F.lit(0.0)).otherwise(F.col("_num") * (new - F.col("bow")))
    entropy = -F.pow(F.lit(10.0), F.col("ctxlogp")) * (F.col("p") * moved + stay)
    return rows.select("ctx", "w", "logp", (F.pow(F.lit(10.0), entropy) - 1).alias("change"))


def _without(model: Model, n: int, drop: DataFrame) -> Model:
    keep = model.probs.where(F.col("ord") == n).join(drop.select("ctx", "w"), ["ctx", "w"], "left_anti").select("ord", "ctx", "w", "logp")
    return Model(model.order, cut(model.probs.where(F.col("ord") != n).unionByName(keep)), model.bows)


def _needed(model: Model, n: int) -> DataFrame:
    """Contexts of the next order, as n-grams."""
    return model.probs.where(F.col("ord") == n + 1).select(F.col("ctx").alias("_g")).distinct()


def entropy_prune(model: Model, threshold: float, least: int = 2, history: Model | None = None) -> Model:
    """Drop n-grams whose loss changes perplexity by less than the threshold; contexts of longer n-grams stay."""
    for n in range(model.order, least - 1, -1):
        drop = entropy_costs(model, n, history).where(F.col("change") < threshold)
        if n < model.order:
            drop = drop.withColumn("_g", gram(F.col("ctx"), F.col("w"))).join(_needed(model, n), "_g", "left_anti")
        model = _without(model, n, drop)
    return renormalise(model)


def low_prob_candidates(model: Model, n: int) -> DataFrame:
    """N-grams less probable than their backed-off estimate."""
    return with_lower(model, n).where(F.col("lowlog") + F.col("bow") > F.col("logp")).select("ctx", "w")


def low_prob_prune(model: Model, least: int = 2, rounds: int = 50) -> Model:
    """Drop such n-grams until none is left, then put back the n-grams that contexts need."""
    for _ in range(rounds):
        dropped = 0
        for n in range(least, model.order + 1):
            drop = cut(low_prob_candidates(model, n))
            found = drop.count()
            if found:
                dropped += found
                model = _without(model, n, drop)
        model = renormalise(model)
        if not dropped:
            break
    return fill_contexts(model)


def hoeffding_prunable(counts: DataFrame, n: int, alpha: float) -> DataFrame:
    """N-grams whose relative frequency does not differ enough from that in the shorter context."""
    level = counts.where((F.col("ord") == n) & (F.col("w") != "<s>"))
    totals = level.groupBy("ctx").agg(F.sum("cnt").alias("n1"))
    low = counts.where((F.col("ord") == n - 1) & (F.col("w") != "<s>"))
    low_totals = low.groupBy(F.col("ctx").alias("sctx")).agg(F.sum("cnt").alias("n2"))
    low = low.select(F.col("ctx").alias("sctx"), "w", F.col("cnt").alias("c2")).join(low_totals, "sctx")
    rows = level.join(totals, "ctx").withColumn("sctx", shorter(F.col("ctx"))).join(low, ["sctx", "w"])
    delta = F.abs(F.col("cnt") / F.col("n1") - F.col("c2") / F.col("n2"))
    spread = 1 / F.sqrt("n1") + 1 / F.sqrt("n2")
    bound = 2 * F.exp(-2 * delta * delta / (spread * spread))
    return rows.withColumn("bound", bound).where(F.col("bound") > alpha).select("ctx", "w", "bound")


# ---- mixtures ----


def mix(models: Sequence[Model], weights: Sequence[float]) -> Model:
    """One model whose n-grams are those of any of the models, each with the weighted mean of their probabilities."""
    order = max(m.order for m in models)

    def mean(name: str) -> Column:
        return to_log(reduce(lambda a, b: a + b, [F.lit(float(x)) * F.pow(F.lit(10.0), F.col(f"{name}{k}")) for k, x in enumerate(weights)]))

    words = reduce(DataFrame.unionByName, [m.probs.where(F.col("ord") == 1).select("ctx", "w") for m in models]).distinct()
    for k, m in enumerate(models):
        words = lookup(words, m.upto(1), "_", every=True).withColumnRenamed("_logp", f"own{k}").drop("_hit")
    levels = {1: cut(words.select("ctx", "w", mean("own").alias("logp")))}
    for n in range(2, order + 1):
        rows = met(models, n)
        # the mixture of the words alone is that of the shorter context for bigrams only
        levels[n] = rows.select("ctx", "w", mean("own").alias("logp"), mean("low").alias("lowlog")) if n == 2 else cut(rows.select("ctx", "w", mean("own").alias("logp")))
    return renormalised(levels)


# ---- quantisation ----


def histogram(model: Model) -> DataFrame:
    """How often each distinct log probability occurs."""
    return model.probs.where(F.col("logp") > ZERO).groupBy("logp").agg(F.count(F.lit(1)).alias("n"))


def codebook(values: np.ndarray, weights: np.ndarray, bins: int, rounds: int = 100) -> np.ndarray:
    """Bin centres by Lloyd's iteration from bins of equal mass."""
    order = np.argsort(values)
    values, weights = values[order], weights[order].astype(float)
    mass = np.cumsum(weights) / weights.sum()
    bin_of = np.minimum((mass - weights / weights.sum() / 2) * bins, bins - 1).astype(int)
    centres = np.array([np.average(values[bin_of == b], weights=weights[bin_of == b]) if (bin_of == b).any() else np.nan for b in range(bins)])
    centres = centres[~np.isnan(centres)]
    for _ in range(rounds):
        bin_of = np.searchsorted((centres[1:] + centres[:-1]) / 2, values)
        sums, n = np.bincount(bin_of, weights * values, len(centres)), np.bincount(bin_of, weights, len(centres))
        new = np.where(n > 0, sums / np.maximum(n, 1e-300), centres)
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


def quantise(model: Model, bins: int = 256, resolution: int = 100_000) -> Model:
    """Probabilities replaced by the nearest of the codebook's values; the histogram is binned before it leaves the cluster."""
    low, high = model.probs.where(F.col("logp") > ZERO).agg(F.min("logp"), F.max("logp")).first()
    step = max((high - low) / resolution, 1e-12)
    cell = F.floor((F.col("logp") - low) / step)
    rows = histogram(model).groupBy(cell.alias("cell")).agg((F.sum(F.col("logp") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n")).collect()
    centres = codebook(np.array([r["v"] for r in rows]), np.array([r["n"] for r in rows]), bins)
    cuts = F.array(*[F.lit(float(x)) for x in (centres[1:] + centres[:-1]) / 2]) if len(centres) > 1 else F.array().cast("array<double>")
    index = F.size(F.filter(cuts, lambda x: x < F.col("logp")))
    value = F.get(F.array(*[F.lit(float(x)) for x in centres]), index)
    return Model(model.order, model.probs.withColumn("logp", F.when(F.col("logp") > ZERO, value).otherwise(F.col("logp"))), model.bows)


def ranked(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)))
