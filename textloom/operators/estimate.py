"""Estimation of back-off models, order by order.

Each order's probabilities come from one aggregation per context; its back-off weights follow at once from
the lower order's probabilities of the same words. Contexts left without mass are retried with a larger total.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import but_last, gram, last_word, shorter, suffix
from textloom.operators.counts import kn_counts
from textloom.operators.discount import Method, fit
from textloom.operators.score import ZERO, Model, lookup
from textloom.plans.session import cut
from textloom.schema import BOS, EPSILON, META, NON_EVENTS, UNK


def context_totals(level: DataFrame) -> DataFrame:
    """Total, types and types with at least two and three of each context; zero counts are no types."""
    return level.groupBy("ctx").agg(*[x.alias(name) for name, x in figures_of("cnt").items()])


def figures_of(cnt: str) -> dict[str, Column]:
    """The figures of a context as aggregates."""
    c = F.col(cnt)
    return {"total": F.sum(c), "types": F.count_if(c > 0), "types2": F.count_if(c > 1), "types3": F.count_if(c > 2)}


def vocabulary_of(counts: DataFrame) -> DataFrame:
    """Words that can be predicted."""
    return counts.where((F.col("ord") == 1) & ~F.col("w").isin(*NON_EVENTS, UNK) & ~F.col("w").startswith(META)).select("w")


def discounted(level: DataFrame, totals: DataFrame | None, method: Method, v: int, keys: Sequence[str] = ("ctx",)) -> DataFrame:
    """``p`` of each n-gram of an order (``ctx``, ``w``, ``cnt`` and the lower order's probability ``lowp``), beside its context's totals.

    N-grams under the least count need no row: ``totals`` has their context, which stays, with a null word if it has no other.
    Without ``totals``, all n-grams are in ``level``, and totals are found on its rows as they lie.
    A context whose probabilities leave no mass although it has not seen every word is retried: first
    without interpolation, then with a total larger by the least whole number that leaves some. The rows of a context meet once,
    in the join with its totals; its sums are windows over the rows as they lie. ``keys`` tell contexts apart, and how rows lie.
    """
    context = Window.partitionBy(*keys)
    if totals is None:
        rows = level.withColumns({name: x.over(context) for name, x in figures_of("cnt").items()})
    else:
        rows = totals.join(level, "ctx", "left" if method.min_count > 1 else "inner")
    rows = rows.withColumn("_d", method.factor(v))
    own = F.col("_d") * F.col("cnt") / F.col("total")
    mixed = own + method.lower_weight(v) * F.col("lowp") if method.interpolate else own
    rows = rows.withColumn("p", F.when(F.col("_d") == 0, F.lit(0.0)).otherwise(mixed))
    rows = rows.withColumns({"_sum": F.sum("p").over(context), "_kept": F.sum(F.col("_d") * F.col("cnt")).over(context)})
    return rows.withColumn("p", settled_probability(v)).drop("_sum", "_kept", "_d")


def settled_probability(v: int) -> Column:
    """The probability, with the retry of contexts that leave no mass; ``_sum`` and ``_kept`` are sums over the context."""
    short = (1 - F.col("_sum") <= EPSILON) & (F.col("types") < v)
    grown = F.greatest(F.col("total").cast("double"), F.floor(F.col("_kept") / (1 - EPSILON)) + 1)
    grown = F.when(1 - F.col("_kept") / F.col("total") > EPSILON, F.col("total")).otherwise(grown)
    return F.when(short, F.col("_d") * F.col("cnt") / grown).otherwise(F.col("p"))


def unigram_estimator(level: DataFrame, method: Method, v: int) -> Callable[[DataFrame], DataFrame]:
    """What adds a unigram's probability ``p`` to rows with its count ``cnt``: all else it hangs on are a few sums of the unigrams.

    The left-over mass goes to words without probability if there are any, else to all alike.
    """
    level = level.where(~F.col("w").isin(*NON_EVENTS))
    totals = context_totals(level.withColumn("ctx", F.lit(""))).first()
    figures = {c: F.lit(totals[c] if totals else 0) for c in ("total", "types", "types2", "types3")}

    def first(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({**figures, "lowp": F.lit(1.0 / v if v else 0.0)}).withColumn("_d", method.factor(v))
        own = F.col("_d") * F.col("cnt") / F.col("total")
        mixed = own + method.lower_weight(v) * F.col("lowp") if method.interpolate else own
        return rows.withColumn("p", F.when(F.col("_d") == 0, F.lit(0.0)).otherwise(mixed))

    sums = first(level).agg(F.sum("p"), F.sum(F.col("_d") * F.col("cnt"))).first()

    def settled(rows: DataFrame) -> DataFrame:
        return first(rows).withColumns({"_sum": F.lit(sums[0]).cast("double"), "_kept": F.lit(sums[1]).cast("double")}).withColumn("p", settled_probability(v))

    total, zeros = settled(level).agg(F.sum("p"), F.count_if(F.col("p") == 0)).first()
    left = 1.0 - (total or 0.0)
    share = 0.0 if left <= 0 else left / (zeros or v)
    filled = F.when(F.col("p") == 0, F.lit(share)).otherwise(F.col("p")) if zeros else F.col("p") + share
    return lambda rows: settled(rows).withColumn("p", filled).drop(*figures, "lowp", "_d", "_sum", "_kept")


def unigram_probs(level: DataFrame, method: Method, v: int) -> DataFrame:
    """Unigrams with their probabilities."""
    return unigram_estimator(level, method, v)(level.where(~F.col("w").isin(*NON_EVENTS))).select("w", "p")


def with_unigram(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``c1``, the count of the last word alone; counts that still lie by that word need no exchange."""
    return counts.withColumn("c1", F.max(F.when(F.col("ord") == 1, F.col("cnt"))).over(Window.partitionBy(*by, "w")))


def with_lower(level: DataFrame, n: int, probs: dict[int, DataFrame], bows: dict[int, DataFrame]) -> DataFrame:
    """Add ``lowp``, the probability of the word in the context less its first word, to rows with that of the word alone, ``p1``."""
    value = F.col("p1")
    for k in range(2, n):  # from the shortest context to the one asked for
        level = level.withColumn("_s", suffix(F.col("ctx"), k - 1))
        known = probs[k].select(F.col("ctx").alias("_c"), F.col("w").alias("_w"), F.col("logp").alias(f"_p{k}"))
        weights = bows[k].select(F.col("ctx").alias("_c"), F.col("bow").alias(f"_b{k}"))
        level = level.join(known, (F.col("_s") == F.col("_c")) & (F.col("w") == F.col("_w")), "left").drop("_c", "_w")
        level = level.join(weights, F.col("_s") == F.col("_c"), "left").drop("_c", "_s")
        ten = lambda x: F.pow(F.lit(10.0), x)
        value = F.coalesce(ten(F.col(f"_p{k}")), ten(F.coalesce(F.col(f"_b{k}"), F.lit(0.0))) * value)
    return level.select("ctx", "w", "cnt", value.alias("lowp"))


def backoff_weights(rows: DataFrame, v: int, keys: Sequence[str] = ("ctx",)) -> DataFrame:
    """``bow`` per context from sums of its probabilities and the lower order's; degenerate cases as the method asks."""
    sums = rows.groupBy(*keys).agg(*[x.alias(c) for c, x in seen_sums().items()], F.max("types").alias("types"))
    bow, scale = weight_and_scale()
    return sums.select(*keys, bow.alias("bow"), scale.alias("scale"))


def seen_sums() -> dict[str, Column]:
    """Sums of a context's probabilities and of the lower order's for the same words."""
    seen = F.col("p") > 0
    return {"_p": F.sum(F.when(seen, F.col("p")).otherwise(0.0)), "_l": F.sum(F.when(seen, F.col("lowp")).otherwise(0.0))}


def weight_and_scale() -> tuple[Column, Column]:
    """The back-off weight of the sums ``_p`` and ``_l``, and what its context's probabilities are multiplied by."""
    settle = lambda x: F.when(F.abs(x) < EPSILON, F.lit(0.0)).otherwise(x)
    above, below = settle(1 - F.col("_p")), settle(1 - F.col("_l"))
    bow = (
        F.when((above == 0) & (below == 0), F.lit(0.0))
        .when((below < EPSILON) & (above > EPSILON), F.lit(0.0))
        .when((below <= 0) | (above <= 0), F.lit(ZERO))
        .otherwise(F.log10(above) - F.log10(below))
    )
    # the lower order has no mass left but this context has: its probabilities are scaled up to one
    return bow, F.when((below < EPSILON) & (above > EPSILON), 1 / F.col("_p")).otherwise(1.0)


def weighed(rows: DataFrame, keys: Sequence[str] = ("ctx",), more: Sequence[str] = ()) -> DataFrame:
    """``ctx``, ``w``, ``logp`` (null where there is no probability), ``lowlog`` of the lower order, and the context's ``bow``,
    found on the rows as they lie; ``one`` marks one row of each context. Columns named in ``more`` stay."""
    context = Window.partitionBy(*keys)
    bow, scale = weight_and_scale()
    sums = rows.withColumns({**{c: x.over(context) for c, x in seen_sums().items()}, "_first": F.min("w").over(context)})
    one = F.col("w").isNull() | (F.col("w") == F.col("_first"))
    return sums.select("ctx", "w", F.when(F.col("p") > 0, F.log10(F.col("p") * scale)).alias("logp"), F.log10(F.col("lowp")).alias("lowlog"), bow.alias("bow"), one.alias("one"), *more)


def estimate(counts: DataFrame, order: int, methods: dict[int, Method], *, persist: bool = True) -> Model:
    """A back-off model of counts of all orders (already modified where the method wants it)."""
    hold = cut if persist else lambda df: df
    counts = counts if "c1" in counts.columns else with_unigram(counts)
    v = vocabulary_of(counts).count()
    first = hold(counts.where((F.col("ord") == 1) & ~F.col("w").isin(UNK) & ~F.col("w").startswith(META)).select("w", "cnt"))
    with_p = unigram_estimator(first, methods[1], v)
    uni = hold(with_p(first.where(~F.col("w").isin(*NON_EVENTS))))
    log = lambda p: F.when(p > 0, F.log10(p)).otherwise(F.lit(ZERO))
    start = first.where(F.col("w").isin(*NON_EVENTS)).select(F.lit(1).alias("ord"), F.lit("").alias("ctx"), "w", F.lit(ZERO).alias("logp"))
    probs = {1: uni.select(F.lit(1).alias("ord"), F.lit("").alias("ctx"), "w", log(F.col("p")).alias("logp")).unionByName(start)}
    bows = {1: counts.sparkSession.createDataFrame([], "len int, ctx string, bow double")}
    lower = {}
    for n in range(2, order + 1):
        level = counts.where((F.col("ord") == n) & ~F.col("w").isin(*NON_EVENTS, UNK) & ~F.col("w").startswith(META) & (last_word(F.col("ctx")) != "</s>"))
        some = methods[n].min_count > 1
        live = level.where(F.col("cnt") >= methods[n].min_count) if some else level
        # a word's probability alone is a function of its count
        live = with_p(live.select("ctx", "w", F.col("cnt").alias("_cnt"), F.col("c1").alias("cnt"))).select("ctx", "w", F.col("_cnt").alias("cnt"), F.coalesce("p", F.lit(0.0)).alias("p1"))
        rows = hold(weighed(discounted(with_lower(live, n, probs, bows), context_totals(level) if some else None, methods[n], v)))
        real = rows.where("logp is not null")
        probs[n] = real.select(F.lit(n).alias("ord"), "ctx", "w", "logp")
        bows[n] = rows.where("one").select(F.lit(n - 1).alias("len"), "ctx", "bow")
        lower[n] = real.select(F.lit(n).alias("ord"), "ctx", "w", "logp", F.coalesce("lowlog", F.lit(ZERO)).alias("lowlog"), "bow")
    return Model(order, reduce(DataFrame.unionByName, probs.values()), reduce(DataFrame.unionByName, bows.values()), lower)


def train(counts: DataFrame, order: int, method: str | Sequence[str] = "gt", *, interpolate: bool = False, min_counts: dict[int, int] | None = None, delta: float = 0.5, persist: bool = True, kn_counts_are: str = "raw") -> Model:
    """Estimate with one method for all orders, or one per order; parameters come from the counts.

    For Kneser-Ney, counts are ``raw`` (modified here, before constants are taken from them), ``modified`` already, or
    ``raw_for_constants`` (the constants are those of the raw counts, which are modified afterwards). Counts that have ``c1``
    already are written ones, and are read as they are.
    """
    names = [method] * order if isinstance(method, str) else list(method)
    if kn_counts_are not in ("raw", "modified", "raw_for_constants"):
        raise ValueError(kn_counts_are)
    kneser = any(m in ("kn", "mkn") for m in names)
    if kneser and kn_counts_are == "raw":
        counts = kn_counts(counts, order).where("cnt > 0")
    if persist and "c1" not in counts.columns:
        counts = cut(with_unigram(counts))  # parameters, vocabulary and every order read them again
    lows = min_counts or {}
    methods = {n: fit(names[n - 1], counts, n, interpolate=interpolate, min_count=lows.get(n), delta=delta) for n in range(1, order + 1)}
    if kneser and kn_counts_are == "raw_for_constants":
        counts = with_unigram(kn_counts(counts, order).where("cnt > 0"))
        counts = cut(counts) if persist else counts
    return estimate(counts, order, methods, persist=persist)


def fill_contexts(model: Model) -> Model:
    """Every context that has a back-off weight becomes an n-gram, with its backed-off probability."""
    out = model
    for n in range(2, model.order):
        have = out.probs.where(F.col("ord") == n).select(F.col("ctx"), F.col("w"))
        need = out.probs.where(F.col("ord") == n + 1).select(but_last(F.col("ctx")).alias("ctx"), last_word(F.col("ctx")).alias("w")).distinct()
        new = lookup(need.join(have, ["ctx", "w"], "left_anti"), out).where(F.col("logp") > ZERO)
        out = Model(out.order, out.probs.unionByName(new.select(F.lit(n).alias("ord"), "ctx", "w", "logp")), out.bows)
    return out


def renormalise(model: Model, keep: Model | None = None) -> Model:
    """Recompute every back-off weight, lowest order first."""
    return renormalised({n: model.probs.where(F.col("ord") == n).select("ctx", "w", "logp") for n in range(1, model.order + 1)})


def renormalised(levels: dict[int, DataFrame]) -> Model:
    """A model of the n-grams (``ctx``, ``w``, ``logp``) of each order, with its weights.

    Where a level has ``lowlog``, the new model's log probability in the shorter context, it is not looked up.
    """
    probs = [levels[1].select(F.lit(1).alias("ord"), "ctx", "w", "logp")]
    bows: list[DataFrame] = []
    spark = levels[1].sparkSession
    lower = Model(1, probs[0], spark.createDataFrame([], "len int, ctx string, bow double"))
    for n in range(2, len(levels) + 1):
        low = levels[n]
        if "lowlog" not in low.columns:
            low = lookup(low.select(F.col("ctx").alias("_full"), shorter(F.col("ctx")).alias("ctx"), "w", F.col("logp").alias("_own")), lower, "_", every=True)
            low = low.select(F.col("_full").alias("ctx"), "w", F.col("_own").alias("logp"), F.col("_logp").alias("lowlog"))
        low = low.select("ctx", "w", F.pow(F.lit(10.0), F.col("logp")).alias("p"), F.pow(F.lit(10.0), F.col("lowlog")).alias("lowp"), F.col("logp").alias("_own"))
        context = Window.partitionBy("ctx")
        bow, scale = weight_and_scale()
        rows = low.withColumns({c: x.over(context) for c, x in seen_sums().items()})
        rows = rows.withColumn("one", F.col("w") == F.min("w").over(context))
        rows = cut(rows.select("ctx", "w", (F.col("_own") + F.log10(scale)).alias("logp"), bow.alias("bow"), "one"))
        bows.append(rows.where("one").select(F.lit(n - 1).alias("len"), "ctx", "bow"))
        probs.append(rows.select(F.lit(n).alias("ord"), "ctx", "w", "logp"))
        lower = Model(n, reduce(DataFrame.unionByName, probs), reduce(DataFrame.unionByName, bows))
    return lower


__all__ = ["BOS", "backoff_weights", "context_totals", "discounted", "estimate", "fill_contexts", "gram", "renormalise", "renormalised", "train", "unigram_probs", "vocabulary_of"]
