"""Back-off lookup and evaluation: the engine's central join.

An event is a context string and a word. Its probability is that of the longest n-gram the model has for it,
plus the back-off weights of the longer contexts that had to be left. Distinct events are looked up once, by
equi-joins on the n-gram keys of each order; nothing is hinted, so the adaptive planner broadcasts an order
that measures small and shuffles one that does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import gram, shorter, suffix, with_boundaries
from textloom.plans.session import cut
from textloom.schema import BOS, EOS, UNK

ZERO = float("-inf")


@dataclass
class Model:
    """A back-off model: ``probs`` (ord, ctx, w, logp) and ``bows`` (len, ctx, bow).

    Estimation also leaves the n-grams of each order from 2 beside the lower order's ``lowlog`` and their context's ``bow``.
    """

    order: int
    probs: DataFrame
    bows: DataFrame
    lower: dict[int, DataFrame] | None = None

    def persist(self) -> Model:
        return Model(self.order, cut(self.probs), cut(self.bows))

    def upto(self, n: int) -> Model:
        """The model's orders up to ``n``."""
        return Model(n, self.probs.where(F.col("ord") <= n), self.bows.where(F.col("len") < n))


def events_of(sents: DataFrame, order: int, keys: Sequence[str] = (), boundaries: bool = True) -> DataFrame:
    """Keys, ``pos``, ``ctx`` (at most order - 1 words) and ``w`` of every scored position; the start symbol is none."""
    words = with_boundaries(F.col("words")) if boundaries else F.col("words")
    rows = sents.select(*keys, words.alias("_w"))
    first = 2 if boundaries else 1
    at = F.transform(
        F.sequence(F.lit(first), F.size("_w")),
        lambda j: F.struct(
            (j - first + 1).alias("pos"),
            F.array_join(F.slice(F.col("_w"), F.greatest(F.lit(1), j - (order - 1)), F.least(F.lit(order - 1), j - 1)), " ").alias("ctx"),
            F.get(F.col("_w"), j - 1).alias("w"),
        ),
    )
    return rows.where(F.size("_w") >= first).select(*keys, F.explode(at).alias("e")).select(*keys, "e.pos", "e.ctx", "e.w")


def contexts_of(events: DataFrame, order: int, most: int = 100_000) -> DataFrame | None:
    """The contexts of events and all their ends, as a table: what a model has to know to look the events up.

    More than ``most`` are None: then the whole model serves, for the contexts would have to meet every place of the text in a shuffle.
    """
    ends = F.array(*[suffix(F.col("ctx"), k) for k in range(1, order)])
    found = cut(events.select("ctx").distinct().select(F.explode(ends).alias("ctx")).where("ctx <> ''").distinct())
    return found if found.count() <= most else None


def context_length(ctx: Column) -> Column:
    return F.when(ctx == "", 0).otherwise(F.size(F.split(ctx, " ")))


def lookup(events: DataFrame, model: Model, prefix: str = "", every: bool = False) -> DataFrame:
    """Add ``logp`` and ``hit`` (words of the n-gram found, 0 if the word is unknown) to events with ``ctx`` and ``w``.

    Distinct events are written once, and the model is first narrowed to their keys: where they are few, the keys are
    broadcast and the model is only scanned. With ``every``, for events as many as the model's n-grams and distinct
    already, the events themselves meet the whole model.
    """
    n = model.order
    pairs = events if every else cut(events.select("ctx", "w").distinct())
    look = pairs.withColumn("_len", context_length(F.col("ctx")))
    keyed = look.withColumns({f"_k{k}": F.when(F.col("_len") >= k - 1, suffix(F.col("ctx"), k - 1)) for k in range(2, n + 1)})

    def narrowed(table: DataFrame, **on: str) -> DataFrame:
        if every:
            return table
        wanted = keyed.select(*[F.col(c).alias(f"_of{c}") for c in on.values()]).distinct()
        return table.join(wanted, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_of{o}") for c, o in on.items()]), "left_semi")

    for k in range(n, 0, -1):
        probs = model.probs.where(F.col("ord") == k).select(F.col("ctx").alias(f"_c{k}"), F.col("w").alias(f"_w{k}"), F.col("logp").alias(f"_p{k}"))
        if k == 1:
            look = look.join(narrowed(probs.drop("_c1"), _w1="w"), F.col("w") == F.col("_w1"), "left").drop("_w1")
        else:
            look = look.withColumn(f"_k{k}", F.when(F.col("_len") >= k - 1, suffix(F.col("ctx"), k - 1)))
            probs = narrowed(probs, **{f"_c{k}": f"_k{k}", f"_w{k}": "w"})
            look = look.join(probs, (F.col(f"_k{k}") == F.col(f"_c{k}")) & (F.col("w") == F.col(f"_w{k}")), "left").drop(f"_c{k}", f"_w{k}")
    for k in range(n - 1, 0, -1):
        bows = model.bows.where(F.col("len") == k).select(F.col("ctx").alias(f"_c{k}"), F.col("bow").alias(f"_b{k}"))
        bows = narrowed(bows, **{f"_c{k}": f"_k{k + 1}"})
        look = look.join(bows, F.col(f"_k{k + 1}") == F.col(f"_c{k}"), "left").drop(f"_c{k}")
    logp, hit, left = F.lit(ZERO), F.lit(0), F.lit(0.0)
    choices = []
    for k in range(n, 0, -1):
        choices.append((k, F.col(f"_p{k}").isNotNull(), F.col(f"_p{k}") + left))
        if k > 1:
            left = left + F.when(F.col("_len") >= k - 1, F.coalesce(F.col(f"_b{k - 1}"), F.lit(0.0))).otherwise(0.0)
    for k, found, value in reversed(choices):
        logp, hit = F.when(found, value).otherwise(logp), F.when(found, F.lit(k)).otherwise(hit)
    if every:
        return look.select(*events.columns, logp.alias(f"{prefix}logp"), hit.alias(f"{prefix}hit"))
    known = look.select(F.col("ctx").alias("_ec"), F.col("w").alias("_ew"), logp.alias(f"{prefix}logp"), hit.alias(f"{prefix}hit"))
    return events.join(known, (F.col("ctx") == F.col("_ec")) & (F.col("w") == F.col("_ew"))).drop("_ec", "_ew")


def met(models: Sequence[Model], n: int, contexts: DataFrame | None = None) -> DataFrame:
    """The n-grams of order ``n`` that any of the models holds: ``ctx``, ``w`` and, of each model, ``own0`` ..., its log probability of the
    word in the context, ``low0`` ..., that in the shorter context, and ``has0`` ..., whether it holds the n-gram; with ``contexts``, those behind them.

    All models' n-grams and weights are dealt by context once; a context's n-grams meet each other and the weights as they lie, and
    stay so. One model that estimation left needs no dealing.
    """
    among = lambda df: df if contexts is None else df.join(contexts.select("ctx"), "ctx", "left_semi")
    if len(models) == 1 and models[0].lower:
        return among(models[0].lower[n]).select("ctx", "w", F.col("logp").alias("own0"), F.col("lowlog").alias("low0"), F.lit(True).alias("has0"))
    none, each = F.lit(None).cast("double"), range(len(models))
    rows = [among(m.probs.where(F.col("ord") == n)).select(F.lit(k).alias("_k"), F.col("ctx").alias("_full"), shorter(F.col("ctx")).alias("ctx"), "w", F.col("logp").alias("_own")) for k, m in enumerate(models)]
    rows = reduce(DataFrame.unionByName, rows)
    for k, m in enumerate(models):
        rows = lookup(rows, m.upto(n - 1), f"_{k}", every=True).drop(f"_{k}hit")
    rows = rows.select("_k", F.col("_full").alias("ctx"), "w", "_own", *[F.col(f"_{k}logp").alias(f"low{k}") for k in each], none.alias("_bow"))
    weights = [among(m.bows.where(F.col("len") == n - 1)).select(F.lit(k).alias("_k"), "ctx", F.lit(None).cast("string").alias("w"), none.alias("_own"), *[none.alias(f"low{j}") for j in each], F.col("bow").alias("_bow")) for k, m in enumerate(models)]
    dealt = reduce(DataFrame.unionByName, [rows, *weights]).repartition("ctx")
    of = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    rows = dealt.groupBy("ctx", "w").agg(*[of(k, "_own").alias(f"own{k}") for k in each], *[of(k, "_bow").alias(f"_bow{k}") for k in each], *[F.max(f"low{k}").alias(f"low{k}") for k in each])
    rows = rows.withColumns({f"_bow{k}": F.max(f"_bow{k}").over(Window.partitionBy("ctx")) for k in each}).where("w is not null")
    own = [F.coalesce(f"own{k}", F.coalesce(f"_bow{k}", F.lit(0.0)) + F.col(f"low{k}")).alias(f"own{k}") for k in each]
    return rows.select("ctx", "w", *own, *[f"low{k}" for k in each], *[F.col(f"own{k}").isNotNull().alias(f"has{k}") for k in each])


def used_context(events: DataFrame, model: Model) -> DataFrame:
    """``used``: the number of context words the model knows a back-off weight for, longest first."""
    out = events.withColumn("_len", context_length(F.col("ctx")))
    used = F.lit(0)
    for k in range(1, model.order):
        bows = model.bows.where(F.col("len") == k).select(F.col("ctx").alias(f"_c{k}"))
        out = out.withColumn(f"_k{k}", F.when(F.col("_len") >= k, suffix(F.col("ctx"), k))).join(bows, F.col(f"_k{k}") == F.col(f"_c{k}"), "left")
        used = F.when(F.col(f"_c{k}").isNotNull(), F.lit(k)).otherwise(used)
    return out.withColumn("used", used).select(*events.columns, "used")


def skip_oovs(scored: DataFrame) -> DataFrame:
    """Zero where the word or one of the last two context words is unknown."""
    near = F.split(suffix(F.col("ctx"), 2), " ")
    return scored.withColumn("logp", F.when((F.col("w") == UNK) | F.array_contains(near, UNK), F.lit(ZERO)).otherwise(F.col("logp")))


def text_stats(scored: DataFrame, by: Sequence[str] = (), sentence: Sequence[str] = ("doc_id", "sent_id"), weight: Column | None = None, known: str | None = None) -> DataFrame:
    """Sentences, words, OOVs, zero probabilities and the sum of log probabilities of scored events.

    A zero probability of an unknown word (``hit`` 0, or the column ``known`` false) is an OOV, of a known
    word a zero probability; neither enters the sum.
    """
    zero = F.col("logp") == ZERO
    unknown = (F.col("hit") == 0) if known is None else ~F.col(known)
    amount = F.lit(1) if weight is None else weight
    is_word = F.col("w") != EOS
    return scored.groupBy(*by).agg(
        F.sum(F.when(F.col("w") == EOS, amount).otherwise(0)).alias("sentences"), F.sum(F.when(is_word, amount).otherwise(0)).alias("words"),
        F.sum(F.when(zero & unknown, amount).otherwise(0)).alias("oovs"), F.sum(F.when(zero & ~unknown, amount).otherwise(0)).alias("zeroprobs"),
        F.sum(F.when(~zero, amount * F.col("logp")).otherwise(0.0)).alias("logprob"),
    )


def perplexities(stats: DataFrame) -> DataFrame:
    """Add ``ppl`` (per event) and ``ppl1`` (per word)."""
    denominator = F.col("words") - F.col("oovs") - F.col("zeroprobs")
    power = lambda d: F.when(d > 0, F.pow(F.lit(10.0), -F.col("logprob") / d))
    return stats.withColumn("ppl", power(denominator + F.col("sentences"))).withColumn("ppl1", power(denominator))


def counts_events(counts: DataFrame, order: int) -> DataFrame:
    """Counts as weighted events of a model of the order."""
    from textloom.operators.counts import scoring_events

    return scoring_events(counts, order).where(F.col("w") != BOS)


def context_log_prob(contexts: DataFrame, model: Model, order: int) -> DataFrame:
    """``ctxlogp``: chain-rule probability of each context; a leading start symbol counts as a sentence end."""
    words = F.split("ctx", " ")
    steps = contexts.select("ctx").distinct().select(
        "ctx",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(words)),
                lambda j: F.struct(
                    F.array_join(F.slice(words, F.greatest(F.lit(1), j - (order - 1)), F.least(F.lit(order - 1), j - 1)), " ").alias("ctx"),
                    F.when((j == 1) & (F.get(words, j - 1) == BOS), F.lit(EOS)).otherwise(F.get(words, j - 1)).alias("w"),
                ),
            )
        ).alias("s"),
    )
    rows = lookup(steps.where("ctx <> ''").select(F.col("ctx").alias("whole"), "s.ctx", "s.w"), model)
    return rows.groupBy("whole").agg(F.sum("logp").alias("ctxlogp")).withColumnRenamed("whole", "ctx")


def hit_lengths(scored: DataFrame) -> DataFrame:
    return scored.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def compare_models(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-token comparison of two scored texts: counts of equal and greater, mean and deviation of the difference."""
    both = a.select(*keys, F.col("logp").alias("_a")).join(b.select(*keys, F.col("logp").alias("_b")), list(keys))
    both = both.where((F.col("_a") > ZERO) & (F.col("_b") > ZERO)).withColumn("_d", F.col("_b") - F.col("_a"))
    return both.agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("_d") == 0).alias("equal"), F.count_if(F.col("_d") > 0).alias("greater"),
        F.avg("_d").alias("mean"), F.stddev_pop("_d").alias("deviation"),
    )


def sign_tail(greater: int, less: int) -> float:
    """Probability under even odds of at most the smaller of two counts."""
    from math import comb

    n, k = greater + less, min(greater, less)
    return sum(comb(n, i) for i in range(k + 1)) / 2**n if n else 1.0


def words_above(asked: DataFrame, values: DataFrame) -> DataFrame:
    """``ctx``, ``w``, ``side``, ``n``: how many ``values`` (key, v, n) of the row's ``key`` exceed ``t`` (side 0) or reach it (side 2).

    Running sums inside slices of the values of a key, after the sums of the slices above: a key with many values is
    spread over its slices, and equal values are one row.
    """
    sliced = lambda v: F.floor(F.least(F.lit(400.0), F.greatest(F.lit(0.0), -8 * v)))
    none = F.lit(None).cast("string")
    held = values.groupBy("key", "v").agg(F.sum("n").alias("n")).select("key", "v", F.lit(1).alias("side"), "n", none.alias("ctx"), none.alias("w"))
    rows = held.unionByName(asked.select("key", F.col("t").alias("v"), "side", F.lit(0).cast("long").alias("n"), "ctx", "w")).withColumn("_b", sliced(F.col("v")))
    first = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(F.col("key").alias("_sk"), F.col("_b").alias("_sb")).agg(F.sum("n").alias("_n"))
    slices = slices.withColumnRenamed("_sk", "key").withColumnRenamed("_sb", "_b").withColumn("_before", F.coalesce(F.sum("_n").over(first), F.lit(0)))
    inside = Window.partitionBy("key", "_b").orderBy(F.desc("v"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_in", F.sum("n").over(inside)).where("side <> 1").join(slices.select("key", "_b", "_before"), ["key", "_b"])
    return found.select("ctx", "w", "side", (F.col("_before") + F.col("_in")).alias("n"))


def rank_metrics(scored: DataFrame, model: Model, tolerance: float = 3e-6, stop: float = 10.0) -> DataFrame:
    """``rank``: words of the model more probable in the event's context, ties within ``tolerance`` counted half, at most ``stop + 1``.

    All words of the model count, yet no context meets the vocabulary: what exceeds a probability in a context are its
    seen words that do, and of the other words those that exceed it in the shorter context, divided by the back-off weight.
    """
    q = F.pow(F.lit(10.0), F.col("logp"))
    over = F.struct(F.lit(0).alias("side"), F.log10(q + tolerance).alias("t"))
    least = F.struct(F.lit(2).alias("side"), F.when(q > tolerance, F.log10(q - tolerance)).otherwise(F.lit(ZERO)).alias("t"))
    asked = scored.select("ctx", "w", "logp").distinct().select("ctx", "w", F.explode(F.array(over, least)).alias("_e")).select("ctx", "w", "_e.side", "_e.t")
    asked = asked.withColumn("_len", context_length(F.col("ctx")))
    parts = []
    for k in range(model.order - 1, 0, -1):
        asked = asked.withColumn("key", F.when(F.col("_len") >= k, suffix(F.col("ctx"), k)))
        here = asked.where("key is not null")
        seen = met([model], k + 1, here.select(F.col("key").alias("ctx")).distinct()).select(F.col("ctx").alias("key"), "own0", "low0", F.lit(1).cast("long").alias("n"))
        parts.append(words_above(here, seen.select("key", F.col("own0").alias("v"), "n")))
        bows = model.bows.where(F.col("len") == k).select(F.col("ctx").alias("_bc"), "bow")
        asked = asked.join(bows, F.col("key") == F.col("_bc"), "left")
        asked = asked.withColumn("t", F.when(F.col("t") == ZERO, F.col("t")).otherwise(F.col("t") - F.coalesce("bow", F.lit(0.0)))).drop("_bc", "bow")
        less = words_above(asked.where("key is not null"), seen.select("key", F.col("low0").alias("v"), "n"))
        parts.append(less.withColumn("n", -F.col("n")))
    words = model.probs.where(F.col("ord") == 1).select(F.lit("").alias("key"), F.col("logp").alias("v"), F.lit(1).cast("long").alias("n"))
    parts.append(words_above(asked.withColumn("key", F.lit("")), words))
    found = reduce(DataFrame.unionByName, parts).groupBy("ctx", "w").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("side") == 2, F.col("n")).otherwise(0)).alias("_r"))
    ranked = found.select("ctx", "w", F.least(F.col("_a") + (F.col("_r") - F.col("_a") - 1) / 2, F.lit(stop + 1)).alias("rank"))
    return scored.join(ranked, ["ctx", "w"])


def vocabulary_sums(contexts: DataFrame, models: Sequence[Model], powers: Sequence[float] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``ctx``, ``total``: the sum over every word of its weight times the product of the models' probabilities to their powers.

    No context meets the vocabulary: words that no model has seen after a context have the product after the shorter
    context times the back-off weights, so a context's sum is that of its seen words, plus the weights times what the
    shorter context's sum leaves beside the same words. ``weights`` (``w``, ``alpha``) are 1 where not given.
    """
    powers = list(powers or [1.0] * len(models))
    order = max(m.order for m in models)

    def product(name: str) -> Column:
        each = [F.when(F.col(f"{name}{k}") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), F.lit(p) * F.col(f"{name}{k}"))) for k, p in enumerate(powers)]
        return reduce(lambda a, b: a * b, each)

    def weighted(rows: DataFrame) -> DataFrame:
        if weights is None:
            return rows.withColumn("_alpha", F.lit(1.0))
        alpha = weights.select(F.col("w").alias("_aw"), F.col("alpha"))
        return rows.join(alpha, F.col("w") == F.col("_aw"), "left").withColumn("_alpha", F.coalesce("alpha", F.lit(1.0))).drop("_aw", "alpha")

    words = models[0].probs.where(F.col("ord") == 1).select(F.lit("").alias("ctx"), "w")
    for k, m in enumerate(models):
        words = lookup(words, m.upto(1), "_", every=True).withColumnRenamed("_logp", f"own{k}").drop("_hit")
    base = weighted(words).agg(F.sum(F.col("_alpha") * product("own"))).first()[0] or 0.0
    asked = contexts.select("ctx").distinct().withColumn("_len", context_length(F.col("ctx")))
    sums = [asked.where("_len = 0").select("ctx", F.lit(base).alias("total"))]
    below = None
    for k in range(1, order):
        here = asked.where(F.col("_len") >= k).select(suffix(F.col("ctx"), k).alias("ctx")).distinct()
        rows = weighted(met(models, k + 1, here))
        parts = rows.groupBy(F.col("ctx").alias("_c")).agg(F.sum(F.col("_alpha") * product("own")).alias("_a"), F.sum(F.col("_alpha") * product("low")).alias("_b"))
        level = here.join(parts, F.col("ctx") == F.col("_c"), "left").drop("_c")
        scale = F.lit(1.0)
        for j, m in enumerate(models):
            level = level.join(m.bows.where(F.col("len") == k).select(F.col("ctx").alias(f"_c{j}"), F.col("bow").alias(f"_w{j}")), F.col("ctx") == F.col(f"_c{j}"), "left").drop(f"_c{j}")
            scale = scale * F.pow(F.lit(10.0), F.lit(powers[j]) * F.coalesce(F.col(f"_w{j}"), F.lit(0.0)))
        if below is None:
            level = level.withColumn("_t", F.lit(base))
        else:
            level = level.withColumn("_s", shorter(F.col("ctx"))).join(below.select(F.col("ctx").alias("_sc"), F.col("total").alias("_t")), F.col("_s") == F.col("_sc"))
        below = level.select("ctx", (F.coalesce("_a", F.lit(0.0)) + scale * (F.col("_t") - F.coalesce("_b", F.lit(0.0)))).alias("total"))
        sums.append(below.join(asked.where(F.col("_len") == k).select("ctx"), "ctx", "left_semi"))
    out = sums[0]
    for more in sums[1:]:
        out = out.unionByName(more)
    return out


def prob_sums(contexts: DataFrame, model: Model) -> DataFrame:
    """Sum of the probabilities of all words of the model in each context."""
    return vocabulary_sums(contexts, [model])
