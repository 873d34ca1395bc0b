"""Models combined at query time: mixtures, cache, adaptation, skipping, classes and wrappers.

Each takes scored events (``logp`` columns) or a model and gives events with a new ``logp``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import but_last, from_bytelog, shorter, suffix, to_bytelog, to_log
from textloom.operators.score import ZERO, Model, context_log_prob, lookup, vocabulary_sums
from textloom.schema import EOS, UNK

TEN = F.lit


def power(logp: Column) -> Column:
    return F.pow(F.lit(10.0), logp)


def null_model(events: DataFrame) -> DataFrame:
    return events.withColumn("logp", F.lit(0.0)).withColumn("hit", F.lit(1))


def score_all(events: DataFrame, models: Sequence[Model]) -> DataFrame:
    """``p0``, ``p1`` ... of each event under each model."""
    out = events
    for k, m in enumerate(models):
        out = lookup(out, m, f"_m{k}").withColumn(f"p{k}", power(F.col(f"_m{k}logp"))).drop(f"_m{k}logp", f"_m{k}hit")
    return out


def bayes_mix(events: DataFrame, models: Sequence[Model], priors: Sequence[float], length: int = 1, scale: float = 1.0) -> DataFrame:
    """Mixture whose weights are the priors times each model's probability of the last ``length`` context words; the priors if all are zero."""
    scored = score_all(events, models).withColumn("_full", F.col("ctx"))
    weights = []
    for k, m in enumerate(models):
        if length:
            contexts = scored.select(suffix(F.col("_full"), length).alias("ctx")).distinct()
            probs = context_log_prob(contexts, m, m.order).select(F.col("ctx").alias(f"_x{k}"), F.col("ctxlogp").alias(f"_l{k}"))
            scored = scored.join(probs, suffix(F.col("_full"), length) == F.col(f"_x{k}"), "left")
            weights.append(F.lit(float(priors[k])) * F.coalesce(F.pow(F.lit(10.0), scale * F.col(f"_l{k}")), F.lit(1.0)))
        else:
            weights.append(F.lit(float(priors[k])))
    total = sum(weights[1:], weights[0])
    plain = sum(((F.lit(float(p)) * F.col(f"p{k}")) for k, p in list(enumerate(priors))[1:]), F.lit(float(priors[0])) * F.col("p0")) / F.lit(float(sum(priors)))
    mixed = sum((w * F.col(f"p{k}") for k, w in list(enumerate(weights))[1:]), weights[0] * F.col("p0")) / total
    return scored.withColumn("logp", to_log(F.when(total > 0, mixed).otherwise(plain))).select(*events.columns, "logp")


def loglinear_mix(events: DataFrame, models: Sequence[Model], weights: Sequence[float]) -> DataFrame:
    """Product of powers, normalised over the whole vocabulary in each distinct context."""
    s = score_all(events, models)
    each = [F.lit(float(w)) * to_log(F.col(f"p{k}")) for k, w in enumerate(weights)]
    s = s.withColumn("_log", sum(each[1:], each[0]))
    norm = vocabulary_sums(events, models, weights).select(F.col("ctx").alias("_z"), F.log10("total").alias("_norm"))
    out = s.join(norm, F.col("ctx") == F.col("_z"))
    return out.withColumn("logp", F.col("_log") - F.col("_norm")).select(*events.columns, "logp")


def cache_probs(events: DataFrame, stream: Sequence[str], order: Sequence[str], history: int) -> DataFrame:
    """``cache``: relative frequency of the word among the last ``history`` words of its stream; 0 at the start.

    The history of a position is a bounded window of rows; positions are numbered once per stream.
    """
    at = Window.partitionBy(*stream).orderBy(*order)
    rows = events.withColumn("_n", F.row_number().over(at))
    earlier = F.collect_list("w").over(at.rowsBetween(-history, -1))
    same = F.size(F.filter(earlier, lambda x: x == F.col("w")))
    return rows.withColumn("_h", F.least(F.col("_n") - 1, F.lit(history))).withColumn("cache", F.when(F.col("_h") > 0, same / F.col("_h")).otherwise(0.0)).drop("_n", "_h")


def with_cache(scored: DataFrame, weight: float) -> DataFrame:
    """Mix the cache into a model's probability; the sentence end is not cached."""
    mixed = (1 - weight) * power(F.col("logp")) + weight * F.col("cache")
    return scored.withColumn("logp", F.when(F.col("w") == EOS, F.col("logp")).otherwise(to_log(mixed)))


def by_state(events: DataFrame, models: dict[str, Model], state: str) -> DataFrame:
    """Each event under the model of its state."""
    parts = [lookup(events.where(F.col(state) == s), m) for s, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adapted(events: DataFrame, model: Model, marginals: DataFrame, beta: float = 0.5) -> DataFrame:
    """Probabilities scaled by (adapted / base unigram)**beta and normalised over the whole vocabulary; ``marginals`` has ``w``, ``p_adapt``, ``p_base``."""
    ratio = F.when((F.col("p_adapt") > 0) & (F.col("p_base") > 0), F.pow(F.col("p_adapt") / F.col("p_base"), beta)).otherwise(1.0)
    alpha = marginals.select("w", ratio.alias("alpha"))
    norm = vocabulary_sums(events, [model], weights=alpha).select(F.col("ctx").alias("_z"), F.col("total").alias("_norm"))
    s = lookup(events, model).join(alpha.withColumnRenamed("w", "_aw"), F.col("w") == F.col("_aw"), "left")
    s = s.withColumn("_p", power(F.col("logp")) * F.coalesce("alpha", F.lit(1.0)))
    out = s.join(norm, F.col("ctx") == F.col("_z"))
    return out.withColumn("logp", to_log(F.col("_p") / F.col("_norm"))).select(*events.columns, "logp")


def skip_mix(events: DataFrame, model: Model, skip: DataFrame, default: float = 0.5) -> DataFrame:
    """Mix of the context and the context without its last word; ``skip`` has ``w`` (the skipped word) and ``p``."""
    own = lookup(events, model, "_a")
    moved = own.withColumn("_keep", F.col("ctx")).withColumn("ctx", but_last(F.col("_keep")))
    both = lookup(moved, model, "_b").withColumn("ctx", F.col("_keep"))
    rate = skip.select(F.col("w").alias("_s"), F.col("p").alias("_q"))
    both = both.withColumn("_last", F.substring_index("ctx", " ", -1)).join(rate, F.col("_last") == F.col("_s"), "left")
    q = F.when(F.col("ctx") == "", F.lit(0.0)).otherwise(F.coalesce("_q", F.lit(default)))
    return both.withColumn("logp", to_log((1 - q) * power(F.col("_alogp")) + q * power(F.col("_blogp")))).select(*events.columns, "logp")


def stop_events(events: DataFrame, stop_words: Sequence[str], order: int) -> DataFrame:
    """Events whose contexts hold only words that are no stop words (contexts must be long enough to choose from)."""
    near = F.filter(F.split("ctx", " "), lambda w: ~w.isin(list(stop_words)))
    return events.withColumn("ctx", F.array_join(F.slice(near, F.greatest(F.lit(1), F.size(near) - (order - 2)), F.lit(order - 1)), " "))


def simple_class(events: DataFrame, model: Model, classes: DataFrame) -> DataFrame:
    """Words map to one class each (``w``, ``class``, ``p``): p(w given class) times p(class given classes)."""
    one = classes.select(F.col("w").alias("_w"), F.col("class").alias("_c"), F.col("p").alias("_p"))
    rows = events.withColumn("_id", F.monotonically_increasing_id())
    steps = rows.select("_id", F.posexplode(F.concat(F.split("ctx", " "), F.array("w"))).alias("_at", "_x")).join(one, F.col("_x") == F.col("_w"), "left")
    listed = steps.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_c", "_x").alias("c"), F.coalesce("_p", F.lit(1.0)).alias("p")))).alias("_l"))
    names = F.transform("_l", lambda x: x["c"])
    mapped = listed.select("_id", F.array_join(F.slice(names, 1, F.size(names) - 1), " ").alias("ctx"), F.element_at(names, -1).alias("w"), F.element_at("_l", -1)["p"].alias("_p"))
    scored = lookup(mapped, model).select("_id", (F.col("logp") + to_log(F.col("_p"))).alias("logp"))
    return rows.join(scored, "_id").drop("_id")


def sentence_boundary(events: DataFrame, model: Model, hidden: str = "<#s>") -> DataFrame:
    """The larger of the direct probability and that through a hidden sentence boundary."""
    direct = lookup(events, model, "_a")
    through = direct.withColumn("_keep", F.col("ctx")).withColumn("_kw", F.col("w"))
    to_mark = lookup(through.withColumn("w", F.lit(hidden)), model, "_b").withColumn("w", F.col("_kw"))
    from_mark = lookup(to_mark.withColumn("ctx", F.lit(hidden)), model, "_c").withColumn("ctx", F.col("_keep"))
    return from_mark.withColumn("logp", F.greatest("_alogp", F.col("_blogp") + F.col("_clogp"))).select(*events.columns, "logp")


def bytelog_model(model: Model) -> Model:
    """Probabilities and weights rounded to byte logs."""
    rounded = lambda c: F.when(F.col(c) == ZERO, F.col(c)).otherwise(from_bytelog(to_bytelog(F.col(c))))
    return Model(model.order, model.probs.withColumn("logp", rounded("logp")), model.bows.withColumn("bow", rounded("bow")))


def recogniser(events: DataFrame, model: Model) -> DataFrame:
    """Rounded model in which a backed-off probability wins if it is the larger one, at every order."""
    m = bytelog_model(model)
    value = None
    for k in range(1, m.order + 1):
        part = Model(k, m.probs.where(F.col("ord") <= k), m.bows.where(F.col("len") < k))
        rows = events if value is None else value
        rows = lookup(rows.withColumn("_keep", F.col("ctx")).withColumn("ctx", suffix(F.col("_keep"), k - 1)), part, f"_r{k}").withColumn("ctx", F.col("_keep")).drop("_keep")
        if k == 1:
            value = rows.withColumn("_v", F.col("_r1logp")).drop("_r1logp", "_r1hit")
        else:
            bows = m.bows.where(F.col("len") == k - 1).select(F.col("ctx").alias("_bc"), "bow")
            rows = rows.withColumn("_s", suffix(F.col("ctx"), k - 1)).join(bows, F.col("_s") == F.col("_bc"), "left")
            backed = F.col("_v") + F.coalesce("bow", F.lit(0.0))
            value = rows.withColumn("_v", F.when(F.col(f"_r{k}hit") == k, F.greatest(f"_r{k}logp", backed)).otherwise(backed)).drop(f"_r{k}logp", f"_r{k}hit", "_s", "_bc", "bow")
    return value.withColumn("logp", F.col("_v")).select(*events.columns, "logp")


def nonzero(scored: DataFrame, model: Model, stand_in: str = UNK) -> DataFrame:
    """Zero probabilities replaced by that of a stand-in word in the same context."""
    other = lookup(scored.drop("logp", "hit").withColumn("_kw", F.col("w")).withColumn("w", F.lit(stand_in)), model, "_z").withColumn("w", F.col("_kw")).drop("_kw")
    keys = [c for c in scored.columns if c not in ("logp", "hit")]
    both = scored.join(other.select(*keys, "_zlogp"), keys)
    return both.withColumn("logp", F.when(F.col("logp") == ZERO, F.col("_zlogp")).otherwise(F.col("logp"))).drop("_zlogp")


def tagged_lookup(events: DataFrame, model: Model, tags: DataFrame) -> DataFrame:
    """Bigram model over words and tags: word context, else its tag's context, else none; ``tags`` has ``w`` and ``tag``."""
    direct = lookup(events, model, "_a")
    tag = tags.select(F.col("w").alias("_tw"), "tag")
    rows = direct.join(tag, F.col("ctx") == F.col("_tw"), "left").withColumn("_keep", F.col("ctx")).withColumn("ctx", F.coalesce("tag", "ctx"))
    second = lookup(rows, model, "_b").withColumn("ctx", F.col("_keep"))
    weight = model.bows.where("len = 1").select(F.col("ctx").alias("_bc"), "bow")
    second = second.join(weight, F.col("_keep") == F.col("_bc"), "left")
    logp = F.when(F.col("_ahit") == 2, F.col("_alogp")).otherwise(F.coalesce("bow", F.lit(0.0)) + F.col("_blogp"))
    return second.withColumn("logp", logp).select(*events.columns, "logp")


def online_mixture_history(events: DataFrame) -> DataFrame:
    """The context without its oldest word, as adaptive mixtures keep it."""
    return events.withColumn("ctx", shorter(F.col("ctx")))
