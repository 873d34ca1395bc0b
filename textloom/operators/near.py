"""Witten-Bell estimation over n-grams that are dealt once, by the nearest word of their context.

All that a context's probabilities hang on then lies in one task: its total and types, and its words' counts in the shorter
context, which shares the nearest word. N-grams travel packed: a block's n-grams behind one word are one text, without that word.
Probabilities of single words lie elsewhere. They decide only what the shorter order scales up because its context has
seen nearly all words; such contexts are told by their types alone, and are looked up apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.sequences import with_boundaries
from textloom.operators.bigmodel import joins_inside_buckets
from textloom.operators.discount import fit
from textloom.operators.estimate import discounted, unigram_probs, vocabulary_of, weighed
from textloom.operators.score import Model, lookup, text_stats
from textloom.plans.session import cut
from textloom.schema import EOS, EPSILON, META, NON_EVENTS, UNK


def predictable(near: Column, w: Column) -> Column:
    """Whether a model has n-grams of the word behind the nearest word."""
    return ~w.isin(*NON_EVENTS, UNK) & ~w.startswith(META) & (near != EOS)


def dealt(sents: DataFrame, order: int, by: Sequence[str] = (), every: bool = False, block: str = "block", parts: int | None = None) -> DataFrame:
    """Counts ``n`` of the longest n-gram that ends at each place behind a sentence's first: ``near``, the word before; ``first``,
    the words before that (empty at the sentence start); ``w``. Without ``every``, of those that a model has.

    Sentences lie dealt by ``block``, and the counts by ``near``, in ``parts`` where shuffles have fewer; a block's n-grams of one count behind one word travel as one text.
    """
    rows = sents.select(*by, block, with_boundaries(F.col("words")).alias("_words")).select(*by, block, "_words", F.posexplode_outer("_words").alias("_at", "w")).where("_at > 0")
    back = [F.get("_words", F.col("_at") - k) for k in range(order - 1, 0, -1)]
    rows = rows.select(*by, block, back[-1].alias("near"), F.concat_ws(" ", *back[:-1], "w").alias("_rest"), "w")
    if not every:
        rows = rows.where(predictable(F.col("near"), F.col("w")))
    rows = rows.groupBy(*by, block, "near", "_rest").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.groupBy(*by, block, "near", "_n").agg(F.array_join(F.collect_list("_rest"), "\n").alias("_texts")).drop(block)
    more = parts is not None and parts > int(sents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "near") if more else rows.repartition("near")
    rows = rows.select(*by, "near", "_n", F.explode(F.split("_texts", "\n")).alias("_rest")).groupBy(*by, "near", "_rest").agg(F.sum("_n").alias("n"))
    w = F.substring_index("_rest", " ", -1)
    first = F.when(F.locate(" ", F.col("_rest")) == 0, "").otherwise(F.expr("substring(_rest, 1, length(_rest) - length(substring_index(_rest, ' ', -1)) - 1)"))
    return rows.select(*by, "near", first.alias("first"), w.alias("w"), "n")


def words_and_least(unigrams: DataFrame) -> tuple[int, float]:
    """How many words a model of these counts predicts, and the least probability of one."""
    unigrams = cut(unigrams)
    v = vocabulary_of(unigrams).count()
    if not v:
        return 0, 0.0
    known = unigrams.where(~F.col("w").isin(UNK) & ~F.col("w").startswith(META))
    return v, unigram_probs(known, fit("wb", unigrams, 1), v).agg(F.min("p")).first()[0]


def wide(v: int, least: float) -> Column:
    """Whether a context of ``types`` may have seen all words but some of no more mass than estimation takes for none (twice that, for roundings)."""
    return (v - F.col("types")) * F.lit(least) <= 2 * EPSILON


def text_by_itself(sents: DataFrame, unigrams: DataFrame, by: str, model_for: Callable[[DataFrame], Model], parts: int | None = None) -> DataFrame:
    """``text_stats`` of a text by the column ``by`` under the text's own Witten-Bell bigram model, which is not written.

    What single words' probabilities decide (words that no model predicts, behind a sentence end, or in a wide context) is
    looked up in the model that ``model_for`` gives for these events.
    """
    v, least = words_and_least(unigrams)
    # a pair's list is as long as the texts' kinds
    pairs = dealt(sents, 2, [by], every=True, parts=parts).groupBy("near", "w").agg(F.sum("n").alias("_n"), F.collect_list(F.struct(by, "n")).alias("_l"))
    level = pairs.select(F.col("near").alias("ctx"), "w", F.when(predictable(F.col("near"), F.col("w")), F.col("_n")).alias("cnt"), F.lit(None).cast("double").alias("lowp"), "_l")
    rows = discounted(level, None, fit("wb", unigrams, 2), v).withColumn("_aside", F.col("p").isNull() | wide(v, least))
    rows = rows.select("ctx", "w", "_aside", F.log10("p").alias("logp"), F.inline("_l"))
    apart = lambda c: F.when(F.col("_aside"), F.col(c)).alias(c)
    rows = rows.select(by, apart("ctx"), apart("w"), (F.col("w") == EOS).alias("_end"), "n", (F.col("n") * F.col("logp")).alias("_log"))
    sums = cut(rows.groupBy(by, "ctx", "w", "_end").agg(F.sum("n").alias("n"), F.sum("_log").alias("_log")))
    none = F.lit(0).cast("long")
    stats = sums.where("ctx is null").groupBy(by).agg(
        F.sum(F.when(F.col("_end"), F.col("n")).otherwise(0)).alias("sentences"), F.sum(F.when(F.col("_end"), 0).otherwise(F.col("n"))).alias("words"),
        F.max(none).alias("oovs"), F.max(none).alias("zeroprobs"), F.sum("_log").alias("logprob"),
    )
    events = sums.where("ctx is not null").select(by, "ctx", "w", "n")
    if not events.isEmpty():
        stats = stats.unionByName(text_stats(lookup(events, model_for(events), every=True), [by], weight=F.col("n")))
        stats = stats.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("sentences", "words", "oovs", "zeroprobs", "logprob")])
    return stats


def top_trigrams(sents: DataFrame, unigrams: DataFrame, model_for: Callable[[DataFrame], Model], parts: int | None = None) -> DataFrame:
    """The trigrams of a text's Witten-Bell model, as ``estimate.weighed`` has them; contexts without one have no row.

    The bigrams below them have no least count, so each is in the model. Those of wide contexts are looked up in the bigram model
    that ``model_for`` gives for them.
    """
    v, least = words_and_least(unigrams)
    two, three = fit("wb", unigrams, 2), fit("wb", unigrams, 3)
    if two.min_count > 1:
        raise ValueError("bigrams under a least count are not looked up")
    none = F.lit(None).cast("double").alias("lowp")
    rows = dealt(sents, 3, parts=parts)
    pairs = rows.groupBy("near", "w").agg(F.sum("n").alias("cnt"))
    low = discounted(pairs.select("near", "w", "cnt", none), None, two, v, ("near",))
    low = low.select(F.col("near").alias("_near"), F.col("w").alias("_w"), F.col("p").alias("lowp"), wide(v, least).alias("_wide"))
    level = rows.where("first <> ''").select("near", F.concat_ws(" ", "first", "near").alias("ctx"), "w", F.col("n").alias("cnt"), none)
    keys = ("near", "ctx")
    high = discounted(level, None, three, v, keys).where("p > 0").drop("lowp")
    met = high.join(low, (F.col("near") == F.col("_near")) & (F.col("w") == F.col("_w")))
    with joins_inside_buckets(sents.sparkSession):
        top = cut(weighed(met, keys, ("near", "p", "_wide")))
    shown = ["ctx", "w", "logp", "lowlog", "bow", "one"]
    some = top.where("_wide")
    if some.isEmpty():
        return top.select(*shown)
    events = some.select(F.col("ctx").alias("_ctx"), F.col("near").alias("ctx"), "w", "p")
    found = lookup(events, model_for(events), "_", every=True)
    found = found.select(F.col("_ctx").alias("ctx"), "w", "p", F.pow(F.lit(10.0), F.col("_logp")).alias("lowp"))
    return top.where("not _wide").select(*shown).unionByName(weighed(found).select(*shown))
