"""Estimation of large back-off models over counts that are written once, bucketed and sorted.

Every n-gram of two words or more is kept in the bucket of the nearest word of its context, sorted by context. What the
estimation of an order needs then lies in one bucket: the context's total and types, the same word's probability
in all shorter contexts (they share the nearest word), and the shorter contexts' back-off weights. Only writing the counts
sends n-grams over the network; a word's unigram probability, which another bucket may hold, is attached on that way. Each
order's probabilities and weights are written in the same buckets, for the next order and for good.

N-grams under their order's least count are folded, on the way, into one meta row for each context and count: they
need no probability, but the context's total and types stay those of all its n-grams.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import last_word
from textloom.operators.counts import kn_counts
from textloom.operators.discount import Method, fit
from textloom.operators.estimate import backoff_weights, unigram_probs, vocabulary_of
from textloom.operators.score import ZERO, Model, context_length
from textloom.plans.session import cut, new_folder
from textloom.schema import EOS, EPSILON, META, NON_EVENTS, UNK

KEYS = ["near", "ctx"]
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def joins_inside_buckets(spark: SparkSession):
    """Tables bucketed by the nearest word may be joined on it and more columns as they lie."""
    before = spark.conf.get(CO_PARTITION, "true")
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def write_buckets(df: DataFrame, buckets: int, deal: bool = True) -> DataFrame:
    """``df`` as a table in buckets of ``near``, sorted by context; rows that lie so already are not dealt again."""
    name = f"buckets_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, "near") if deal else df
    rows.write.format("parquet").option("path", new_folder(df.sparkSession)).bucketBy(buckets, "near").sortBy(*KEYS).saveAsTable(name)
    return df.sparkSession.table(name)


def folded(level: DataFrame, least: float) -> DataFrame:
    """N-grams under the least count as meta rows: for each context and count, how many there were."""
    low = F.col("cnt") < least
    word = F.when(low, F.concat(F.lit(META), F.col("cnt").cast("string"))).otherwise(F.col("w"))
    rows = level.withColumns({"w": word, "cnt": F.when(low, 1).otherwise(F.col("cnt")), "p1": F.when(~low, F.col("p1"))})
    return rows.groupBy("near", "ctx", "w").agg(F.sum("cnt").alias("cnt"), F.max("p1").alias("p1"))


def level_rows(counts: DataFrame, n: int, uni: DataFrame) -> DataFrame:
    """The n-grams of one order that can get a probability, with the nearest word and their word's unigram probability ``p1``."""
    rows = counts.where((F.col("ord") == n) & ~F.col("w").isin(*NON_EVENTS, UNK) & ~F.col("w").startswith(META) & (last_word(F.col("ctx")) != EOS))
    return rows.join(uni.withColumnRenamed("p", "p1"), "w", "left").select(last_word(F.col("ctx")).alias("near"), "ctx", "w", "cnt", F.coalesce("p1", F.lit(0.0)).alias("p1"))


def _end(ctx: Column, words: int) -> Column:
    return F.array_join(F.slice(F.split(ctx, " "), -words, words), " ")


def with_lower(level: DataFrame, n: int, probs: dict[int, DataFrame], bows: dict[int, DataFrame]) -> DataFrame:
    """Add ``lowp``, the model's probability of the word in the context less its first word; all joins stay in the bucket."""
    out, value = level, F.col("p1")
    for k in range(2, n):  # from the shortest context to the one asked for
        out = out.withColumn("_s", _end(F.col("ctx"), k - 1))
        known = probs[k].select(F.col("near"), F.col("ctx").alias("_s"), "w", F.col("p").alias(f"_p{k}"))
        weight = bows[k].select(F.col("near"), F.col("ctx").alias("_s"), F.col("bow").alias(f"_b{k}"))
        out = out.join(known, ["near", "_s", "w"], "left").join(weight, ["near", "_s"], "left").drop("_s")
        value = F.coalesce(f"_p{k}", F.pow(F.lit(10.0), F.coalesce(f"_b{k}", F.lit(0.0))) * value)
    return out.select(*level.columns, value.alias("lowp"))


def discounted(level: DataFrame, method: Method, v: int) -> DataFrame:
    """``p`` of each n-gram as ``estimate.discounted`` has it; meta rows count for their context's figures only."""
    context = Window.partitionBy(*KEYS)
    meta = F.col("w").startswith(META)
    kind = F.when(meta, F.expr(f"try_cast(substring(w, {len(META) + 1}) as double)")).otherwise(F.col("cnt"))
    times = F.when(meta, F.col("cnt")).otherwise(F.lit(1))
    figures = {"total": F.sum(kind * times), "types": F.sum(F.when(kind > 0, times).otherwise(0)), "types2": F.sum(F.when(kind > 1, times).otherwise(0)), "types3": F.sum(F.when(kind > 2, times).otherwise(0))}
    rows = level.withColumns({name: x.over(context) for name, x in figures.items()})
    rows = rows.withColumn("_d", F.when(~meta, method.factor(v)))
    mixed = F.col("_d") * F.col("cnt") / F.col("total") + (method.lower_weight(v) * F.col("lowp") if method.interpolate else F.lit(0.0))
    rows = rows.withColumn("p", F.when(F.col("_d") == 0, 0.0).otherwise(mixed))
    rows = rows.withColumns({"_sum": F.sum("p").over(context), "_kept": F.sum(F.col("_d") * F.col("cnt")).over(context)}).where(~meta)
    short = (1 - F.col("_sum") <= EPSILON) & (F.col("types") < v)
    grown = F.when(1 - F.col("_kept") / F.col("total") > EPSILON, F.col("total")).otherwise(F.greatest(F.col("total").cast("double"), F.floor(F.col("_kept") / (1 - EPSILON)) + 1))
    return rows.select(*KEYS, "w", "lowp", "types", F.when(short, F.col("_d") * F.col("cnt") / grown).otherwise(F.col("p")).alias("p"))


def train(counts: DataFrame, order: int, method: str | Sequence[str] = "gt", *, buckets: int = 64, interpolate: bool = False, min_counts: dict[int, int] | None = None, delta: float = 0.5) -> Model:
    """The model that ``estimate.train`` makes, from counts written in buckets, for models that no memory holds."""
    spark = counts.sparkSession
    names = [method] * order if isinstance(method, str) else list(method)
    counts = cut(counts)
    if any(m in ("kn", "mkn") for m in names):
        counts = cut(kn_counts(counts, order).where("cnt > 0"))
    lows = min_counts or {}
    methods = {n: fit(names[n - 1], counts, n, interpolate=interpolate, min_count=lows.get(n), delta=delta) for n in range(1, order + 1)}
    v = vocabulary_of(counts).count()
    first = counts.where((F.col("ord") == 1) & ~F.col("w").isin(UNK) & ~F.col("w").startswith(META))
    uni = cut(unigram_probs(first, methods[1], v))
    log = lambda p: F.when(p > 0, F.log10(p)).otherwise(F.lit(ZERO))
    start = first.where(F.col("w").isin(*NON_EVENTS)).select(F.lit(1).alias("ord"), F.lit("").alias("ctx"), "w", F.lit(ZERO).alias("logp"))
    shown = [uni.select(F.lit(1).alias("ord"), F.lit("").alias("ctx"), "w", log(F.col("p")).alias("logp")).unionByName(start)]
    probs: dict[int, DataFrame] = {}
    bows: dict[int, DataFrame] = {}
    with joins_inside_buckets(spark):
        for n in range(2, order + 1):
            dealt = level_rows(counts, n, uni).repartition(buckets, "near")
            level = write_buckets(folded(dealt, methods[n].min_count), buckets, deal=False)
            rows = write_buckets(discounted(with_lower(level, n, probs, bows), methods[n], v), buckets, deal=False)
            bows[n] = write_buckets(backoff_weights(rows, v, KEYS), buckets, deal=False)
            scaled = rows.where("p > 0").join(bows[n].select(*KEYS, "scale"), KEYS)
            probs[n] = write_buckets(scaled.select(*KEYS, "w", (F.col("p") * F.col("scale")).alias("p")), buckets, deal=False)
            shown.append(probs[n].select(F.lit(n).alias("ord"), "ctx", "w", log(F.col("p")).alias("logp")))
    empty = spark.createDataFrame([], "len int, ctx string, bow double")
    weights = [b.select(context_length(F.col("ctx")).alias("len"), "ctx", "bow") for b in bows.values()]
    return Model(order, reduce(DataFrame.unionByName, shown), reduce(DataFrame.unionByName, weights, empty))
