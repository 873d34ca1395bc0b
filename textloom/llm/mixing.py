"""Mixing sources to target weights by Pareto order sampling.

Targets: sources, by code point with null last, have the weights of a repeating list and share ``share``
times all words; a target stops at ``ceiling`` times its source's words and what it leaves is shared
again by weight (water filling: the level is found by a few aggregates over one row per source).

Documents: a source's ratio of target to words gives every document its certain whole copies, the
integer part. The rest, the fractional part of the ratio times the source's words, is a sample by Pareto order:
document i has the inclusion probability p = min(1, c w), where w is its relative weight (1 if none is given) and
c makes the expected words those wanted; it draws u and is ranked by the odds u/(1-u) over the odds p/(1-p).
The sample has a fixed size, in two parts so that long documents keep their probability:

* documents over ``apart`` of the words wanted are taken by number: the first n in order, n the sum of their p
  rounded down or up at random;
* the others fill what is then left of the words: the first in order whose running sum fits, and the one that
  crosses the end with the probability that it fits.

Ranks and sums come from range-partitioned running totals, so a source with a third of all rows is spread
over many tasks. Draws are hashes of the id, of the text where the id is null: reruns agree.

Null texts have size 0; documents of size 0 take part and take nothing; long texts are measured whole. A null source
is the last source. Rows equal in id, source and text are alike: they are taken as often as the sample takes them,
dealt out by number. A source without words has target 0. An empty table gives an empty result. Columns of the
caller never clash: only id, source and text are read, and ``mix`` returns the caller's columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, guarded, running_totals, unit_draw, word_count


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0
) -> DataFrame:
    """One row per source: its words ``source_size``, ``weight`` and ``target``."""
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    per = running_totals(per, [], [F.col(source).asc_nulls_last()], prefix="_t_")
    turn = F.pmod(F.col("_t_rank") - 1, F.lit(len(weights))).cast("int")
    per = cut(per.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[turn]).drop("_t_rank"))
    level = water_level(per, share, ceiling)
    target = F.least(F.col("source_size") * F.lit(float(ceiling)), F.col("weight") * F.lit(level))
    return per.withColumn("target", target)


def water_level(per: DataFrame, share: float, ceiling: float) -> float:
    """The level at which the targets min(ceiling * words, weight * level) add up to the share of all words."""
    cap = F.col("source_size") * F.lit(float(ceiling))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at_cap = cap < F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        held, weight, count = per.agg(
            F.sum(F.when(at_cap, cap).otherwise(0.0)), F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))), F.sum(F.when(at_cap, 1).otherwise(0))
        ).first()
        if count is None or count == full or not weight:
            return level
        level, full = (share * total - held) / weight, count


def sample_copies(
    docs: DataFrame, *, group: str, size: str, target: str, source_size: str, draw: Column, group_draw: Callable[[str], Column], order: Sequence[str], relative: Column | None = None, apart: float = 0.05
) -> DataFrame:
    """Add ``copies``: how often each document is taken. ``group_draw(salt)`` draws one number per group."""
    ratio = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    df = docs.withColumn("_whole", F.floor(ratio).cast("long")).withColumn("_u", draw).withColumn("_w", (F.lit(1.0) if relative is None else relative).cast("double"))
    df = df.withColumn("_gap", F.col(target) - F.col("_whole") * F.col(source_size))
    if relative is None:
        p = F.when(F.col(source_size) > 0, F.col("_gap") / F.col(source_size)).otherwise(0.0)
    else:
        df = cut(df)
        scale = inclusion_scale(df, group, size)
        df = df.join(scale, F.col(group).eqNullSafe(F.col("_sg")), "left").drop("_sg")
        p = F.least(F.coalesce(F.col("_scale"), F.lit(0.0)) * F.col("_w"), F.lit(1.0))
    df = df.withColumn("_p", p)
    odds = F.when(F.col("_p") >= 1, F.lit(0.0)).otherwise((F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p"))))
    may = (F.col(size) > 0) & (F.col("_gap") > 0) & (F.col("_p") > 0)
    df = cut(df.withColumn("_may", may).withColumn("_large", F.col(size) > F.col("_gap") * F.lit(float(apart))))
    ranked = running_totals(df.where("_may").withColumn("_odds", odds), [group, "_large"], [F.col("_odds"), *[F.col(c).asc_nulls_last() for c in order], F.col(size)], size, prefix="_r_")
    ranked = cut(ranked)
    wanted = ranked.where("_large").groupBy(F.col(group).alias("_g")).agg(F.sum("_p").alias("_n"))
    wanted = wanted.select("_g", (F.floor("_n") + (group_draw("_g") < F.col("_n") - F.floor("_n")).cast("long")).alias("_n"))
    large = ranked.where("_large").join(wanted, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    large = cut(large.withColumn("_extra", (F.col("_r_rank") <= F.col("_n")).cast("long")).drop("_n"))
    used = large.where("_extra = 1").groupBy(F.col(group).alias("_g")).agg(F.sum(size).alias("_used"))
    small = ranked.where("not _large").join(used, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    left = F.col("_gap") - F.coalesce("_used", F.lit(0))
    before = F.col("_r_total") - F.col(size)
    crossing = (before < left) & (F.col("_r_total") > left) & (group_draw(group, "end") * F.col(size) < left - before)
    small = small.withColumn("_extra", ((F.col("_r_total") <= left) | crossing).cast("long")).drop("_used")
    out = df.where("not _may").withColumn("_extra", F.lit(0).cast("long"))
    for part in (large, small):
        out = out.unionByName(part.drop("_odds", "_r_rank", "_r_total"))
    return out.withColumn("copies", F.col("_whole") + F.col("_extra")).drop("_whole", "_u", "_w", "_gap", "_p", "_may", "_large", "_extra", "_scale")


def inclusion_scale(df: DataFrame, group: str, size: str, rounds: int = 40) -> DataFrame:
    """Per group (``_sg``) the ``_scale`` c at which the sizes times min(1, c weight) add up to the group's gap.

    Documents that reach 1 are counted in full and the rest is scaled again, until none is new; the documents meet
    first in one row per group, size and weight.
    """
    some = df.where((F.col(size) > 0) & (F.col("_w") > 0) & (F.col("_gap") > 0))
    slim = cut(some.groupBy(F.col(group).alias("_sg"), F.col(size).alias("_s"), "_w", "_gap").agg(F.count(F.lit(1)).alias("_n")))
    scale = slim.groupBy("_sg").agg((F.max("_gap") / F.sum(F.col("_n") * F.col("_s") * F.col("_w"))).alias("_scale"))
    full = -1
    for _ in range(rounds):
        scale = cut(scale)
        joined = slim.join(scale.withColumnRenamed("_sg", "_g"), F.col("_sg").eqNullSafe(F.col("_g"))).drop("_g")
        sure = F.col("_scale") * F.col("_w") >= 1
        now = joined.where(sure).agg(F.sum("_n")).first()[0] or 0
        if now == full or not now:
            break
        full = now
        words = F.col("_n") * F.col("_s")
        open_words = F.sum(F.when(sure, 0.0).otherwise(words * F.col("_w")))
        again = (F.max("_gap") - F.sum(F.when(sure, words).otherwise(0))) / open_words
        scale = joined.groupBy("_sg").agg(F.greatest(F.max("_scale"), F.when(open_words > 0, again)).alias("_scale"))
    return scale


def mix_sizes(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", relative: Column | None = None, apart: float = 0.05, **targets) -> DataFrame:
    """One row per document: id, source, ``size``, ``source_size``, ``target``, ``copies``.

    ``relative`` is the weight of a document in its source, a positive expression over ``size``, ``_id`` and ``_source``.
    """
    return _mixed(docs, id_col, source, text, seed, relative, apart, **targets).drop("_hash").withColumnsRenamed({"_id": id_col, "_source": source})


def _mixed(docs: DataFrame, id_col: str, source: str, text: str, seed: str, relative: Column | None, apart: float, **targets) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    slim = cut(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), F.xxhash64(body).alias("_hash")))
    per = cut(source_targets(slim, "_source", "size", **targets)).select(F.col("_source").alias("_s"), "source_size", "target")
    # one row per source: the adaptive join broadcasts it if it is small and splits a hot source if it is not
    joined = slim.join(per, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("text "), F.col("_hash").cast("string")))
    return sample_copies(
        joined, group="_source", size="size", target="target", source_size="source_size", draw=unit_draw(seed, key), order=["_id", "_hash"], relative=relative, apart=apart,
        group_draw=lambda column, salt="number": unit_draw(f"{seed} {salt}", F.col(column)),
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", relative: Column | None = None, apart: float = 0.05, **targets) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken."""
    copies = _mixed(docs, id_col, source, text, seed, relative, apart, **targets)
    per_row = copies.groupBy(F.col("_id").alias("_k"), F.col("_source").alias("_ks"), F.col("_hash").alias("_kh"))
    per_row = cut(per_row.agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"))
    own, names = guarded(docs)
    own = own.withColumn("_h", F.xxhash64(F.coalesce(F.col(names[text]), F.lit(""))))
    match = F.col(names[id_col]).eqNullSafe(F.col("_k")) & F.col(names[source]).eqNullSafe(F.col("_ks")) & (F.col("_h") == F.col("_kh"))
    whole, over = F.expr("_copies div _rows"), F.expr("_copies % _rows")
    dealt = own.join(per_row, match).drop("_k", "_ks", "_kh")
    even = dealt.where(over == 0).withColumn("_times", whole).select(*names.values(), "_times")
    if not per_row.where(over > 0).isEmpty():  # rows alike in id, source and text: the first by number get one more
        numbered = running_totals(dealt.where(over > 0).withColumn("_place", F.monotonically_increasing_id()), [names[id_col], names[source], "_h"], [F.col("_place")], prefix="_n_")
        even = even.unionByName(numbered.withColumn("_times", whole + (F.col("_n_rank") <= over).cast("long")).select(*names.values(), "_times"))
    taken = even.where("_times > 0").withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return taken.select(*names.values()).toDF(*docs.columns)
