"""Maximum entropy n-gram models of any order, with sparse (L1) and Gaussian (L2) regularisation.

A feature is an n-gram; a word's weight in a context is the sum of the weights of the n-grams that end there. Weights stay
in a table with one row per feature. Two fixed tables say which features a feature ends in, and which contexts a context ends
in; an evaluation of the objective and its gradient is a join and an aggregate along them in either direction:

* the sum of a feature's weight and those of all it ends in;
* a context's normaliser, the sum of what each context it ends in changes by its own features;
* a context's share of events over its normaliser, added to every context it ends in;
* a feature's expected share, the sum of what every feature that ends in it gains over its own suffix.

So no context is crossed with the vocabulary, and since the fixed tables lie partitioned by the keys they are joined on, an
evaluation exchanges only weights and sums. The optimiser is a limited-memory quasi-Newton method with projection onto
orthants: its history is a few columns beside the weights, all dot products among history and gradient come from one
aggregate, and only their small matrix reaches the driver, which turns it into coefficients of the next direction.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.sequences import shorter
from textloom.operators.score import Model, context_length
from textloom.plans.session import cut_in_place as cut
from textloom.schema import BOS

#: Fixed values of the optimiser that users of such models know: history, sufficient decrease, and when to stop.
HISTORY, DECREASE, GRADIENT, PAST, CHANGE = 5, 1e-4, 1e-7, 5, 1e-4
ALPHA, SIGMA2 = 0.5, 6.0


def feature_id(n: Column, ctx: Column, w: Column) -> Column:
    return F.xxhash64(n, ctx, w)


def context_id(ctx: Column) -> Column:
    return F.xxhash64(F.lit(-1), ctx)


def is_feature() -> Column:
    return F.col("w") != BOS


@dataclass
class Shape:
    """The fixed tables: ``up`` (f, anc: each feature and those it ends in) by either column, and ``over`` (c, anc) of contexts."""

    up_by_anc: DataFrame
    up_by_f: DataFrame
    over_by_anc: DataFrame
    over_by_c: DataFrame


def shape_of(rows: DataFrame, contexts: DataFrame) -> Shape:
    """The tables of features (``ord``, ``ctx``, ``w``) and contexts (``ctx``, ``n``)."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    words = F.when(F.col("ctx") == "", F.array().cast("array<string>")).otherwise(F.split("ctx", " "))
    ends = F.transform(F.sequence(F.lit(0), F.size(words)), lambda k: F.array_join(F.slice(words, k + 1, F.size(words) - k), " "))
    up = rows.select("ord", "w", feature_id(F.col("ord"), F.col("ctx"), F.col("w")).alias("f"), context_id(F.col("ctx")).alias("cid"), F.posexplode(ends).alias("cut", "end"))
    up = cut(up.select("f", "cid", "ord", feature_id(F.col("ord") - F.col("cut"), F.col("end"), F.col("w")).alias("anc")).repartition(width, "anc"))
    over = contexts.select(context_id(F.col("ctx")).alias("c"), "n", F.explode(ends).alias("end")).select("c", "n", context_id(F.col("end")).alias("anc"))
    over = cut(over.repartition(width, "anc"))
    return Shape(up, cut(up.select("f", "anc").repartition(width, "f")), over, cut(over.select("c", "anc").repartition(width, "c")))


def structure(counts: DataFrame, order: int, prior: DataFrame | None = None, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Features with their share ``k`` of all events, contexts with their share ``n``, and the number of events.

    An event counts once, in its longest context: what an n-gram's longer n-grams account for is subtracted from it. With a
    ``prior`` (``ord``, ``ctx``, ``w``, ``lam``) its n-grams are the features, and events in contexts without any are left out.
    Words of ``vocabulary`` that were not seen get a feature too, and so a probability.
    """
    own = counts.where((F.col("ord") <= order) & is_feature()).select("ord", "ctx", "w", F.col("cnt").cast("double").alias("cnt"))
    longer = own.where("ord > 1").groupBy((F.col("ord") - 1).alias("ord"), shorter(F.col("ctx")).alias("ctx"), "w").agg(F.sum("cnt").alias("_l"))
    alone = own.join(longer, ["ord", "ctx", "w"], "left").withColumn("n", F.greatest(F.col("cnt") - F.coalesce("_l", F.lit(0.0)), F.lit(0.0)))
    if prior is None:
        feats = own.select("ord", "ctx", "w", F.lit(0.0).alias("prior"))
    else:
        feats = prior.select("ord", "ctx", "w", F.col("lam").alias("prior"))
        alone = alone.join(feats.select("ctx").distinct(), "ctx", "left_semi")
    if vocabulary is not None:
        new = vocabulary.select("w").distinct().where(is_feature()).join(feats.where("ord = 1").select("w"), "w", "left_anti")
        feats = feats.unionByName(new.select(F.lit(1).alias("ord"), F.lit("").alias("ctx"), "w", F.lit(0.0).alias("prior")))
    alone = cut(alone.where("n > 0").select("ord", "ctx", "w", "n"))
    total = alone.agg(F.sum("n")).first()[0] or 1.0
    # a feature's share: its own events and those of all longer n-grams that end in it
    share, level = [], None
    for k in range(order, 0, -1):
        here = alone.where(F.col("ord") == k).select("ctx", "w", "n")
        if level is not None:
            here = here.unionByName(level.select(shorter(F.col("ctx")).alias("ctx"), "w", "n")).groupBy("ctx", "w").agg(F.sum("n").alias("n"))
        level = here
        share.append(here.select(F.lit(k).alias("ord"), "ctx", "w", (F.col("n") / F.lit(total)).alias("k")))
    rows = feats.join(reduce(DataFrame.unionByName, share), ["ord", "ctx", "w"], "left")
    width = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    named = rows.select("ord", "ctx", "w", F.coalesce("k", F.lit(0.0)).alias("k"), "prior", feature_id(F.col("ord"), F.col("ctx"), F.col("w")).alias("fid"))
    rows = cut(named.repartition(width, "fid"))
    per = alone.groupBy("ctx").agg((F.sum("n") / F.lit(total)).alias("n"))
    contexts = rows.select("ctx").distinct().join(per, "ctx", "left").select("ctx", F.coalesce("n", F.lit(0.0)).alias("n"))
    return rows, cut(contexts), total


# ---- one evaluation ----


def weight_sums(rows: DataFrame, shape: Shape) -> DataFrame:
    """``f``, ``cid``, ``ord``, ``s`` (the sum of the weights of all that a feature ends in) and ``below`` (that without its own)."""
    met = shape.up_by_anc.join(rows.select(F.col("fid").alias("anc"), "x"), "anc")
    sums = met.groupBy("f").agg(F.first("cid").alias("cid"), F.first("ord").alias("ord"), F.sum("x").alias("s"), F.sum(F.when(F.col("f") == F.col("anc"), F.col("x"))).alias("x"))
    return sums.select("f", "cid", "ord", "s", (F.col("s") - F.col("x")).alias("below"))


def gain() -> Column:
    """What a feature adds to the mass of its context over its suffix; a word's own feature adds all."""
    return F.when(F.col("ord") == 1, F.exp("s")).otherwise(F.exp("s") - F.exp("below"))


def normalisers(sums: DataFrame, shape: Shape) -> DataFrame:
    """``c``, ``n``, ``z`` of every context."""
    change = sums.groupBy(F.col("cid").alias("anc")).agg(F.sum(gain()).alias("_d"))
    return shape.over_by_anc.join(change, "anc").groupBy("c").agg(F.first("n").alias("n"), F.sum("_d").alias("z"))


def expectations(sums: DataFrame, normal: DataFrame, shape: Shape) -> DataFrame:
    """``fid`` and ``e``, the share of events that the model expects of each feature."""
    own = normal.where("n > 0").select("c", (F.col("n") / F.col("z")).alias("a"))
    share = shape.over_by_c.join(own, "c").groupBy(F.col("anc").alias("cid")).agg(F.sum("a").alias("a"))
    rows = sums.join(share, "cid").select("f", (gain() * F.col("a")).alias("g"), F.when(F.col("ord") == 1, 0.0).otherwise(F.exp("below") * F.col("a")).alias("base"))
    part = F.col("g") + F.when(F.col("f") == F.col("anc"), F.col("base")).otherwise(0.0)
    return shape.up_by_f.join(rows, "f").groupBy(F.col("anc").alias("fid")).agg(F.sum(part).alias("e"))


def evaluate(rows: DataFrame, shape: Shape, variance: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the gradient ``g`` at ``x``, and the normalisers."""
    rows = cut(rows)  # else the step's expression is repeated wherever a weight is read
    sums = cut(weight_sums(rows, shape))
    normal = cut(normalisers(sums, shape))
    g = F.coalesce("e", F.lit(0.0)) - F.col("k") + ((F.col("x") - F.col("prior")) / F.lit(variance) if variance > 0 else F.lit(0.0))
    return rows.join(expectations(sums, normal, shape), "fid", "left").withColumn("g", g).drop("e"), normal


def objective(normal: DataFrame, linear: float, penalty: float, variance: float) -> float:
    """The dual: expected log normaliser less the weights' share, plus the Gaussian penalty."""
    dual = normal.where("n > 0").agg(F.sum(F.col("n") * F.log("z"))).first()[0] or 0.0
    return dual - linear + (0.5 * penalty / variance if variance > 0 else 0.0)


# ---- the optimiser ----


def pseudo_gradient(c1: float) -> Column:
    """The gradient of the objective with the sparse penalty; zero where no step off zero pays."""
    x, g, c = F.col("x"), F.col("g"), F.lit(c1)
    return F.when(x > 0, g + c).when(x < 0, g - c).when(g < -c, g + c).when(g > c, g - c).otherwise(0.0)


def _scalars(rows: DataFrame, depth: int) -> dict:
    """All dot products among the history and the gradient, and the norms, in one aggregate: each row gives its products by pair."""
    basis = F.array(*[F.col(f"{n}{i}") for n in "sy" for i in range(depth)], F.col("pg"))
    size = 2 * depth + 1
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(i, size)])
    each = rows.select(F.explode(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), (F.get(basis, p["i"]) * F.get(basis, p["j"])).alias("v")))).alias("p"))
    dots = {f"d{r['i']}_{r['j']}": r["v"] for r in each.groupBy("p.i", "p.j").agg(F.sum("p.v").alias("v")).collect()}
    return dots


def _direction(dots: dict, depth: int) -> list[float]:
    """Coefficients of the quasi-Newton direction in the basis of history and gradient (the two-loop recursion on dot products)."""
    size = 2 * depth + 1
    at = lambda i, j: dots[f"d{min(i, j)}_{max(i, j)}"]
    against = lambda coef, j: sum(c * at(i, j) for i, c in enumerate(coef) if c)
    coef = [0.0] * size
    coef[-1] = -1.0
    alpha = [0.0] * depth
    for i in range(depth):  # newest first
        alpha[i] = against(coef, i) / at(i, depth + i)
        coef[depth + i] -= alpha[i]
    if depth:
        scale = at(0, depth) / at(depth, depth)
        coef = [c * scale for c in coef]
    for i in range(depth - 1, -1, -1):
        beta = against(coef, depth + i) / at(i, depth + i)
        coef[i] += alpha[i] - beta
    return coef


def fit(counts: DataFrame, order: int, *, alpha: float = ALPHA, sigma2: float = SIGMA2, prior: DataFrame | None = None, vocabulary: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """Weights ``ord``, ``ctx``, ``w``, ``lam`` of the model that minimises the regularised dual.

    ``alpha`` is the sparse penalty and ``sigma2`` the variance of the Gaussian one, both for counts (they are scaled by the number
    of events); ``prior`` holds the weights that the Gaussian penalty draws to. It ends when the gradient vanishes or
    five rounds change the objective by less than a ten-thousandth.
    """
    rows, contexts, total = structure(counts, order, prior, vocabulary)
    shape = shape_of(rows, contexts)
    variance, c1 = sigma2 * total, alpha / total
    rows = rows.withColumn("x", F.lit(0.0))
    linear, penalty = 0.0, rows.agg(F.sum(F.col("prior") * F.col("prior"))).first()[0] or 0.0
    new, normal = evaluate(rows, shape, variance)
    rows = cut(new.withColumn("pg", pseudo_gradient(c1)))
    values = [objective(normal, linear, penalty, variance)]
    depth, size = 0, 0.0
    for step in range(max_rounds):
        dots = _scalars(rows, depth)
        slope = math.sqrt(max(dots[f"d{2 * depth}_{2 * depth}"], 0.0))
        if slope <= GRADIENT * max(1.0, math.sqrt(size)):
            break
        coef = _direction(dots, depth)
        basis = [F.col(f"s{i}") for i in range(depth)] + [F.col(f"y{i}") for i in range(depth)] + [F.col("pg")]
        d = reduce(lambda a, b: a + b, [b * F.lit(c) for b, c in zip(basis, coef, strict=True)])
        d = F.when(d * F.col("pg") < 0, d).otherwise(0.0)
        side = F.when(F.col("x") != 0, F.signum("x")).otherwise(-F.signum("pg"))
        width = 1.0 if step else 1.0 / slope
        found = None
        while width > 1e-20:
            moved = F.col("x") + F.lit(width) * d
            trial = rows.withColumn("_x", F.when(moved * side > 0, moved).otherwise(0.0) if c1 > 0 else moved)
            tried = trial.select(*[c for c in trial.columns if c not in ("x", "g")], F.col("_x").alias("x"), F.col("x").alias("_old"), F.col("g").alias("_g")).drop("_x")
            new, normal = evaluate(tried, shape, variance)
            new = cut(new)
            told = new.agg(
                F.sum(F.col("x") * F.col("k")).alias("linear"), F.sum(F.pow(F.col("x") - F.col("prior"), 2)).alias("penalty"), F.sum(F.abs("x")).alias("sparse"), F.sum(F.col("x") * F.col("x")).alias("size"),
                F.sum(F.col("pg") * (F.col("x") - F.col("_old"))).alias("drop"),
            ).first()
            value = objective(normal, told["linear"] or 0.0, told["penalty"] or 0.0, variance) + c1 * (told["sparse"] or 0.0)
            if value <= values[-1] + DECREASE * (told["drop"] or 0.0):
                found, size = value, told["size"] or 0.0
                break
            width /= 2
        if found is None:
            break
        depth = min(depth + 1, HISTORY)
        kept = [F.col(f"{n}{i}").alias(f"{n}{i + 1}") for n in "sy" for i in range(depth - 1)]
        latest = [(F.col("x") - F.col("_old")).alias("s0"), (F.col("g") - F.col("_g")).alias("y0")]
        names = ["ord", "ctx", "w", "k", "prior", "fid", "x", "g"]
        rows = new.select(*names, *latest, *kept).withColumn("pg", pseudo_gradient(c1))
        values.append(found)
        if len(values) > PAST and abs(values[-1 - PAST] - found) < CHANGE * abs(found):
            break
    return rows.select("ord", "ctx", "w", F.col("x").alias("lam"))


def to_backoff(feats: DataFrame, order: int) -> Model:
    """The same distribution as a back-off model: a context's weight is its suffix's normaliser over its own."""
    rows = cut(feats.select("ord", "ctx", "w", F.col("lam").alias("x"), feature_id(F.col("ord"), F.col("ctx"), F.col("w")).alias("fid")))
    contexts = rows.select("ctx").distinct().withColumn("n", F.lit(0.0))
    shape = shape_of(rows, contexts)
    sums = cut(weight_sums(rows, shape))
    normal = cut(normalisers(sums, shape))
    named = rows.join(sums.select(F.col("f").alias("fid"), "cid", "s"), "fid").join(normal.select(F.col("c").alias("cid"), "z"), "cid")
    probs = named.select("ord", "ctx", "w", ((F.col("s") - F.log("z")) / F.lit(math.log(10))).alias("logp"))
    z = contexts.where("ctx <> ''").select("ctx", context_id(F.col("ctx")).alias("c"), context_id(shorter(F.col("ctx"))).alias("short")).join(normal.select("c", "z"), "c")
    bows = z.join(normal.select(F.col("c").alias("short"), F.col("z").alias("_z")), "short")
    return Model(order, probs, bows.select(context_length(F.col("ctx")).alias("len"), "ctx", F.log10(F.col("_z") / F.col("z")).alias("bow")))
