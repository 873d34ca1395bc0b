"""Factored models: a word given several factors, backing off through a graph of parent subsets.

Tokens have one column per parent and one for the child. A node is a subset of the parents as a bit mask, the first
parent lowest. All nodes are counted by one aggregation over grouping sets; each node has a discount of its own
(Kneser-Ney from the counts of a parent node), its probabilities and back-off weights are estimated from few parents to
many, and an event that a node has not seen goes on to the node's children: to the one that the node's strategy
scores highest (lowest), or to a mean, sum or product of all.

Several children make the back-off distribution depend on the word, so its sum over the vocabulary is needed for each
context. No grid of contexts and words is formed for it. For the strategies that count, only words that a child other
than the first has seen can leave the first child (of equal scores the first wins, and unseen words score zero everywhere),
and the first child sums to one: the sum is one plus what those words change. For products and for the highest or lowest
probability, words that no child has seen have a common factor per context times a power of their unigram
probability. What is expanded are the children's seen words (all but the first child's where strategies count), so put
the parent with the fewest values last.

A null parent counts as ``NULL``; tokens with a null child are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.discount import Absolute, GoodTuring, KneserNey, Method, ModifiedKneserNey, Natural, WittenBell, good_turing_factors, kn_constant, modified_kn_constants
from textloom.plans.session import cut
from textloom.schema import EPSILON, NON_EVENTS

NULL = "NULL"
#: Fixed names of the specification format: how a node picks a child, how it combines them, how it discounts.
STRATEGIES = ("counts_no_norm", "counts_sum_counts_norm", "counts_sum_num_words_norm", "counts_prod_card_norm", "counts_sum_card_norm", "counts_sum_log_card_norm", "bog_node_prob")
COMBINATIONS = ("max", "min", "sum", "prod", "avg", "gmean", "wmean")
DISCOUNTS = {"cdiscount": "abs", "ndiscount": "natural", "wbdiscount": "wb", "kndiscount": "mkn", "ukndiscount": "kn"}


@dataclass(frozen=True)
class Node:
    """Options of one node; ``drop`` masks the parents it may drop (None: all), ``weights`` are of its children (``wmean``)."""

    drop: int | None = None
    method: str = "gt"
    least: float = 1
    most: int = 7
    delta: float = 0.5
    interpolate: bool = False
    strategy: str = "counts_sum_counts_norm"
    combine: str = "max"
    weights: tuple[tuple[int, float], ...] = ()
    kn_parent: int | None = None
    kn_modified: bool = False


@dataclass
class Spec:
    """A child, its parents in order, and the options of nodes that differ from ``default``."""

    child: str
    parents: tuple[str, ...]
    nodes: dict[int, Node] = field(default_factory=dict)
    default: Node = Node(method="wb")

    @property
    def top(self) -> int:
        return 2 ** len(self.parents) - 1

    @property
    def combine(self) -> dict[int, str]:
        """How the nodes with options of their own combine their children."""
        return {n: node.combine for n, node in self.nodes.items()}

    def node(self, n: int) -> Node:
        return self.nodes.get(n, self.default)

    def keys(self, n: int) -> list[str]:
        return [p for k, p in enumerate(self.parents) if n >> k & 1]

    def below(self, n: int) -> list[int]:
        """The nodes that ``n`` may back off to, from the highest mask: the order in which the first of equal scores wins."""
        drop = self.node(n).drop
        return sorted((n & ~(1 << k) for k in range(len(self.parents)) if n >> k & 1 and (drop is None or drop >> k & 1)), reverse=True)

    def under(self, n: int) -> list[int]:
        """``n`` and all that it reaches, fewest parents first."""
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += self.below(x)
        return sorted(seen, key=lambda x: (x.bit_count(), x))

    def general(self, n: int) -> bool:
        """Whether the node's back-off distribution has to be summed: several children that are not averaged."""
        return len(self.below(n)) > 1 and self.node(n).combine not in ("avg", "wmean")

    def power(self, n: int) -> float:
        """The power of the unigram probability that words unseen under the node's back-off have."""
        found = [self.power(c) for c in self.below(n)] or [1.0]
        if self.node(n).combine in ("prod", "gmean") and len(found) > 1:
            return sum(found) / (1 if self.node(n).combine == "prod" else len(found))
        if max(found) - min(found) > 1e-12:
            raise ValueError("a product below one child only: its words have another power of their unigram than those of its sisters")
        return found[0]


@dataclass
class FactoredModel:
    """``rows``: per node keys, child, cnt, p (null: left out), total, entries; ``bows``: per node keys, bow, mass.

    ``mass`` is what a context's probabilities add up to: one, but for contexts that have no word left to give the rest to.
    """

    spec: Spec
    rows: dict[int, DataFrame]
    bows: dict[int, DataFrame]
    sizes: dict[str, int]

    # ---- probabilities ----

    def value(self, events: DataFrame, node: int, skip: Sequence[int] = ()) -> DataFrame:
        """Add ``v{n}`` (and ``s{n}``, the counts' scores) of ``node`` and all nodes under it."""
        out = events
        for n in self.spec.under(node):
            if n in skip or f"v{n}" in out.columns:
                continue
            out = self.looked_up(out, n)
            own = F.col(f"_p{n}")
            if n == 0:
                out = out.withColumn("v0", F.coalesce(own, F.lit(0.0)))
            else:
                weight = F.coalesce(F.col(f"_b{n}"), F.lit(1.0))
                out = out.withColumn(f"v{n}", F.coalesce(own, weight * self.combined(n)))
            out = out.drop(f"_p{n}", f"_b{n}")
        return out

    def looked_up(self, events: DataFrame, n: int) -> DataFrame:
        """Add the node's own probability, its counts and the weight of its back-off to events."""
        keys = self.spec.keys(n)
        known = self.rows[n].select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(self.spec.child).alias("_kc"), F.col("p").alias(f"_p{n}"), F.struct("cnt", "total", "entries").alias(f"s{n}"))
        match = _all([F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col(self.spec.child) == F.col("_kc")])
        out = events.join(known, match, "left").drop("_kc", *[f"_k_{k}" for k in keys])
        if not keys:
            return out
        weights = self.bows[n]
        if self.spec.general(n):  # contexts that the node has not seen have a sum of their own
            new = events.select(*keys).distinct().join(weights.select(*keys), keys, "left_anti")
            weights = weights.select(*keys, "bow").unionByName(self.sums(new, n).select(*keys, F.when(F.col("sum") > 0, 1 / F.col("sum")).otherwise(1.0).alias("bow")))
        weights = weights.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("bow").alias(f"_b{n}"))
        return out.join(weights, _all([F.col(k) == F.col(f"_k_{k}") for k in keys]), "left").drop(*[f"_k_{k}" for k in keys])

    def strategy_score(self, n: int, strategy: str) -> Column:
        """What a child node scores for an event."""
        cnt, total, entries = (F.col(f"s{n}")[c] for c in ("cnt", "total", "entries"))
        if strategy == "bog_node_prob":
            return F.col(f"v{n}")
        sizes = [self.sizes[self.spec.child], *[self.sizes[k] for k in self.spec.keys(n)]] if "card" in strategy else [1]
        by = {
            "counts_no_norm": F.lit(1.0), "counts_sum_counts_norm": total, "counts_sum_num_words_norm": entries, "counts_prod_card_norm": F.lit(float(math.prod(sizes))),
            # the two names stand for each other's norm, as users of the format know them; the logarithm is decimal for the child
            "counts_sum_card_norm": F.lit(math.log10(sizes[0]) + sum(math.log(s) for s in sizes[1:])), "counts_sum_log_card_norm": F.lit(float(sum(sizes))),
        }[strategy]
        return F.when(cnt > 0, cnt / by).otherwise(F.lit(0.0))

    def combined(self, n: int, what: str = "v") -> Column:
        """The back-off distribution of a node from ``v`` of its children (or from ``k``, the factors of unseen words, or ``m``, their masses)."""
        children, node = self.spec.below(n), self.spec.node(n)
        v = [F.col(f"{what}{c}") for c in children]
        if len(v) == 1:
            return v[0]
        total, product = reduce(lambda a, b: a + b, v), reduce(lambda a, b: a * b, v)
        if node.combine in ("sum", "avg", "prod", "gmean"):
            return {"sum": total, "avg": total / len(v), "prod": product, "gmean": F.pow(product, F.lit(1.0 / len(v)))}[node.combine]
        if node.combine == "wmean":
            given = dict(node.weights)
            w = [given.get(c, 0.0) for c in children]
            return reduce(lambda a, b: a + b, [x * (y / sum(w)) for x, y in zip(v, w, strict=True)])
        if what == "k":
            if node.strategy != "bog_node_prob":
                return v[0]
            return F.greatest(*v) if node.combine == "max" else F.least(*v)
        best, chosen = self.strategy_score(children[0], node.strategy), v[0]
        for c, x in zip(children[1:], v[1:], strict=True):
            score = self.strategy_score(c, node.strategy)
            better = score > best if node.combine == "max" else score < best
            best, chosen = F.when(better, score).otherwise(best), F.when(better, x).otherwise(chosen)
        return chosen

    # ---- sums over the vocabulary ----

    def sums(self, contexts: DataFrame, n: int) -> DataFrame:
        """``sum`` of the node's back-off distribution over the whole vocabulary, for distinct contexts."""
        keys, children, node = self.spec.keys(n), self.spec.below(n), self.spec.node(n)
        if node.combine in ("sum", "avg", "wmean") or len(children) == 1:
            out = reduce(self.with_mass, children, contexts)
            return out.select(*keys, self.combined(n, "m").alias("sum"))
        counting = node.combine in ("max", "min") and node.strategy != "bog_node_prob"
        if counting:  # who may differ from the first child
            movers = children[1:] if node.combine == "max" else children[:1]
        else:
            movers = sorted({m for c in children for m in self.spec.under(c) if m})
        lists = [contexts.join(self.rows[m].select(*self.spec.keys(m), self.spec.child), self.spec.keys(m)).select(*keys, self.spec.child) for m in movers]
        events = reduce(DataFrame.unionByName, lists).distinct() if len(lists) > 1 else lists[0]
        for c in children:
            events = self.value(events, c)
        if counting:
            per = events.groupBy(*keys).agg(F.sum(self.combined(n) - F.col(f"v{children[0]}")).alias("_moved"))
            first = self.with_mass(contexts, children[0]).join(per, keys, "left")
            return first.select(*keys, (F.col(f"m{children[0]}") + F.coalesce("_moved", F.lit(0.0))).alias("sum"))
        power = self.spec.power(n)
        unigram = F.pow("v0", F.lit(power))
        every = self.rows[0].agg(F.sum(F.pow("p", F.lit(power)))).first()[0] or 0.0
        per = events.groupBy(*keys).agg(F.sum(self.combined(n)).alias("_seen"), F.sum(unigram).alias("_mass"))
        rest = self.factors(contexts, n).join(per, keys, "left")
        return rest.select(*keys, (F.coalesce("_seen", F.lit(0.0)) + F.col("_k") * (every - F.coalesce("_mass", F.lit(0.0)))).alias("sum"))

    def with_mass(self, contexts: DataFrame, n: int) -> DataFrame:
        """Add ``m{n}``, what the node's probabilities add up to in each context."""
        if f"m{n}" in contexts.columns:
            return contexts
        if n == 0:
            return contexts.withColumn("m0", F.lit(1.0))
        keys = self.spec.keys(n)
        out = contexts if self.spec.general(n) else reduce(self.with_mass, self.spec.below(n), contexts)
        lower = F.lit(1.0) if self.spec.general(n) else self.combined(n, "m")
        return out.join(self.bows[n].select(*keys, F.col("mass").alias("_mass")), keys, "left").withColumn(f"m{n}", F.coalesce("_mass", lower)).drop("_mass")

    def factors(self, contexts: DataFrame, n: int) -> DataFrame:
        """``_k``: what the back-off of a node multiplies the (power of the) unigram probability of unseen words with."""
        out = contexts.withColumn("k0", F.lit(1.0))
        for m in [x for x in self.spec.under(n) if x and x != n]:
            keys = self.spec.keys(m)
            weights = self.bows[m]
            if self.spec.general(m):
                new = contexts.select(*keys).distinct().join(weights.select(*keys), keys, "left_anti")
                weights = weights.select(*keys, "bow").unionByName(self.sums(new, m).select(*keys, (1 / F.col("sum")).alias("bow")))
            out = out.join(weights.select(*keys, F.col("bow").alias("_w")), keys, "left").withColumn(f"k{m}", F.coalesce("_w", F.lit(1.0)) * self.combined(m, "k")).drop("_w")
        return out.select(*contexts.columns, self.combined(n, "k").alias("_k"))

    def score(self, events: DataFrame) -> DataFrame:
        """Add ``logp``; distinct events are looked up once."""
        names = [*self.spec.parents, self.spec.child]
        filled = events.withColumns({p: F.coalesce(F.col(p), F.lit(NULL)) for p in self.spec.parents})
        one = filled.select(*names).distinct()
        v = self.value(one, self.spec.top)
        p = F.col(f"v{self.spec.top}")
        known = v.select(*[F.col(x).alias(f"_n_{x}") for x in names], F.when(p > 0, F.log10(p)).otherwise(F.lit(float("-inf"))).alias("logp"))
        match = _all([F.coalesce(F.col(x), F.lit(NULL)) == F.col(f"_n_{x}") for x in names])
        return events.join(known, match, "left").select(*events.columns, "logp")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# ---- counts ----


def node_counts(tokens: DataFrame, spec: Spec, nodes: Sequence[int], block: str | None = None, among: dict[str, DataFrame] | None = None) -> DataFrame:
    """Counts of the child with the parents of each node (``node``, parents, child, ``cnt``) in one aggregation; parents outside a node are null.

    Where tokens lie dealt by the column ``block``, only all parents together are counted, inside their block; those counts are dealt
    by the child and give every node's as they lie. ``among`` has the values of a parent that are asked for (a table of its column):
    nodes with that parent are counted behind these alone, the others whole.
    """
    names = [*spec.parents, spec.child]
    filled = [F.coalesce(F.col(p).cast("string"), F.lit(NULL)).alias(p) for p in spec.parents]
    if among and (block is None or any(spec.node(n).method in ("gt", "kn", "mkn") for n in nodes)):
        raise ValueError("values are asked of tokens in blocks, for discounts without constants from counts of counts")
    rows = tokens.where(F.col(spec.child).isNotNull()).select(*([block] if block else []), *filled, F.col(spec.child))
    if block:
        for p, asked in (among or {}).items():  # a value that is not asked for is null: it counts where the parent is left out
            rows = rows.join(asked.select(F.coalesce(F.col(p).cast("string"), F.lit(NULL)).alias("_asked")).distinct(), F.col(p) == F.col("_asked"), "left").withColumn(p, F.col("_asked")).drop("_asked")
        rows = rows.groupBy(block, *names).agg(F.count(F.lit(1)).alias("_n")).drop(block).repartition(spec.child)
        each = [F.struct(F.lit(n).alias("node"), *[(F.col(p) if p in spec.keys(n) else F.lit(None).cast("string")).alias(p) for p in spec.parents]) for n in nodes]
        each = [F.when(_all([F.col(p).isNotNull() for p in spec.keys(n)]), x) if n else x for n, x in zip(nodes, each, strict=True)]
        rows = rows.select(spec.child, "_n", F.explode(F.array(*each)).alias("g")).where("g is not null")
        return rows.groupBy("g.node", *[f"g.{p}" for p in spec.parents], spec.child).agg(F.sum("_n").alias("cnt")).select("node", *names, "cnt")
    sets = [[F.col(k) for k in [*spec.keys(n), spec.child]] for n in nodes]
    counted = rows.groupingSets(sets, *[F.col(c) for c in names]).agg(F.count(F.lit(1)).alias("cnt"), F.grouping_id(*[F.col(c) for c in names]).alias("_g"))
    # the grouping id has a bit for each column that is left out, the last column lowest
    places = [F.shiftleft(1 - F.shiftright(F.col("_g"), len(names) - 1 - k).bitwiseAND(F.lit(1)), k) for k in range(len(spec.parents))]
    return counted.select(reduce(lambda a, b: a + b, places, F.lit(0)).cast("int").alias("node"), *names, "cnt")


def level_counts(counts: DataFrame, spec: Spec, n: int, graph: Sequence[int]) -> DataFrame:
    """Counts of one node (keys, child, ``cnt``, ``raw``): for Kneser-Ney the number of a parent node's n-grams above each.

    The parent is the given one or the highest mask with one parent more. N-grams whose first word (the last of the node's
    parents) is no event keep their count beside it, since nothing precedes them.
    """
    keys, node = spec.keys(n), spec.node(n)
    own = counts.where(F.col("node") == n).select(*keys, spec.child, F.col("cnt").alias("raw"))
    if node.method not in ("kn", "mkn") or node.kn_modified or n == spec.top:
        return own.withColumn("cnt", F.col("raw"))
    parents = [m for m in graph if m & n == n and m.bit_count() == n.bit_count() + 1]
    if node.kn_parent is None and not parents:
        raise ValueError(f"node {n} has no parent node to take Kneser-Ney counts from")
    above = node.kn_parent if node.kn_parent is not None else max(parents)
    types = counts.where(F.col("node") == above).groupBy(*keys, spec.child).agg(F.count(F.lit(1)).alias("_above"))
    first = F.col(keys[-1]) if keys else F.col(spec.child)
    kept = F.when(first.isin(*NON_EVENTS), F.col("raw")).otherwise(F.lit(0))
    return own.join(types, [*keys, spec.child], "left").select(*keys, spec.child, "raw", (kept + F.coalesce("_above", F.lit(0))).alias("cnt"))


def node_method(level: DataFrame, node: Node, child: str) -> Method:
    """The discount of a node, with constants from its counts of counts."""
    top = {"gt": node.most + 1, "kn": 2, "mkn": 4}.get(node.method, 0)
    n = {int(r["cnt"]): int(r["k"]) for r in level.where((F.col("cnt") <= top) & ~F.col(child).isin(*NON_EVENTS)).groupBy("cnt").agg(F.count(F.lit(1)).alias("k")).collect()} if top else {}
    if node.method == "gt":
        return GoodTuring(False, node.least, node.most, good_turing_factors(n, node.most))
    if node.method == "kn":
        return KneserNey(node.interpolate, node.least, kn_constant(n))
    if node.method == "mkn":
        return ModifiedKneserNey(node.interpolate, node.least, *modified_kn_constants(n))
    return {"abs": Absolute(node.interpolate, node.least, node.delta), "natural": Natural(False, node.least), "wb": WittenBell(node.interpolate, node.least)}[node.method]


# ---- estimation ----


def estimate(tokens: DataFrame, spec: Spec, lower: FactoredModel | None = None, counts: DataFrame | None = None) -> FactoredModel:
    """All nodes of the graph from one aggregation, fewest parents first.

    Nodes that ``lower``, a model of the same tokens, has with the same options all the way down are taken from it.
    """
    graph = sorted({m for n in spec.under(spec.top) for m in (n, spec.node(n).kn_parent) if m is not None}, key=lambda m: (m.bit_count(), m))
    counts = cut(node_counts(tokens, spec, graph)) if counts is None else counts
    # how many values a parent has is asked by some strategies only
    sizes = dict(lower.sizes) if lower is not None else {spec.child: counts.where("node = 0").count()} if 0 in graph else {}
    norms = spec.parents if any("card" in spec.node(n).strategy for n in graph) else ()
    names = [c for c in (*norms, spec.child) if c not in sizes]
    if names:
        rows = tokens.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(NULL)) if c != spec.child else F.col(c)).alias(c) for c in names]).first()
        sizes |= {c: int(rows[c]) for c in names}
    model = FactoredModel(spec, {}, {}, sizes)
    for n in spec.under(spec.top):
        if lower is not None and all(m in lower.rows and lower.spec.node(m) == spec.node(m) for m in spec.under(n)):
            model.rows[n] = lower.rows[n]
            if n:
                model.bows[n] = lower.bows[n]
            continue
        level = level_counts(counts, spec, n, graph).where(~F.col(spec.child).isin(*NON_EVENTS))
        _estimate_node(model, cut(level), n)
    return model


def _estimate_node(model: FactoredModel, level: DataFrame, n: int) -> None:
    spec = model.spec
    keys, node, v = spec.keys(n), spec.node(n), model.sizes[spec.child]
    method = node_method(level, node, spec.child)
    c = F.col("cnt")
    figures = {"total": F.sum("cnt"), "types": F.count(F.lit(1)), "types2": F.count_if(c > 1), "types3": F.count_if(c > 2), "_raw": F.sum("raw")}
    if not keys:
        total = level.agg(*[x.alias(name) for name, x in figures.items()]).first()
        rows = level.withColumns({x: F.lit(total[x]) for x in ("total", "types", "types2", "types3", "_raw")})
        rows = rows.withColumn("_low", F.lit(1.0 / max(1, v)))
    else:
        rows = level
        for child in spec.below(n):
            rows = model.value(rows, child)
        # the rows of a context meet once, behind the joins; its figures and sums are windows over them as they lie
        context = Window.partitionBy(*keys)
        rows = rows.select(*keys, spec.child, "cnt", "raw", model.combined(n).alias("_low"))
        rows = rows.withColumns({name: x.over(context) for name, x in figures.items()})
    rows = rows.withColumn("_d", method.factor(v))
    mixed = F.col("_d") * c / F.col("total") + (method.lower_weight(v) * F.col("_low") if method.interpolate else F.lit(0.0))
    rows = rows.withColumn("p", F.when(F.col("_d") != 0, mixed))
    # a context that is left without mass is given a total larger by one
    full = F.sum("p").over(context) > 1 - EPSILON if keys else F.lit((rows.agg(F.sum("p")).first()[0] or 0.0) > 1 - EPSILON)
    rows = rows.withColumn("_full", full).withColumn("total", F.when(F.col("_full"), F.col("total") + 1).otherwise(F.col("total")))
    rows = cut(rows.withColumn("p", F.when(F.col("_d") != 0, mixed)).select(*keys, spec.child, "cnt", "total", "types", "_raw", "_low", "p"))
    kept = rows.select(*keys, spec.child, "cnt", F.col("_raw").alias("total"), F.col("types").alias("entries"), "p")
    if not keys:
        model.rows[0] = _unigrams(kept, spec.child)
        return
    model.rows[n] = kept
    seen = rows.where(F.col("p").isNotNull()).groupBy(*keys).agg(F.sum("p").alias("_s"), F.sum("_low").alias("_l"))
    seen = seen.join(model.sums(seen.select(*keys), n), keys)
    over = F.col("sum") if spec.general(n) else F.lit(1.0)
    left, rest = 1 - F.col("_s"), over - F.col("_l")
    left = F.when((left < 0) & (left > -EPSILON), 0.0).otherwise(left)
    rest = F.when((rest < 0) & (rest > -EPSILON), 0.0).otherwise(rest)
    bow = F.when(left < 0, 0.0).when(rest <= 0, F.when(left > EPSILON, 0.0).otherwise(1.0)).otherwise(left / rest)
    bow = F.when(left == 0, 1.0).otherwise(bow) if spec.general(n) else bow
    weighed = seen.withColumn("bow", bow)
    model.bows[n] = cut(weighed.select(*keys, "bow", (F.col("_s") + F.col("bow") * F.greatest(F.col("sum") - F.col("_l"), F.lit(0.0))).alias("mass")))


def _unigrams(rows: DataFrame, child: str) -> DataFrame:
    """Node 0: what is left goes to words without probability, or to all words if there are none."""
    p = F.coalesce("p", F.lit(0.0))
    total, zeros, size = rows.agg(F.sum(p), F.count_if(p == 0), F.count(F.lit(1))).first()
    left = max(0.0, 1.0 - (total or 0.0))
    new = F.when(p == 0, F.lit(left / zeros)).otherwise(p) if zeros else p + F.lit(left / max(1, size))
    return cut(rows.withColumn("p", new))


# ---- files ----


def parse_spec(text: str) -> list[Spec]:
    """Specification files: a number of models, then for each a header and its nodes with their options.

    Parents are ``W(-1)``; a node names them as ``W1`` or ``W(-1)``, separated by commas, as a number (0x3, 0b11) or 0. A
    backslash at its end continues a line. Nodes without a line are not in the graph's files but keep the defaults.
    """
    lines = [x.split("##")[0].strip() for x in text.replace("\\\n", " ").splitlines()]
    lines = [x for x in lines if x]
    out, at = [], 1
    for _ in range(int(lines[0])):
        head = lines[at].split()
        count = int(head[2])
        parents = tuple(head[3 : 3 + count])
        spec = Spec(head[0], parents, {}, Node())
        nodes = int(head[5 + count])
        for line in lines[at + 1 : at + 1 + nodes]:
            fields = line.split()
            n, options = node_mask(fields[0], parents), fields[1:]
            spec.nodes[n] = _options(options, parents, n)
        at += 1 + nodes
        out.append(spec)
    return out


def node_mask(text: str, parents: Sequence[str]) -> int:
    """The mask of a node from its name."""
    if text[0].isdigit():
        return int(text, 0)
    mask = 0
    for part in text.split(","):
        found = [k for k, p in enumerate(parents) if part == p or part == _short(p)]
        if not found:
            raise ValueError(f"{part} is no parent")
        mask |= 1 << found[0]
    return mask


def _short(parent: str) -> str:
    """``W(-1)`` is named ``W1``, ``W(+1)`` ``W+1``, ``W(0)`` ``W0``."""
    name, _, at = parent.rstrip(")").partition("(")
    return name + at.lstrip("-")


def _options(fields: list[str], parents: Sequence[str], n: int) -> Node:
    node = Node()
    if fields and fields[0] not in _WORDS:
        node = replace(node, drop=node_mask(fields[0], parents))
        fields = fields[1:]
    rest = iter(fields)
    for word in rest:
        if word in DISCOUNTS:
            node = replace(node, method=DISCOUNTS[word])
            if word == "cdiscount":
                node = replace(node, delta=float(next(rest)))
        elif word == "gtmin":
            node = replace(node, least=int(next(rest)))
        elif word == "gtmax":
            node = replace(node, most=int(next(rest)))
        elif word == "interpolate":
            node = replace(node, interpolate=True)
        elif word == "kn-count-parent":
            node = replace(node, kn_parent=node_mask(next(rest), parents))
        elif word == "kn-counts-modified":
            node = replace(node, kn_modified=True)
        elif word == "strategy":
            node = replace(node, strategy=next(rest))
            if node.strategy not in STRATEGIES:
                raise ValueError(f"unknown strategy {node.strategy}")
        elif word == "combine":
            kind = {"mean": "avg"}.get(k := next(rest), k)
            if kind not in COMBINATIONS:
                raise ValueError(f"unknown combination {kind}")
            node = replace(node, combine=kind)
            if kind == "wmean":
                children = [b for b in range(len(parents)) if n >> b & 1 and (node.drop is None or node.drop >> b & 1)]
                node = replace(node, weights=tuple((node_mask(next(rest), parents), float(next(rest))) for _ in children))
        elif word in ("gt", "kn", "write"):
            next(rest)  # files of the command-line tools; parameters and counts are tables here
        elif word != "kn-counts-modify-at-end":
            raise ValueError(f"unknown option {word}")
    return node


_WORDS = {*DISCOUNTS, "gtmin", "gtmax", "gt", "kn", "write", "interpolate", "kn-count-parent", "kn-counts-modified", "kn-counts-modify-at-end", "strategy", "combine"}
