"""Factored models against the recursive definition, evaluated word by word over whole vocabularies."""

import math
import random
from collections import Counter, defaultdict

import pytest

from textloom.operators import factored as X


class Plain:
    """The definition: counts per node, discounts, back-off by recursion, sums by running over the vocabulary."""

    def __init__(self, rows, spec):
        self.spec, self.k = spec, len(spec.parents)
        rows = [(*["NULL" if v is None else v for v in r[:-1]], r[-1]) for r in rows if r[-1] is not None]
        self.vocab = sorted({r[-1] for r in rows})
        self.sizes = [len({r[i] for r in rows}) for i in range(self.k)]
        graph = set(spec.under(spec.top)) | {spec.node(n).kn_parent for n in spec.under(spec.top) if spec.node(n).kn_parent is not None}
        self.raw = {n: Counter((self.cut(r, n), r[-1]) for r in rows) for n in graph}
        self.cnt, self.p, self.bow, self.unseen = {}, {}, {}, {}
        for n in spec.under(spec.top):
            self.cnt[n] = self.modified(n, graph)
            self.estimate(n)

    def cut(self, r, n):
        return tuple(r[i] for i in range(self.k) if n >> i & 1)

    def inner(self, ctx, n, m):
        return tuple(v for i, v in zip([i for i in range(self.k) if n >> i & 1], ctx, strict=True) if m >> i & 1)

    def modified(self, n, graph):
        node = self.spec.node(n)
        if node.method not in ("kn", "mkn") or n == self.spec.top or node.kn_modified:
            return dict(self.raw[n])
        above = node.kn_parent if node.kn_parent is not None else max(m for m in graph if m & n == n and m.bit_count() == n.bit_count() + 1)
        types = Counter((self.inner(c, above, n), w) for c, w in self.raw[above])
        first = lambda c, w: c[-1] if c else w
        return {(c, w): types[c, w] + (x if first(c, w) in ("<s>", "-pau-") else 0) for (c, w), x in self.raw[n].items()}

    def factor(self, n, c, total, types, consts):
        node = self.spec.node(n)
        if c < node.least:
            return 0.0
        if node.method == "wb":
            return total / (total + types)
        if node.method == "abs":
            return (c - node.delta) / c if c > node.delta else 0.0
        if node.method == "kn":
            return (c - consts) / c
        if node.method == "mkn":
            return (c - consts[min(c, 3) - 1]) / c
        return consts.get(c, 1.0)

    def estimate(self, n):
        node, level = self.spec.node(n), self.cnt[n]
        cc = Counter(level.values())
        consts = None
        if node.method == "kn":
            consts = cc[1] / (cc[1] + 2 * cc[2])
        elif node.method == "mkn":
            y = cc[1] / (cc[1] + 2 * cc[2])
            consts = (1 - 2 * y * cc[2] / cc[1], 2 - 3 * y * cc[3] / cc[2], 3 - 4 * y * cc[4] / cc[3])
        elif node.method == "gt":
            from textloom.operators.discount import good_turing_factors

            consts = good_turing_factors(dict(cc), node.most)
        by = defaultdict(dict)
        for (c, w), x in level.items():
            by[c][w] = x
        self.p[n], self.bow[n] = {}, {}
        for ctx, words in by.items():
            total, types = sum(words.values()), len(words)
            more = [sum(x > k for x in words.values()) for k in (1, 2)]
            for grown in (0, 1):
                got = {}
                for w, x in words.items():
                    d = self.factor(n, x, total, types, consts)
                    if d == 0:
                        continue
                    got[w] = d * x / (total + grown)
                    if node.interpolate:
                        low = self.back(ctx, w, n) if n else 1 / len(self.vocab)
                        lw = {"wb": types / (total + grown + types), "abs": node.delta * types / (total + grown)}.get(node.method)
                        if node.method == "kn":
                            lw = consts * types / (total + grown)
                        if node.method == "mkn":
                            lw = ((types - more[0]) * consts[0] + (more[0] - more[1]) * consts[1] + more[1] * consts[2]) / (total + grown)
                        got[w] += lw * low
                if sum(got.values()) <= 1 - 3e-6:
                    break
            if n == 0:
                left = max(0.0, 1 - sum(got.values()))
                none = [w for w in self.vocab if not got.get(w)]
                got = {w: left / len(none) if none and w in none else got[w] + (0 if none else left / len(self.vocab)) for w in self.vocab}
            self.p[n] |= {(ctx, w): q for w, q in got.items()}
            if n and got:
                left = 1 - sum(got.values())
                rest = sum(self.back(ctx, w, n) for w in self.vocab if w not in got) if self.spec.general(n) else 1 - sum(self.back(ctx, w, n) for w in got)
                left, rest = 0.0 if abs(left) < 3e-6 and left < 0 else left, 0.0 if abs(rest) < 3e-6 and rest < 0 else rest
                if self.spec.general(n) and left == 0:
                    self.bow[n][ctx] = 1.0
                else:
                    self.bow[n][ctx] = 0.0 if left < 0 else (0.0 if left > 3e-6 else 1.0) if rest <= 1e-12 else left / rest

    def score(self, ctx, w, n, m, strategy):
        sub = self.inner(ctx, n, m)
        if strategy == "bog_node_prob":
            return self.prob(sub, w, m)
        c = self.cnt[m].get((sub, w), 0)
        if not c:
            return 0.0
        own = [x for (k, _), x in self.raw[m].items() if k == sub]
        sizes = [len(self.vocab), *[self.sizes[i] for i in range(self.k) if m >> i & 1]]
        return c / {
            "counts_no_norm": 1, "counts_sum_counts_norm": sum(own), "counts_sum_num_words_norm": len(own), "counts_prod_card_norm": math.prod(sizes),
            "counts_sum_card_norm": math.log10(sizes[0]) + sum(map(math.log, sizes[1:])), "counts_sum_log_card_norm": sum(sizes),
        }[strategy]

    def back(self, ctx, w, n):
        node, children = self.spec.node(n), self.spec.below(n)
        v = [self.prob(self.inner(ctx, n, m), w, m) for m in children]
        if len(v) == 1:
            return v[0]
        if node.combine in ("max", "min"):
            scores = [self.score(ctx, w, n, m, node.strategy) for m in children]
            return v[scores.index((max if node.combine == "max" else min)(scores))]
        weights = [dict(node.weights).get(m, 0) for m in children]
        return {
            "sum": lambda: sum(v), "avg": lambda: sum(v) / len(v), "prod": lambda: math.prod(v), "gmean": lambda: math.prod(v) ** (1 / len(v)),
            "wmean": lambda: sum(x * y for x, y in zip(v, weights, strict=True)) / sum(weights),
        }[node.combine]()

    def prob(self, ctx, w, n):
        if (ctx, w) in self.p[n]:
            return self.p[n][ctx, w]
        if n == 0:
            return 0.0
        if ctx in self.bow[n]:
            return self.bow[n][ctx] * self.back(ctx, w, n)
        if self.spec.general(n):
            if (n, ctx) not in self.unseen:
                self.unseen[n, ctx] = sum(self.back(ctx, x, n) for x in self.vocab)
            return self.back(ctx, w, n) / self.unseen[n, ctx]
        return self.back(ctx, w, n)


def random_tokens(seed, n=150):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), rnd.choice(["s", "t", "u", None]), rnd.choice(["<s>", "x", "y"]), rnd.choice("pqrstvvww") if rnd.random() < 0.5 else rnd.choice("ppqv")) for _ in range(n)]
    return [*rows, ("only", "u", "x", "rare"), ("a", "s", "x", None)]


MADE = {}


def check(spark, rows, spec, parents, names=("a", "c", "only", "new")):
    """Compare every probability with the definition; lower nodes of an earlier model of the same tokens are used again."""
    wide = [r[: len(parents)] + (r[-1],) for r in rows]
    tokens = spark.createDataFrame(wide, ", ".join(f"{c} string" for c in [*parents, "w"]))
    key = tuple(wide)
    model, plain = X.estimate(tokens, spec, MADE.get(key)), Plain(wide, spec)
    MADE[key] = model
    seen = sorted({tuple("NULL" if v is None else v for v in r[:-1]) for r in wide})[:6]
    contexts = [*seen, *[(n, *c[1:]) for n, c in zip(names, seen, strict=False)], tuple("new" for _ in parents), ("a", *["new" for _ in parents[1:]])]
    contexts = sorted(set(contexts))
    grid = spark.createDataFrame([(*c, w) for c in contexts for w in [*plain.vocab, "unheard"]], ", ".join(f"{c} string" for c in [*parents, "w"]))
    got = {tuple(r)[:-1]: 10 ** r["logp"] for r in model.score(grid).collect()}
    for c in contexts:
        for w in plain.vocab:
            assert got[(*c, w)] == pytest.approx(plain.prob(c, w, spec.top), rel=1e-9, abs=1e-300), (c, w)
        assert got[(*c, "unheard")] == 0
    return {c: sum(got[(*c, w)] for w in plain.vocab) for c in contexts}


TWO = ("l", "s")


@pytest.mark.parametrize("combine", ["max", "min"])
@pytest.mark.parametrize("strategy", X.STRATEGIES)
def test_strategies_on_two_parents(spark, strategy, combine):
    spec = X.Spec("w", TWO, {3: X.Node(method="wb", combine=combine, strategy=strategy, least=2)})
    sums = check(spark, random_tokens(1), spec, TWO)
    assert all(abs(x - 1) < 1e-9 for x in sums.values())


@pytest.mark.parametrize("combine", ["sum", "prod", "avg", "gmean", "wmean"])
def test_combinations_on_two_parents(spark, combine):
    spec = X.Spec("w", TWO, {3: X.Node(method="abs", delta=0.4, combine=combine, weights=((1, 2.0), (2, 1.0)), interpolate=combine in ("avg", "prod"))})
    check(spark, random_tokens(2), spec, TWO)


def test_three_parents_kneser_ney_and_dropped_nodes(spark):
    three = ("l", "s", "h")
    # l,s,h may lose h only; l,s picks a child by probability; s,h is not in the graph
    spec = X.Spec(
        "w", three, {
            7: X.Node(method="kn", interpolate=True, drop=4, least=2), 3: X.Node(method="abs", delta=0.7, strategy="bog_node_prob", least=2),
            1: X.Node(method="mkn", kn_parent=7), 2: X.Node(method="kn", kn_parent=7), 0: X.Node(method="wb", interpolate=True),
        },
    )
    check(spark, random_tokens(5, 260), spec, three)


def test_three_parents_whole_graph(spark):
    three = ("l", "s", "h")
    spec = X.Spec("w", three, {7: X.Node(method="wb", strategy="counts_no_norm", least=2), 6: X.Node(method="wb", combine="avg"), 5: X.Node(method="wb", strategy="bog_node_prob")})
    check(spark, random_tokens(6, 80), spec, three)


def test_good_turing_and_missing_counts(spark):
    spec = X.Spec("w", TWO, {n: X.Node(method="gt", most=3) for n in range(4)})
    check(spark, random_tokens(7, 200), spec, TWO)
    with pytest.raises(ValueError):
        X.estimate(spark.createDataFrame([("a", "b", "c")], "l string, s string, w string"), X.Spec("w", TWO, {0: X.Node(method="mkn")}))


def test_lower_nodes_are_taken_over(spark):
    tokens = spark.createDataFrame([r[:2] + r[-1:] for r in random_tokens(1)], "l string, s string, w string")
    first = X.estimate(tokens, X.Spec("w", TWO, {3: X.Node(method="wb")}))
    again = X.estimate(tokens, X.Spec("w", TWO, {3: X.Node(method="wb", strategy="bog_node_prob")}), first)
    assert again.rows[1] is first.rows[1] and again.rows[3] is not first.rows[3]


def test_specification(spark):
    text = """## a comment
1
W : 3 W(-1) M(-1) S(-1)  c.gz m.gz 5
  W1,M1,S1  W1 kndiscount gtmin 2 interpolate
  M1,S1     S1,M1 kndiscount gtmin 100000000 \\
     combine mean
  M1        M1 wbdiscount strategy bog_node_prob
  S1        S1 cdiscount 0.3 kn-count-parent W1,M1,S1
  0         0  gtmax 4 write x.gz
"""
    (spec,) = X.parse_spec(text)
    assert spec.parents == ("W(-1)", "M(-1)", "S(-1)") and spec.below(7) == [6] and spec.below(6) == [4, 2] and spec.under(7) == [0, 2, 4, 6, 7]
    assert spec.node(7) == X.Node(drop=1, method="mkn", least=2, interpolate=True) and spec.node(6).combine == "avg" and spec.node(6).least == 100_000_000
    assert spec.node(4).kn_parent == 7 and spec.node(4).delta == 0.3 and spec.node(0).most == 4
    wmean = X.parse_spec("1\nW : 2 A(-1) B(0) c m 1\nA1,B0 A1,B0 combine wmean A1 2 B0 1 wbdiscount\n")[0].node(3)
    assert wmean.weights == ((1, 2.0), (2, 1.0)) and wmean.method == "wb"
    for wrong in ("strategy none", "combine none", "colour"):
        with pytest.raises(ValueError):
            X.parse_spec(f"1\nW : 1 A(-1) c m 1\nA1 A1 {wrong}\n")
