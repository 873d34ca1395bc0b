"""Queries over factored models (every way of choosing and combining children of a node) and maximum entropy models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.sequences import gram, words_of
from textloom.operators import counts as C
from textloom.operators import factored as X
from textloom.operators import maxent as X_ME
from textloom.plans import sql as Q
from textloom.plans.counting import held_out
from textloom.plans.modelling import shown_probs
from textloom.plans.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def endings(spark, d) -> DataFrame:
    """Tokens of the conversations: the ending of a word (two characters), that of the word before, and who speaks."""
    said = table(spark, d, "conversations").select("role", words_of(F.coalesce("text", F.lit(""))).alias("ws"))
    end = lambda w: F.lower(F.substring(w, -2, 2))
    before = F.when(F.col("k") == 0, "<s>").otherwise(end(F.get("ws", F.col("k") - 1)))
    return said.select("role", "ws", F.posexplode("ws").alias("k", "x")).select(before.alias("h"), F.col("role").alias("l"), end(F.col("x")).alias("w"))


TOKENS = r"""
raw AS (SELECT role, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM conversations),
pos AS (SELECT role, ws, unnest(range(1, len(ws) + 1)) AS k FROM raw),
tok AS (SELECT CASE WHEN k = 1 THEN '<s>' ELSE lower(right(ws[k - 1], 2)) END AS h, coalesce(role, 'NULL') AS l, lower(right(ws[k], 2)) AS w FROM pos)"""

#: Nodes below the top with Witten-Bell, the top with a least count of two, and the children's values for every context and word.
GRID = f"""{TOKENS},
vocab AS (SELECT w, count(*)::DOUBLE AS cnt FROM tok GROUP BY w), size AS (SELECT count(*)::DOUBLE AS v, sum(cnt) AS n FROM vocab),
width AS (SELECT count(DISTINCT h)::DOUBLE AS nh, count(DISTINCT l)::DOUBLE AS nl FROM tok),
u AS (SELECT w, cnt / (n + v) + (v / (n + v)) / v AS pu FROM vocab, size),
ch AS (SELECT h, w, count(*)::DOUBLE AS cnt FROM tok GROUP BY ALL), cl AS (SELECT l, w, count(*)::DOUBLE AS cnt FROM tok GROUP BY ALL), ct AS (SELECT h, l, w, count(*)::DOUBLE AS cnt FROM tok GROUP BY ALL),
th AS (SELECT h, sum(cnt) AS n, count(*)::DOUBLE AS t, 1 - sum(pu) AS rest FROM ch JOIN u USING (w) GROUP BY h), tl AS (SELECT l, sum(cnt) AS n, count(*)::DOUBLE AS t, 1 - sum(pu) AS rest FROM cl JOIN u USING (w) GROUP BY l),
tt AS (SELECT h, l, sum(cnt) AS n, count(*)::DOUBLE AS t FROM ct GROUP BY h, l),
grid AS MATERIALIZED (
  SELECT tt.h, tt.l, u.w, CASE WHEN ct.cnt >= 2 THEN ct.cnt / (tt.n + tt.t) END AS p, ct.cnt AS seen,
    coalesce(ch.cnt, 0) AS c1, coalesce(cl.cnt, 0) AS c2, th.n AS n1, tl.n AS n2, th.t AS t1, tl.t AS t2, v, nh, nl,
    coalesce(ch.cnt / (th.n + th.t), CASE WHEN th.rest > 3e-6 THEN th.t / (th.n + th.t) / th.rest ELSE 0 END * pu) AS v1,
    coalesce(cl.cnt / (tl.n + tl.t), CASE WHEN tl.rest > 3e-6 THEN tl.t / (tl.n + tl.t) / tl.rest ELSE 0 END * pu) AS v2
  FROM tt CROSS JOIN u JOIN th USING (h) JOIN tl USING (l) CROSS JOIN size CROSS JOIN width
  LEFT JOIN ch ON ch.h = tt.h AND ch.w = u.w LEFT JOIN cl ON cl.l = tt.l AND cl.w = u.w LEFT JOIN ct ON ct.h = tt.h AND ct.l = tt.l AND ct.w = u.w)"""


def scored(name: str, ways: dict[str, str], general: str = "true") -> str:
    """Log probability of the tokens by speaker for each way to combine ``v1`` and ``v2``; those not ``general`` are not summed."""
    listed = " UNION ALL ".join(f"SELECT '{k}' AS {name}, {general if general in ('true', 'false') else str(k not in ('avg', 'wmean')).lower()} AS summed, h, l, w, p, seen, {x} AS low FROM grid" for k, x in ways.items())
    return f"""WITH {GRID},
each AS ({listed}),
per AS (SELECT {name}, h, l, count(p) AS kept, 1 - coalesce(sum(p), 0) AS left_over, sum(low) AS every, sum(low) FILTER (WHERE p IS NULL) AS rest, 1 - coalesce(sum(low) FILTER (WHERE p IS NOT NULL), 0) AS rest1 FROM each GROUP BY ALL),
val AS (SELECT {name}, l, seen, coalesce(p, low * CASE WHEN summed THEN CASE WHEN kept = 0 THEN 1 / every ELSE left_over / rest END ELSE CASE WHEN kept = 0 THEN 1 ELSE left_over / rest1 END END) AS q
  FROM each JOIN per USING ({name}, h, l) WHERE seen IS NOT NULL)
SELECT {name}, l, round(sum(seen * log10(q)), 4) AS logprob, CAST(sum(seen) AS BIGINT) AS tokens FROM val GROUP BY {name}, l"""


#: The first child is the speaker's, and goes where the word before does not score more.
PICKS = {
    "counts_no_norm": ("c1", "c2"), "counts_sum_counts_norm": ("c1 / n1", "c2 / n2"), "counts_sum_num_words_norm": ("c1 / t1", "c2 / t2"), "counts_prod_card_norm": ("c1 / (v * nh)", "c2 / (v * nl)"),
    "counts_sum_card_norm": ("c1 / (log10(v) + ln(nh))", "c2 / (log10(v) + ln(nl))"), "counts_sum_log_card_norm": ("c1 / (v + nh)", "c2 / (v + nl)"), "bog_node_prob": ("v1", "v2"),
}


def scores(spark, d, name: str, nodes: dict[str, X.Node]) -> DataFrame:
    """Models that differ in their top node only: the nodes below are estimated once."""
    tokens = cut(endings(spark, d))
    events = cut(tokens.groupBy("h", "l", "w").agg(F.count(F.lit(1)).alias("seen")))
    counts, model, out = None, None, []
    for way, node in nodes.items():
        spec = X.Spec("w", ("h", "l"), {3: node})
        counts = cut(X.node_counts(tokens, spec, spec.under(3))) if counts is None else counts
        model = X.estimate(tokens, spec, model, counts)
        told = model.score(events).groupBy(F.coalesce("l", F.lit(X.NULL)).alias("l")).agg(F.round(F.sum(F.col("seen") * F.col("logp")), 4).alias("logprob"), F.sum("seen").alias("tokens"))
        out.append(told.select(F.lit(way).alias(name), "l", "logprob", "tokens"))
    return reduce(DataFrame.unionByName, out)


@register("factored_strategies", scored("strategy", {k: f"CASE WHEN {a} > {b} THEN v1 ELSE v2 END" for k, (a, b) in PICKS.items()}))
def q_strategies(spark, d):
    return scores(spark, d, "strategy", {s: X.Node(method="wb", least=2, strategy=s) for s in X.STRATEGIES})


COMBINED = {"min": "CASE WHEN c1 / n1 < c2 / n2 THEN v1 ELSE v2 END", "sum": "v1 + v2", "prod": "v1 * v2", "avg": "(v1 + v2) / 2", "gmean": "sqrt(v1 * v2)", "wmean": "v1 * (2.0::DOUBLE / 3) + v2 * (1.0::DOUBLE / 3)"}


@register("factored_combinations", scored("combination", COMBINED, "each"))
def q_combinations(spark, d):
    return scores(spark, d, "combination", {c: X.Node(method="wb", least=2, combine=c, weights=((1, 2.0), (2, 1.0))) for c in COMBINED})


# ---- maximum entropy ----

#: The gradient at given weights, from every context crossed with every word.
GRADIENT = f"""WITH {Q.HELD_OUT},{Q.counts('c', 'tsent', 3)},
f AS (SELECT ord, ctx, w, cnt, 0.1::DOUBLE * ln(1 + cnt) AS x FROM c WHERE w <> '<s>'),
lg AS (SELECT ord - 1 AS ord, {Q.shorter()} AS ctx, w, sum(cnt) AS l FROM f WHERE ord > 1 GROUP BY ALL),
al AS (SELECT f.ctx, f.w, f.cnt - coalesce(l, 0) AS n FROM f LEFT JOIN lg ON f.ord = lg.ord AND f.ctx = lg.ctx AND f.w = lg.w),
tot AS (SELECT sum(n)::DOUBLE AS t FROM al WHERE n > 0),
d AS (SELECT ctx, {Q.shorter()} AS one, sum(n) / max(t) AS n, CASE WHEN ctx = '' THEN 0 WHEN strpos(ctx, ' ') = 0 THEN 1 ELSE 2 END AS len FROM al, tot WHERE n > 0 GROUP BY ctx),
e AS (SELECT d.ctx, CASE WHEN len = 2 THEN one ELSE d.ctx END AS one, len, n, u.w, exp(u.x + coalesce(b.x, 0) + coalesce(t.x, 0)) AS m FROM d JOIN f u ON u.ord = 1
  LEFT JOIN f b ON b.ord = 2 AND b.w = u.w AND b.ctx = CASE WHEN len = 2 THEN one ELSE d.ctx END AND len > 0 LEFT JOIN f t ON t.ord = 3 AND t.w = u.w AND t.ctx = d.ctx AND len = 2),
z AS (SELECT ctx, sum(m) AS z FROM e GROUP BY ctx),
p AS (SELECT e.ctx, one, len, w, n * m / z AS q FROM e JOIN z ON e.ctx = z.ctx),
x AS (SELECT 1 AS ord, '' AS ctx, w, sum(q) AS e FROM p GROUP BY w UNION ALL SELECT 2, one, w, sum(q) FROM p WHERE len > 0 GROUP BY one, w UNION ALL SELECT 3, ctx, w, sum(q) FROM p WHERE len = 2 GROUP BY ctx, w)
SELECT CAST(f.ord AS INTEGER) AS ord, {Q.gram('f.ctx', 'f.w')} AS ngram, round(x.e - f.cnt / t + f.x / (6.0::DOUBLE * t), 8) AS gradient
FROM f JOIN x ON f.ord = x.ord AND f.ctx = x.ctx AND f.w = x.w, tot"""


@register("maxent_gradient", GRADIENT)
def q_maxent_gradient(spark, d):
    rows, contexts, total = X_ME.structure(cut(C.count_ngrams(held_out(spark, d), 3)), 3)
    rows = rows.withColumn("x", F.lit(0.1) * F.log1p(F.round(F.col("k") * F.lit(total))))
    found, _ = X_ME.evaluate(rows, X_ME.shape_of(rows, contexts), X_ME.SIGMA2 * total)
    return found.select("ord", gram(F.col("ctx"), F.col("w")).alias("ngram"), F.round("g", 8).alias("gradient"))


@register("maxent")
def q_maxent(spark, d):
    """Trigrams, to convergence."""
    m = X_ME.to_backoff(X_ME.fit(cut(C.count_ngrams(held_out(spark, d), 3)), 3), 3)
    return shown_probs(m, 1, 4)
