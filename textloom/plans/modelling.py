"""Queries over discounts, models, scoring and mixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import sequences as S
from textloom.operators import counts as C
from textloom.operators import discount as D
from textloom.operators import dynamic as M
from textloom.operators import em, prune
from textloom.operators import near as N
from textloom.operators import estimate as E
from textloom.operators import score as R
from textloom.plans import sql as Q
from textloom.plans.counting import KN3, blocks, counted, docs, held_out, parts_of
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


def shown_probs(model: R.Model, order: int | None = None, digits: int = 6) -> DataFrame:
    rows = model.probs.where(F.col("logp") > R.ZERO)
    rows = rows if order is None else rows.where(F.col("ord") == order)
    return rows.select("ord", S.gram(F.col("ctx"), F.col("w")).alias("ngram"), F.round("logp", digits).alias("logp"))


def wb_model(spark, d, order: int = 2, events: DataFrame | None = None) -> R.Model:
    """The model of the documents; that of ``events`` has, of n-grams of two words or more, those behind their contexts, each context whole."""
    contexts = None if events is None else R.contexts_of(events, order)
    return E.train(counted(spark, d, order, contexts), order, "wb")


#: Bytes of text in a block whose n-grams one task packs, and to a task that unpacks them: more are sorted on disk.
PACKED, DEALT = 6_000_000, 16_000_000


def packable(spark, d) -> DataFrame:
    return blocks(spark, d, parts_of(spark, d, PACKED))


WB = f"{Q.train_counts(2)},{Q.wb_bigram()}"
EVENTS = f"{Q.HELD_OUT},{Q.events('ev', 'tsent', 2, 'item_id, sent_id')}"
SCORED = f"{WB}, {EVENTS}, {Q.bigram_lookup('s', 'ev', 'm', 'item_id, sent_id, pos')}"
STATS = """CAST(count(*) FILTER (WHERE w = '</s>') AS BIGINT) AS sentences, CAST(count(*) FILTER (WHERE w <> '</s>') AS BIGINT) AS words,
  CAST(count(*) FILTER (WHERE p = 0 AND hit = 0) AS BIGINT) AS oovs, CAST(count(*) FILTER (WHERE p = 0 AND hit > 0) AS BIGINT) AS zeroprobs,
  round(sum(CASE WHEN p > 0 THEN log10(p) ELSE 0 END), 4) AS logprob"""
PPL = """*, round(pow(10.0, -raw / (words - oovs - zeroprobs + sentences)), 4) AS ppl, round(pow(10.0, -raw / (words - oovs - zeroprobs)), 4) AS ppl1"""


def shown_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    p = R.perplexities(stats)
    longs = [F.col(c).cast("long").alias(c) for c in ("sentences", "words", "oovs", "zeroprobs")]
    return p.select(*keys, *longs, F.round("logprob", 4).alias("logprob"), F.round("ppl", 4).alias("ppl"), F.round("ppl1", 4).alias("ppl1"))


def stats_sql(source: str, keys: str) -> str:
    pre = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT * EXCLUDE (raw), round(pow(10.0, -raw / (words - oovs - zeroprobs + sentences)), 4) AS ppl,
  CASE WHEN words - oovs - zeroprobs > 0 THEN round(pow(10.0, -raw / (words - oovs - zeroprobs)), 4) END AS ppl1
  FROM (SELECT {pre}{STATS}, sum(CASE WHEN p > 0 THEN log10(p) ELSE 0 END) AS raw FROM {source} {group})"""


@register("flagship_perplexity", f"""
WITH {WB}, {Q.events('ev', 'sent', 2, 'lang')}, pe AS (SELECT lang, ctx, w, count(*) AS n FROM ev GROUP BY ALL),
s AS (SELECT lang, e.w, n, CASE WHEN b.p IS NOT NULL THEN b.p ELSE u.p * coalesce(x.bow, 1) END AS p FROM pe e LEFT JOIN m_b b ON e.ctx = b.ctx AND e.w = b.w LEFT JOIN m_u u ON e.w = u.w LEFT JOIN m_w x ON e.ctx = x.ctx)
SELECT lang, CAST(sum(n) FILTER (WHERE w = '</s>') AS BIGINT) AS sentences, CAST(sum(n) FILTER (WHERE w <> '</s>') AS BIGINT) AS words,
  round(sum(n * log10(p)), 3) AS logprob, round(pow(10.0, -sum(n * log10(p)) / sum(n)), 4) AS ppl FROM s GROUP BY lang""")
def q_flagship(spark, d):
    stats = R.perplexities(N.text_by_itself(packable(spark, d), counted(spark, d, 1), "lang", lambda ev: wb_model(spark, d, 2, ev), parts_of(spark, d, DEALT)))
    return stats.select("lang", F.col("sentences").cast("long").alias("sentences"), F.col("words").cast("long").alias("words"), F.round("logprob", 3).alias("logprob"), F.round("ppl", 4).alias("ppl"))


GT_FACTORS = f"""WITH {Q.train_counts(3)}, k AS (SELECT ord, cnt AS k, count(*)::DOUBLE AS n FROM c WHERE w <> '<s>' GROUP BY ord, cnt),
t AS (SELECT 1 AS ord, 1 AS top UNION ALL SELECT 2, 7 UNION ALL SELECT 3, 7),
r AS (SELECT t.ord, a.k, (a.k + 1) * coalesce(b.n, 0) / (a.k * a.n) AS r, (t.top + 1) * z.n / o.n AS common
  FROM t JOIN k a ON a.ord = t.ord AND a.k <= t.top LEFT JOIN k b ON b.ord = t.ord AND b.k = a.k + 1 JOIN k z ON z.ord = t.ord AND z.k = t.top + 1 JOIN k o ON o.ord = t.ord AND o.k = 1)
SELECT CAST(ord AS INTEGER) AS ord, CAST(k AS INTEGER) AS k, round(CASE WHEN r > 1 OR NOT isfinite((r - common) / (1 - common)) OR (r - common) / (1 - common) <= 3e-6 THEN 1 ELSE (r - common) / (1 - common) END, 6) AS factor FROM r"""


@register("gt_discounts", GT_FACTORS)
def q_gt(spark, d):
    c = cut(counted(spark, d, 3))
    rows = [(n, k, round(v, 6)) for n in (1, 2, 3) for k, v in D.fit("gt", c, n).factors.items()]
    return spark.createDataFrame(rows, "ord int, k int, factor double")


@register("kn_discounts", f"""WITH {KN3}, n AS (SELECT ord, cnt AS k, count(*)::DOUBLE AS n FROM kn WHERE w <> '<s>' AND cnt BETWEEN 1 AND 2 GROUP BY ord, cnt)
SELECT a.ord, round(a.n / (a.n + 2 * b.n), 6) AS discount FROM n a JOIN n b ON a.ord = b.ord AND a.k = 1 AND b.k = 2""")
def q_kn_discounts(spark, d):
    c = cut(C.kn_counts(counted(spark, d, 3), 3))
    return spark.createDataFrame([(n, round(D.fit("kn", c, n).delta, 6)) for n in (1, 2, 3)], "ord int, discount double")


MKN = f"""{KN3}, n AS (SELECT ord, cnt AS k, count(*)::DOUBLE AS n FROM kn WHERE w <> '<s>' AND cnt BETWEEN 1 AND 4 GROUP BY ord, cnt),
q AS (SELECT ord, max(n) FILTER (WHERE k = 1) AS n1, max(n) FILTER (WHERE k = 2) AS n2, max(n) FILTER (WHERE k = 3) AS n3, max(n) FILTER (WHERE k = 4) AS n4 FROM n GROUP BY ord),
y AS (SELECT *, n1 / (n1 + 2 * n2) AS y FROM q),
mkd AS (SELECT ord, 1 - 2 * y * n2 / n1 AS d1, 2 - 3 * y * n3 / n2 AS d2, 3 - 4 * y * n4 / n3 AS d3 FROM y)"""


@register("modkn_discounts", f"WITH {MKN} SELECT ord, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM mkd")
def q_modkn(spark, d):
    c = cut(C.kn_counts(counted(spark, d, 3), 3))
    ms = [(n, D.fit("mkn", c, n)) for n in (1, 2, 3)]
    return spark.createDataFrame([(n, round(m.d1, 6), round(m.d2, 6), round(m.d3, 6)) for n, m in ms], "ord int, d1 double, d2 double, d3 double")


def simple_bigram(u: str, b: str, weight: str = "0") -> str:
    """SQL of a bigram model: factors of the unigrams and bigrams, and the weight of the lower order."""
    return f"""{Q.train_counts(2)},{Q.unigrams('u', 'c', u)},
kk AS (SELECT ctx, w, cnt FROM c WHERE ord = 2 AND w <> '<s>'),
xx AS (SELECT ctx, sum(cnt)::DOUBLE AS total, count(*)::DOUBLE AS types, max(v) AS v FROM kk, u_t GROUP BY ctx),
bb AS (SELECT ctx, kk.w, ({b}) * cnt / xx.total + ({weight}) * u.p AS p0, xx.total, xx.types, xx.v, ({b}) * cnt AS kept, u.p AS lowp FROM kk JOIN xx USING (ctx) JOIN u ON u.w = kk.w),
ss AS (SELECT ctx, sum(p0) AS s, sum(kept) AS k FROM bb GROUP BY ctx),
pp AS (SELECT bb.ctx, w, lowp, CASE WHEN 1 - s <= 3e-6 AND types < v THEN kept / CASE WHEN 1 - k / total > 3e-6 THEN total ELSE greatest(total, floor(k / (1 - 3e-6)) + 1) END ELSE p0 END AS p FROM bb JOIN ss USING (ctx))"""


SHOW_MODEL = f"SELECT 1 AS ord, w AS ngram, round(log10(p), 6) AS logp FROM u WHERE p > 0 UNION ALL SELECT 2 AS ord, ctx || ' ' || w AS ngram, round(log10(p), 6) AS logp FROM pp WHERE p > 0"
METHODS = {
    "abs": ("CASE WHEN cnt <= 0.5 THEN 0 ELSE (cnt - 0.5::DOUBLE) / cnt END", "CASE WHEN cnt <= 0.5 THEN 0 ELSE (cnt - 0.5::DOUBLE) / cnt END"),
    "natural": ("CASE WHEN types = v THEN 1.0::DOUBLE ELSE (total * (total + 1) + types * (1 - types)) / (total * (total + 1) + 2 * types) END", "CASE WHEN xx.types = xx.v THEN 1.0::DOUBLE ELSE (xx.total * (xx.total + 1) + xx.types * (1 - xx.types)) / (xx.total * (xx.total + 1) + 2 * xx.types) END"),
    "add": ("(1 + 0.5::DOUBLE / cnt) / (1 + v * 0.5::DOUBLE / total)", "(1 + 0.5::DOUBLE / cnt) / (1 + xx.v * 0.5::DOUBLE / xx.total)"),
    "wb": ("total / (total + types)", "xx.total / (xx.total + xx.types)"),
}


def _register_methods() -> None:
    names = {"abs": "absolute_bigram_model", "natural": "natural_bigram_model", "add": "additive_bigram_model", "wb": "wb_bigram_model"}
    for method, (u, b) in METHODS.items():
        register(names[method], f"WITH {simple_bigram(u, b)} {SHOW_MODEL}")(lambda spark, d, m=method: shown_probs(E.train(counted(spark, d, 2), 2, m, delta=0.5)))


_register_methods()


@register("abs_interpolated_model", f"""
WITH {Q.train_counts(2)}, a AS (SELECT w, cnt FROM c WHERE ord = 1 AND w <> '<s>'), aa AS (SELECT sum(cnt)::DOUBLE AS t, count(*)::DOUBLE AS q FROM a),
u0 AS (SELECT w, (cnt - 0.5::DOUBLE) / t + 0.5::DOUBLE * q / t / q AS p FROM a, aa), us AS (SELECT 1 - sum(p) AS rest, count(*) AS n FROM u0), u AS (SELECT w, p + greatest(rest, 0) / n AS p FROM u0, us),
kk AS (SELECT ctx, w, cnt FROM c WHERE ord = 2 AND w <> '<s>'), xx AS (SELECT ctx, sum(cnt)::DOUBLE AS t, count(*)::DOUBLE AS q FROM kk GROUP BY ctx),
pp AS (SELECT ctx, kk.w, (cnt - 0.5::DOUBLE) / t + 0.5::DOUBLE * q / t * u.p AS p FROM kk JOIN xx USING (ctx) JOIN u ON u.w = kk.w) {SHOW_MODEL}""")
def q_abs_int(spark, d):
    return shown_probs(E.train(counted(spark, d, 2), 2, "abs", interpolate=True, delta=0.5))


@register("kn_interp_bigram_model", f"""
WITH {Q.train_counts(2)}, x1 AS (SELECT w, count(*) AS e FROM c WHERE ord = 2 GROUP BY w),
kn AS (SELECT ord, ctx, w, cnt FROM c WHERE ord = 2 UNION ALL SELECT ord, c.ctx, c.w, CASE WHEN c.w = '<s>' THEN cnt ELSE coalesce(e, 0) END FROM c LEFT JOIN x1 ON c.w = x1.w WHERE ord = 1),
n AS (SELECT ord, cnt AS k, count(*)::DOUBLE AS n FROM kn WHERE w <> '<s>' AND cnt BETWEEN 1 AND 4 GROUP BY ord, cnt),
q AS (SELECT ord, max(n) FILTER (WHERE k = 1) AS n1, max(n) FILTER (WHERE k = 2) AS n2, max(n) FILTER (WHERE k = 3) AS n3, max(n) FILTER (WHERE k = 4) AS n4 FROM n GROUP BY ord),
y AS (SELECT *, n1 / (n1 + 2 * n2) AS y FROM q), dd AS (SELECT ord, 1 - 2 * y * n2 / n1 AS d1, 2 - 3 * y * n3 / n2 AS d2, 3 - 4 * y * n4 / n3 AS d3 FROM y),
a AS (SELECT w, cnt, CASE WHEN cnt = 1 THEN d1 WHEN cnt = 2 THEN d2 ELSE d3 END AS dc, d1, d2, d3 FROM kn, dd WHERE kn.ord = 1 AND dd.ord = 1 AND w <> '<s>' AND cnt > 0),
aa AS (SELECT sum(cnt)::DOUBLE AS t, count(*)::DOUBLE AS v, (max(d1) * count(*) FILTER (WHERE cnt = 1) + max(d2) * count(*) FILTER (WHERE cnt = 2) + max(d3) * count(*) FILTER (WHERE cnt > 2)) / sum(cnt) AS g FROM a),
u0 AS (SELECT w, (cnt - dc) / t + g / v AS p FROM a, aa), us AS (SELECT 1 - sum(p) AS rest, count(*) AS n FROM u0), u AS (SELECT w, p + greatest(rest, 0) / n AS p FROM u0, us),
kk AS (SELECT ctx, w, cnt, CASE WHEN cnt = 1 THEN d1 WHEN cnt = 2 THEN d2 ELSE d3 END AS dc, d1, d2, d3 FROM kn, dd WHERE kn.ord = 2 AND dd.ord = 2 AND w <> '<s>'),
xx AS (SELECT ctx, sum(cnt)::DOUBLE AS t, (max(d1) * count(*) FILTER (WHERE cnt = 1) + max(d2) * count(*) FILTER (WHERE cnt = 2) + max(d3) * count(*) FILTER (WHERE cnt > 2)) / sum(cnt) AS g FROM kk GROUP BY ctx),
pp AS (SELECT ctx, kk.w, (cnt - dc) / t + g * u.p AS p FROM kk JOIN xx USING (ctx) JOIN u ON u.w = kk.w) {SHOW_MODEL}""")
def q_kn_int(spark, d):
    return shown_probs(E.train(counted(spark, d, 2), 2, "mkn", interpolate=True))


@register("trigram_gt_model")
def q_trigram_gt(spark, d):
    return shown_probs(E.train(counted(spark, d, 3), 3, "gt"), 3)


TRI = f"""{Q.train_counts(3)},{Q.wb_bigram()},
k3 AS (SELECT ctx, w, cnt FROM c WHERE ord = 3 AND cnt >= 2 AND w <> '<s>'),
a3 AS (SELECT ctx, sum(cnt)::DOUBLE AS total, count(*)::DOUBLE AS types FROM c WHERE ord = 3 GROUP BY ctx),
t3 AS (SELECT k.ctx, k.w, k.cnt / (a.total + a.types) AS p, b.p AS lowp FROM k3 k JOIN a3 a USING (ctx) JOIN m_b b ON b.ctx = {Q.last('k.ctx')} AND b.w = k.w)"""


def top_trigrams(spark, d) -> DataFrame:
    """The trigrams of the documents' model; its lower orders are not written."""
    return N.top_trigrams(packable(spark, d), counted(spark, d, 1), lambda ev: wb_model(spark, d, 2, ev), parts_of(spark, d, DEALT))


@register("wb_trigram_model", f"""
WITH {TRI} SELECT 3 AS ord, ctx || ' ' || w AS ngram, round(log10(p), 6) AS logp FROM t3""")
def q_wb_trigram(spark, d):
    top = top_trigrams(spark, d)
    return top.select(F.lit(3).alias("ord"), S.gram(F.col("ctx"), F.col("w")).alias("ngram"), F.round("logp", 6).alias("logp"))


@register("trigram_bows", f"WITH {TRI} SELECT ctx, round(log10((1 - sum(p)) / (1 - sum(lowp))), 6) + 0.0 AS bow FROM t3 GROUP BY ctx HAVING abs(1 - sum(lowp)) > 1e-5")
def q_trigram_bows(spark, d):
    return top_trigrams(spark, d).where("one").select("ctx", (F.round("bow", 6) + 0.0).alias("bow"))


@register("bows", f"WITH {WB} SELECT ctx, round(log10(bow), 6) + 0.0 AS bow FROM m_w")
def q_bows(spark, d):
    return wb_model(spark, d).bows.select("ctx", (F.round("bow", 6) + 0.0).alias("bow"))


@register("unigram_leftover", f"WITH {Q.train_counts(1)},{Q.unigrams('u', 'c', 'CASE WHEN cnt < 2 THEN 0 ELSE total / (total + types) END')} SELECT w, round(log10(p), 6) AS logp FROM u")
def q_leftover(spark, d):
    m = E.train(counted(spark, d, 1), 1, "wb", min_counts={1: 2})
    return m.probs.where(F.col("logp") > R.ZERO).select("w", F.round("logp", 6).alias("logp"))


def held_out_events(spark, d) -> DataFrame:
    return R.events_of(held_out(spark, d), 2, ["item_id", "sent_id"])


def scored_held_out(spark, d, model: R.Model | None = None) -> DataFrame:
    ev = held_out_events(spark, d)
    return R.lookup(ev, model or wb_model(spark, d, events=ev))


@register("token_scores", f"WITH {SCORED} SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, w, round(CASE WHEN p > 0 THEN log10(p) END, 6) AS logp, hit FROM s")
def q_token_scores(spark, d):
    s = scored_held_out(spark, d)
    return s.select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.when(F.col("logp") > R.ZERO, F.round("logp", 6)).alias("logp"), "hit")


@register("sent_logprob", f"WITH {SCORED} {stats_sql('s', 'item_id, sent_id')}")
def q_sent(spark, d):
    return shown_stats(R.text_stats(scored_held_out(spark, d), ["item_id", "sent_id"]), ["item_id", F.col("sent_id").cast("long").alias("sent_id")])


@register("doc_ppl", f"WITH {SCORED} {stats_sql('s', 'item_id')}")
def q_doc(spark, d):
    return shown_stats(R.text_stats(scored_held_out(spark, d), ["item_id"]), ["item_id"])


@register("total_ppl", f"WITH {SCORED} {stats_sql('s', '')}")
def q_total(spark, d):
    return shown_stats(R.text_stats(scored_held_out(spark, d)), [])


@register("skipoov_ppl", f"""WITH {SCORED}, z AS (SELECT * REPLACE (CASE WHEN w = '<unk>' OR ctx = '<unk>' THEN 0 ELSE p END AS p) FROM s) {stats_sql('z', '')}""")
def q_skipoov(spark, d):
    return shown_stats(R.text_stats(R.skip_oovs(scored_held_out(spark, d))), [])


@register("context_used", f"WITH {WB}, {EVENTS} SELECT ctx, w, CASE WHEN x.ctx IS NULL THEN 0 ELSE 1 END AS used, count(*) AS n FROM ev LEFT JOIN m_w x USING (ctx) GROUP BY ctx, w, used")
def q_used(spark, d):
    ev = R.events_of(held_out(spark, d), 2)
    return R.used_context(ev, wb_model(spark, d, events=ev)).groupBy("ctx", "w", "used").agg(F.count(F.lit(1)).alias("n"))


@register("context_probs", f"""
WITH {WB}, {Q.HELD_OUT},{Q.grams('g', 'tsent', 2)}, k AS (SELECT DISTINCT ctx || ' ' || w AS ctx, ctx AS a, w AS b FROM g WHERE ord = 2),
x AS (SELECT k.ctx, ua.p AS pa, CASE WHEN bb.p IS NOT NULL THEN bb.p ELSE ub.p * coalesce(wv.bow, 1) END AS pb FROM k JOIN m_u ua ON ua.w = CASE WHEN a = '<s>' THEN '</s>' ELSE a END JOIN m_u ub ON ub.w = b LEFT JOIN m_b bb ON bb.ctx = a AND bb.w = b LEFT JOIN m_w wv ON wv.ctx = a)
SELECT ctx, round(log10(pa) + log10(pb), 6) AS logp FROM x""")
def q_context_probs(spark, d):
    g = C.count_ngrams(held_out(spark, d), 2).where("ord = 2").select(F.concat_ws(" ", "ctx", "w").alias("ctx"))
    out = R.context_log_prob(g, wb_model(spark, d, events=R.events_of(held_out(spark, d), 2)), 2)
    return out.where(F.col("ctxlogp") > R.ZERO).select("ctx", F.round("ctxlogp", 6).alias("logp"))


@register("counts_ppl", f"""WITH {WB}, {Q.HELD_OUT},{Q.counts('t', 'tsent', 2)}, ev AS (SELECT ctx, w, cnt FROM t WHERE ord = 2), {Q.bigram_lookup('s', 'ev', 'm', 'cnt')}
SELECT CAST(sum(cnt) FILTER (WHERE w = '</s>') AS BIGINT) AS sentences, CAST(sum(cnt) FILTER (WHERE w <> '</s>') AS BIGINT) AS words, CAST(coalesce(sum(cnt) FILTER (WHERE hit = 0), 0) AS BIGINT) AS oovs,
  round(sum(CASE WHEN p > 0 THEN cnt * log10(p) ELSE 0 END), 4) AS logprob FROM s""")
def q_counts_ppl(spark, d):
    ev = R.counts_events(C.count_ngrams(held_out(spark, d), 2), 2)
    s = R.text_stats(R.lookup(ev, wb_model(spark, d, events=ev)), weight=F.col("cnt"))
    return s.select(*[F.col(c).cast("long").alias(c) for c in ("sentences", "words", "oovs")], F.round("logprob", 4).alias("logprob"))


@register("prob_sums", f"""WITH {WB}, {EVENTS}, ctxs AS (SELECT DISTINCT ctx FROM ev), x AS (SELECT ctx, sum(p) AS a, sum(lowp) AS b FROM m_b GROUP BY ctx), su AS (SELECT sum(p) AS s FROM m_u)
SELECT ctx, round(coalesce(a, 0) + coalesce(bow, 1) * (s - coalesce(b, 0)), 6) AS total FROM ctxs LEFT JOIN x USING (ctx) LEFT JOIN m_w USING (ctx), su""")
def q_prob_sums(spark, d):
    ev = R.events_of(held_out(spark, d), 2)
    out = R.prob_sums(ev, wb_model(spark, d, events=ev))
    return out.select("ctx", F.round("total", 6).alias("total"))


@register("rank_metrics", f"""
WITH {SCORED}, dd AS (SELECT ctx, w, p, count(*) AS n FROM s WHERE hit > 0 GROUP BY ALL), t AS (SELECT dd.*, coalesce(x.bow, 1) AS bow FROM dd LEFT JOIN m_w x USING (ctx)),
hist AS (SELECT p AS hp, count(*) AS hn FROM m_u GROUP BY p),
un AS (SELECT ctx, w, coalesce(sum(hn) FILTER (WHERE hp * bow > p + 3e-6), 0) AS a, coalesce(sum(hn) FILTER (WHERE hp * bow >= p - 3e-6), 0) AS g FROM t, hist GROUP BY ctx, w),
bi AS (SELECT t.ctx, t.w, count(*) FILTER (WHERE b.p > t.p + 3e-6) - count(*) FILTER (WHERE b.lowp * bow > t.p + 3e-6) AS a,
  count(*) FILTER (WHERE b.p >= t.p - 3e-6) - count(*) FILTER (WHERE b.lowp * bow >= t.p - 3e-6) AS g FROM t JOIN m_b b ON b.ctx = t.ctx GROUP BY t.ctx, t.w),
r AS (SELECT n, un.a + coalesce(bi.a, 0) AS a, un.g + coalesce(bi.g, 0) AS g FROM t JOIN un USING (ctx, w) LEFT JOIN bi USING (ctx, w)), rk AS (SELECT n, least(a + (g - a - 1) / 2.0::DOUBLE, 11.0::DOUBLE) AS rank FROM r)
SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) FILTER (WHERE rank < 1) AS BIGINT) AS rank1, CAST(sum(n) FILTER (WHERE rank < 5) AS BIGINT) AS rank5, CAST(sum(n) FILTER (WHERE rank < 10) AS BIGINT) AS rank10 FROM rk""")
def q_rank(spark, d):
    model = wb_model(spark, d, events=held_out_events(spark, d))
    r = R.rank_metrics(scored_held_out(spark, d, model).where("hit > 0"), model)
    return r.agg(F.count(F.lit(1)).alias("tokens"), *[F.count_if(F.col("rank") < k).alias(f"rank{k}") for k in (1, 5, 10)])


@register("hit_lengths", f"WITH {SCORED} SELECT hit, count(*) AS n FROM s GROUP BY hit")
def q_hits(spark, d):
    return R.hit_lengths(scored_held_out(spark, d))


TWO = f"""{Q.SENTENCES}, enl AS (SELECT * FROM sent WHERE lang = 'en'), oth AS (SELECT * FROM sent WHERE lang <> 'en'), {Q.counts('c', 'enl', 2)}, {Q.counts('o', 'oth', 2)},
{Q.wb_bigram('m', 'c')}, {Q.wb_bigram('n', 'o')}, {EVENTS}, {Q.bigram_lookup('sa', 'ev', 'm', 'item_id, sent_id, pos')}, {Q.bigram_lookup('sb', 'ev', 'n', 'item_id, sent_id, pos')},
ab AS (SELECT sa.item_id, sa.sent_id, sa.pos, sa.ctx, sa.w, sa.p AS pa, sb.p AS pb FROM sa JOIN sb USING (item_id, sent_id, pos))"""


def two_models(spark, d, events: DataFrame | None = None) -> tuple[R.Model, R.Model]:
    """The models of English and of the other documents, counted together; for ``events`` as ``wb_model`` has it."""
    sents = blocks(spark, d).where("lang is not null").withColumn("english", F.col("lang") == "en")
    contexts = None if events is None else R.contexts_of(events, 2)
    c = cut(E.with_unigram(C.count_ngrams(sents, 2, by=["english"], block="block", contexts=contexts), ["english"]))
    return tuple(E.train(c.where(F.col("english") == own).drop("english"), 2, "wb") for own in (True, False))


@register("model_compare", f"""WITH {TWO}, x AS (SELECT log10(pb) - log10(pa) AS d FROM ab WHERE pa > 0 AND pb > 0)
SELECT count(*) AS tokens, count(*) FILTER (WHERE d > 0) AS greater, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS deviation FROM x""")
def q_compare(spark, d):
    a, b = two_models(spark, d, held_out_events(spark, d))
    out = R.compare_models(scored_held_out(spark, d, a), scored_held_out(spark, d, b), ["item_id", "sent_id", "pos"])
    return out.select("tokens", "greater", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def em_sql(rounds: int) -> str:
    steps, a, b = [], "0.5::DOUBLE", "0.5::DOUBLE"
    for k in range(rounds):
        steps.append(f"e{k} AS (SELECT avg({a} * pa / ({a} * pa + {b} * pb)) AS a, avg({b} * pb / ({a} * pa + {b} * pb)) AS b FROM ab WHERE greatest(pa, pb) > 0)")
        a, b = f"(SELECT a FROM e{k})", f"(SELECT b FROM e{k})"
    return f"WITH {TWO}, {', '.join(steps)} SELECT round(a, 6) AS lambda0, round(b, 6) AS lambda1 FROM e{rounds - 1}"


@register("best_mix_5_iters", em_sql(5))
def q_best_mix(spark, d):
    ev = R.events_of(held_out(spark, d), 2)
    both = M.score_all(ev, two_models(spark, d, ev))
    lam = em.best_mix(both, ["p0", "p1"], precision=-1, max_rounds=5)
    return spark.createDataFrame([tuple(round(x, 6) for x in lam)], "lambda0 double, lambda1 double")


@register("static_mix", f"""WITH {TWO}, k AS (SELECT DISTINCT ctx, w FROM (SELECT ctx, w FROM m_b UNION ALL SELECT ctx, w FROM n_b)), {Q.bigram_lookup('ka', 'k', 'm', '1 AS one')}, {Q.bigram_lookup('kb', 'k', 'n', '1 AS one')}
SELECT ka.ctx || ' ' || ka.w AS ngram, round(log10(0.6::DOUBLE * ka.p + 0.4::DOUBLE * kb.p), 6) AS logp FROM ka JOIN kb USING (ctx, w)""")
def q_static_mix(spark, d):
    m = prune.mix(two_models(spark, d), [0.6, 0.4])
    return m.probs.where("ord = 2").select(S.gram(F.col("ctx"), F.col("w")).alias("ngram"), F.round("logp", 6).alias("logp"))


@register("bayes_mix", f"""WITH {TWO},
x AS (SELECT ab.*, coalesce(cu.p, 0) AS ca, coalesce(nu.p, 0) AS cb FROM ab LEFT JOIN m_u cu ON cu.w = CASE WHEN ab.ctx = '<s>' THEN '</s>' ELSE ab.ctx END LEFT JOIN n_u nu ON nu.w = CASE WHEN ab.ctx = '<s>' THEN '</s>' ELSE ab.ctx END),
y AS (SELECT *, CASE WHEN ca + cb > 0 THEN (0.5 * ca * pa + 0.5 * cb * pb) / (0.5 * ca + 0.5 * cb) ELSE 0.5 * pa + 0.5 * pb END AS p FROM x)
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, w, round(CASE WHEN p > 0 THEN log10(p) END, 6) AS logp FROM y""")
def q_bayes(spark, d):
    ev = held_out_events(spark, d)
    out = M.bayes_mix(ev, two_models(spark, d, ev), [0.5, 0.5])
    return out.select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.when(F.col("logp") > R.ZERO, F.round("logp", 6)).alias("logp"))


@register("loglinear_mix", f"""WITH {TWO}, cx AS (SELECT DISTINCT ctx FROM ev), gr AS (SELECT DISTINCT ctx, w FROM (SELECT ctx, w FROM m_b UNION ALL SELECT ctx, w FROM n_b) SEMI JOIN cx USING (ctx)),
{Q.bigram_lookup('ga', 'gr', 'm', '1 AS one')}, {Q.bigram_lookup('gb', 'gr', 'n', '1 AS one')}, su AS (SELECT sum(sqrt(m_u.p) * sqrt(n_u.p)) AS s FROM m_u JOIN n_u USING (w)),
xx AS (SELECT ga.ctx, sum(sqrt(ga.p) * sqrt(gb.p)) AS a, sum(sqrt(coalesce(mu.p, 0)) * sqrt(coalesce(nu.p, 0))) AS b FROM ga JOIN gb USING (ctx, w) LEFT JOIN m_u mu ON mu.w = ga.w LEFT JOIN n_u nu ON nu.w = ga.w GROUP BY ga.ctx),
z AS (SELECT cx.ctx, coalesce(a, 0) + sqrt(coalesce(mw.bow, 1)) * sqrt(coalesce(nw.bow, 1)) * (s - coalesce(b, 0)) AS z FROM cx LEFT JOIN xx USING (ctx) LEFT JOIN m_w mw ON mw.ctx = cx.ctx LEFT JOIN n_w nw ON nw.ctx = cx.ctx, su)
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, w, round(0.5 * log10(pa) + 0.5 * log10(pb) - log10(z), 6) AS logp FROM ab JOIN z USING (ctx) WHERE pa > 0 AND pb > 0""")
def q_loglinear(spark, d):
    ev = held_out_events(spark, d)
    out = M.loglinear_mix(ev, two_models(spark, d, ev), [0.5, 0.5])
    return out.where(F.col("logp") > R.ZERO).select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.round("logp", 6).alias("logp"))


CONV = r"""
cl AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations), cs0 AS (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM cl),
cs AS (SELECT conv_id, turn, i, list_filter(regexp_split_to_array(l[i], '[ \t\r\n]+'), lambda x: x <> '') AS words FROM cs0),
ct AS (SELECT conv_id, turn, i, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS k FROM cs)"""


def conversation_words(spark, d) -> DataFrame:
    from textloom.sources.text import sentences

    s = sentences(table(spark, d, "conversations"), keys=("conv_id", "turn"))
    return s.select("conv_id", "turn", F.col("sent_id").alias("i"), F.posexplode("words").alias("k", "w"))


@register("cache_lm", f"""WITH {CONV}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i, k) AS n FROM ct),
j AS (SELECT a.conv_id, a.n, a.w, count(b.w) FILTER (WHERE b.w = a.w) AS same FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.n < a.n AND b.n >= a.n - 50 GROUP BY a.conv_id, a.n, a.w)
SELECT conv_id, n, w, round(CASE WHEN n > 1 THEN same::DOUBLE / least(n - 1, 50) ELSE 0 END, 6) AS cache FROM j""")
def q_cache(spark, d):
    from pyspark.sql import Window

    out = M.cache_probs(conversation_words(spark, d), ["conv_id"], ["turn", "i", "k"], 50)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i", "k")).cast("long")
    return out.select("conv_id", n.alias("n"), "w", F.round("cache", 6).alias("cache"))


@register("marginal_adapt", f"""WITH {WB}, {EVENTS}, {Q.counts('t', 'tsent', 1)}, ta AS (SELECT w, cnt::DOUBLE / (SELECT sum(cnt) FROM t WHERE w <> '<s>') AS pa FROM t WHERE w <> '<s>'),
al AS (SELECT u.w, CASE WHEN ta.pa > 0 AND u.p > 0 THEN pow(ta.pa / u.p, 0.5) ELSE 1 END AS a FROM m_u u JOIN ta USING (w)),
ctxs AS (SELECT DISTINCT ctx FROM ev), su AS (SELECT sum(p * coalesce(a, 1)) AS s FROM m_u LEFT JOIN al USING (w)),
xx AS (SELECT ctx, sum(p * coalesce(al.a, 1)) AS pa, sum(lowp * coalesce(al.a, 1)) AS pb FROM m_b LEFT JOIN al USING (w) GROUP BY ctx),
z AS (SELECT ctx, coalesce(pa, 0) + coalesce(bow, 1) * (s - coalesce(pb, 0)) AS z FROM ctxs LEFT JOIN xx USING (ctx) LEFT JOIN m_w USING (ctx), su),
{Q.bigram_lookup('s', 'ev', 'm', 'item_id, sent_id, pos')}
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, w, round(log10(p * coalesce(a, 1) / z), 6) AS logp FROM s LEFT JOIN al USING (w) JOIN z USING (ctx) WHERE p > 0""")
def q_marginals(spark, d):
    ev = held_out_events(spark, d)
    m = wb_model(spark, d, events=ev)
    t = C.count_ngrams(held_out(spark, d), 1).where("w <> '<s>'")
    total = t.agg(F.sum("cnt")).first()[0]
    base = m.probs.where("ord = 1").select("w", F.pow(F.lit(10.0), "logp").alias("p_base"))
    marginals = t.select("w", (F.col("cnt") / F.lit(float(total))).alias("p_adapt")).join(base, "w")
    out = M.adapted(ev, m, marginals)
    return out.where(F.col("logp") > R.ZERO).select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.round("logp", 6).alias("logp"))


@register("nonzero_lm", f"""WITH {WB}, {EVENTS}, {Q.bigram_lookup('s', 'ev', 'm', 'item_id, sent_id, pos')}, z AS (SELECT s.*, CASE WHEN b.p IS NOT NULL THEN b.p ELSE u.p * coalesce(x.bow, 1) END AS pz FROM s LEFT JOIN m_b b ON b.ctx = s.ctx AND b.w = 'the' JOIN m_u u ON u.w = 'the' LEFT JOIN m_w x ON x.ctx = s.ctx)
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, w, round(log10(CASE WHEN p > 0 THEN p ELSE pz END), 6) AS logp FROM z""")
def q_nonzero(spark, d):
    m = wb_model(spark, d, events=held_out_events(spark, d))
    out = M.nonzero(scored_held_out(spark, d, m), m, "the")
    return out.select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.round("logp", 6).alias("logp"))


CLASS_OF = "CASE WHEN length(w) <= 2 THEN 'SHORT' WHEN length(w) <= 5 THEN 'MID' ELSE 'LONG' END"


@register("simple_class_lm", f"""
WITH {Q.SENTENCES}, cw AS (SELECT list_transform(words, lambda w: {CLASS_OF}) AS words FROM sent), {Q.counts('k', 'cw', 2)}, {Q.wb_bigram('m', 'k')},
wc AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM sent) GROUP BY w), cd AS (SELECT w, {CLASS_OF} AS class, n::DOUBLE / sum(n) OVER (PARTITION BY {CLASS_OF}) AS pw FROM wc),
{EVENTS}, em AS (SELECT item_id, sent_id, pos, CASE WHEN ctx = '<s>' THEN ctx ELSE coalesce(a.class, ctx) END AS ctx, ev.w AS word, coalesce(b.class, ev.w) AS w, coalesce(b.pw, 1) AS pw FROM ev LEFT JOIN cd a ON ev.ctx = a.w LEFT JOIN cd b ON ev.w = b.w), {Q.bigram_lookup('s', 'em', 'm', 'item_id, sent_id, pos, word, pw')}
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, word AS w, round(log10(p * pw), 6) AS logp FROM s WHERE p > 0""")
def q_class(spark, d):
    size = lambda w: F.when(F.length(w) <= 2, "SHORT").when(F.length(w) <= 5, "MID").otherwise("LONG")
    sents = docs(spark, d)
    model = E.train(C.count_ngrams(sents.select(F.transform("words", size).alias("words")), 2), 2, "wb")
    words = sents.select(F.explode("words").alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("cnt")).withColumn("ord", F.lit(1))
    classes = em.class_definitions(counts, counts.select("w", size(F.col("w")).alias("class")))
    out = M.simple_class(R.events_of(held_out(spark, d), 2, ["item_id", "sent_id"]), model, cut(classes))
    return out.where(F.col("logp") > R.ZERO).select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.round("logp", 6).alias("logp"))


@register("skip_mix", f"""WITH {TRI}, {Q.HELD_OUT},{Q.events('ev', 'tsent', 3, 'item_id, sent_id')}, e2 AS (SELECT item_id, sent_id, pos, ctx AS whole_ctx, w, {Q.last('ctx')} AS c1, CASE WHEN strpos(ctx, ' ') = 0 THEN '' ELSE {Q.first('ctx')} END AS c2 FROM ev),
l1 AS (SELECT item_id, sent_id, pos, c1 AS ctx, w FROM e2), l2 AS (SELECT item_id, sent_id, pos, c2 AS ctx, w FROM e2), {Q.bigram_lookup('s1', 'l1', 'm', 'item_id, sent_id, pos')}, {Q.bigram_lookup('s2', 'l2', 'm', 'item_id, sent_id, pos')}
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, s1.w, round(log10(0.7::DOUBLE * s1.p + 0.3::DOUBLE * s2.p), 6) AS logp FROM s1 JOIN s2 USING (item_id, sent_id, pos) WHERE s1.p + s2.p > 0""")
def q_skip(spark, d):
    ev = R.events_of(held_out(spark, d), 3, ["item_id", "sent_id"])
    moved = ev.select(S.but_last(F.col("ctx")).alias("ctx"))  # the contexts without their last word are looked up too
    model = wb_model(spark, d, events=ev.select("ctx").union(moved))
    none = spark.createDataFrame([], "w string, p double")
    out = M.skip_mix(ev, model, none, 0.3)
    return out.where(F.col("logp") > R.ZERO).select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.round("logp", 6).alias("logp"))


@register("recogniser_lm")
def q_recogniser(spark, d):
    ev = held_out_events(spark, d)
    out = M.recogniser(ev, wb_model(spark, d, events=ev))
    return out.where(F.col("logp") > R.ZERO).select("item_id", "sent_id", "pos", "w", F.round("logp", 4).alias("logp"))


@register("var_prune", f"""WITH {Q.train_counts(2)}, k AS (SELECT * FROM c WHERE ord = 2), t AS (SELECT ctx, sum(cnt)::DOUBLE AS n1 FROM k GROUP BY ctx), u AS (SELECT w, cnt AS c2, (SELECT sum(cnt)::DOUBLE FROM c WHERE ord = 1 AND w <> '<s>') AS n2 FROM c WHERE ord = 1 AND w <> '<s>'),
x AS (SELECT k.ctx, k.w, abs(k.cnt / n1 - c2 / n2) AS d, 1 / sqrt(n1) + 1 / sqrt(n2) AS s FROM k JOIN t USING (ctx) JOIN u USING (w))
SELECT ctx || ' ' || w AS ngram, round(2 * exp(-2 * d * d / (s * s)), 6) AS bound FROM x WHERE 2 * exp(-2 * d * d / (s * s)) > 0.1""")
def q_var_prune(spark, d):
    out = prune.hoeffding_prunable(counted(spark, d, 2), 2, 0.1)
    return out.select(F.concat_ws(" ", "ctx", "w").alias("ngram"), F.round("bound", 6).alias("bound"))


@register("entropy_prune", f"""WITH {WB}, sm AS (SELECT ctx, 1 - sum(p) AS num, 1 - sum(lowp) AS den FROM m_b GROUP BY ctx),
x AS (SELECT b.ctx, b.w, b.p, b.lowp, num, den, log10(num + b.p) - log10(den + b.lowp) AS nb, log10(num / den) AS bow, uc.p AS pc FROM m_b b JOIN sm USING (ctx) JOIN m_u uc ON uc.w = CASE WHEN b.ctx = '<s>' THEN '</s>' ELSE b.ctx END),
y AS (SELECT ctx, w, pow(10.0, -pc * (p * (log10(lowp) + nb - log10(p)) + num * (nb - bow))) - 1 AS ch FROM x)
SELECT ctx || ' ' || w AS ngram, round(ch * 1e6, 4) AS change_ppm FROM y""")
def q_entropy(spark, d):
    out = prune.entropy_costs(wb_model(spark, d), 2)
    return out.select(F.concat_ws(" ", "ctx", "w").alias("ngram"), F.round(F.col("change") * 1e6, 4).alias("change_ppm"))


@register("entropy_pruned_model")
def q_entropy_model(spark, d):
    return shown_probs(prune.entropy_prune(wb_model(spark, d), 1e-7), 2)


@register("low_prob_prune_pass", f"WITH {WB} SELECT b.ctx || ' ' || b.w AS ngram FROM m_b b JOIN m_w x USING (ctx) WHERE log10(b.lowp) + log10(x.bow) > log10(b.p) + 1e-9")
def q_low_prob(spark, d):
    m = wb_model(spark, d)
    rows = prune.with_lower(m, 2).where(F.col("lowlog") + F.col("bow") > F.col("logp") + 1e-9)
    return rows.select(F.concat_ws(" ", "ctx", "w").alias("ngram"))


@register("quantise_hist", f"WITH {WB} SELECT round(log10(p), 4) AS logp, count(*) AS n FROM (SELECT p FROM m_u UNION ALL SELECT p FROM m_b) GROUP BY round(log10(p), 4)")
def q_hist(spark, d):
    rows = wb_model(spark, d).probs.where(F.col("logp") > R.ZERO)
    return rows.groupBy(F.round("logp", 4).alias("logp")).agg(F.count(F.lit(1)).alias("n"))


@register("quantised_model")
def q_quantised(spark, d):
    return shown_probs(prune.quantise(wb_model(spark, d), 64), None)


@register("reverse_model", f"""
WITH {Q.SENTENCES}, r AS (SELECT list_reverse(words) AS words FROM sent), {Q.counts('c', 'r', 2)},{Q.wb_bigram()} SELECT ctx || ' ' || w AS ngram, round(log10(p), 6) AS logp FROM m_b""")
def q_reverse_model(spark, d):
    m = E.train(C.reversed_counts(counted(spark, d, 2)), 2, "wb")
    return m.probs.where("ord = 2").where(F.col("logp") > R.ZERO).select(S.gram(F.col("ctx"), F.col("w")).alias("ngram"), F.round("logp", 6).alias("logp"))


@register("count_lm")
def q_count_lm(spark, d):
    c = cut(counted(spark, d, 2))
    v = c.where("ord = 1").count()
    f = em.count_model_features(R.events_of(held_out(spark, d), 2), c, 2, 8, 4, v)
    lam = em.fit_count_model(f, 2, 8)
    return spark.createDataFrame([(n, b, round(x, 4)) for (n, b), x in sorted(lam.items())], "ord int, bucket int, weight double")


@register("skip_em")
def q_skip_em(spark, d):
    _, skip = em.fit_skip(cut(C.count_ngrams(held_out(spark, d), 3)), 2, rounds=2)
    return skip.select("w", F.round("p", 5).alias("p"))


@register("word_classes")
def q_classes(spark, d):
    return em.induce_classes(cut(C.count_ngrams(held_out(spark, d), 2).where("ord = 2")), 8)
