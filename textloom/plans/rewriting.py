"""Queries over model transformations, wrappers, vocabulary selection, factored models and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import split_multiwords
from textloom.operators import bigmodel as B
from textloom.operators import counts as C
from textloom.operators import dynamic as M
from textloom.operators import estimate as E
from textloom.operators import factored as X
from textloom.operators import rewrite as W
from textloom.operators import score as R
from textloom.plans import sql as Q
from textloom.plans.counting import blocks, docs, held_out, shown
from textloom.plans.modelling import EVENTS, SCORED, STATS, TWO, WB, held_out_events, shown_probs, two_models, wb_model
from textloom.plans.session import cut, new_folder, table
from textloom.sources import tables
from textloom.sources import text as text_source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("counts_directory", f"WITH {Q.train_counts(2)} SELECT ord, {Q.gram()} AS ngram, CAST(cnt AS BIGINT) AS cnt FROM c WHERE {Q.first(Q.gram())} BETWEEN 'm' AND 'pz'")
def q_counts_directory(spark, d):
    path = new_folder(spark)
    tables.write_counts_table(C.count_ngrams(docs(spark, d), 2), path)
    return shown(tables.read_counts_table(spark, path, first=("m", "pz")))


@register("counts_of_vocabulary", f"""WITH {Q.train_counts(2)}, {Q.HELD_OUT}, v AS (SELECT DISTINCT unnest(words) AS w FROM tsent UNION SELECT '<s>' UNION SELECT '</s>')
SELECT ord, {Q.gram()} AS ngram, CAST(cnt AS BIGINT) AS cnt FROM c SEMI JOIN v USING (w) WHERE ctx = '' OR ctx IN (SELECT w FROM v)""")
def q_counts_of_vocabulary(spark, d):
    path = new_folder(spark)
    tables.write_counts_table(C.count_ngrams(docs(spark, d), 2), path)
    return shown(tables.read_counts_table(spark, path, vocabulary=held_out(spark, d).select(F.explode("words").alias("w")).distinct()))


@register("model_directory", f"WITH {Q.HELD_OUT},{Q.counts('c', 'tsent', 2)},{Q.wb_bigram()} SELECT 1 AS ord, w AS ngram, round(log10(p), 6) AS logp FROM m_u UNION ALL SELECT 2 AS ord, ctx || ' ' || w AS ngram, round(log10(p), 6) AS logp FROM m_b")
def q_model_directory(spark, d):
    path = new_folder(spark)
    tables.write_model_table(E.train(C.count_ngrams(held_out(spark, d), 2), 2, "wb"), path)
    return shown_probs(tables.read_model_table(spark, path))


@register("model_rescored", f"WITH {TWO}, k AS (SELECT ctx, w FROM m_b), {Q.bigram_lookup('kb', 'k', 'n', '1 AS one')} SELECT ctx || ' ' || w AS ngram, round(log10(p), 6) AS logp FROM kb WHERE p > 0")
def q_rescored(spark, d):
    a, b = two_models(spark, d)
    m = W.rescored(a, b)
    return m.probs.where(f"ord = 2 and logp > {-1e300}").select(F.concat_ws(" ", "ctx", "w").alias("ngram"), F.round("logp", 6).alias("logp"))


@register("unigram_probs", f"WITH {WB} SELECT w, round(p * 1e6, 4) AS ppm FROM m_u")
def q_unigrams(spark, d):
    return W.unigrams(wb_model(spark, d)).select("w", F.round(F.col("p") * 1e6, 4).alias("ppm"))


@register("dummy_weights", f"WITH {WB} SELECT w AS ctx, round(coalesce(log10(bow), 0), 6) + 0.0 AS bow FROM (SELECT w FROM m_u UNION ALL SELECT '<s>') u LEFT JOIN m_w ON u.w = m_w.ctx")
def q_dummy(spark, d):
    return W.with_dummy_weights(wb_model(spark, d)).bows.select("ctx", (F.round("bow", 6) + 0.0).alias("bow"))


@register("multiword_scores", f"""WITH {WB}, pw AS (SELECT p_partkey AS item_id, 1 AS sent_id, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS words FROM part), {Q.events('ev', 'pw', 2, 'item_id')}, {Q.bigram_lookup('s', 'ev', 'm', 'item_id')}
SELECT item_id, round(sum(CASE WHEN p > 0 THEN log10(p) ELSE 0 END), 5) + 0.0 AS logprob, CAST(count(*) FILTER (WHERE hit = 0) AS BIGINT) AS oovs FROM s GROUP BY item_id""")
def q_multiword(spark, d):
    joined = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("words"))
    ev = R.events_of(joined.select(split_multiwords(F.col("words")).alias("words")), 2)
    s = W.multiword_scores(joined, wb_model(spark, d, events=ev), ["item_id"])
    return s.select("item_id", (F.round("logprob", 5) + 0.0).alias("logprob"), F.col("oovs").cast("long").alias("oovs"))


@register("multiword_model", f"""WITH {WB}, mw AS (SELECT * FROM (VALUES ('of_the', 'of', 'the'), ('and_the', 'and', 'the'), ('de_la', 'de', 'la')) t(w, a, b)),
f AS (SELECT ctx, w AS a, p FROM m_b UNION ALL SELECT '' AS ctx, u.w, u.p FROM m_u u WHERE w IN (SELECT a FROM mw)),
x AS (SELECT f.ctx, mw.w, f.p AS pa, CASE WHEN b.p IS NOT NULL THEN b.p ELSE u.p * coalesce(bw.bow, 1) END AS pb FROM mw JOIN f USING (a) LEFT JOIN m_b b ON b.ctx = mw.a AND b.w = mw.b JOIN m_u u ON u.w = mw.b LEFT JOIN m_w bw ON bw.ctx = mw.a)
SELECT ctx, w, round(log10(pa) + log10(pb), 6) AS logp FROM x""")
def q_multiword_model(spark, d):
    names = spark.createDataFrame([("of_the",), ("and_the",), ("de_la",)], "w string")
    return W.multiword_model(wb_model(spark, d), names).select("ctx", "w", F.round("logp", 6).alias("logp"))


@register("stop_ngram", f"""WITH {WB}, {Q.HELD_OUT}, {Q.events('e0', 'tsent', 9, 'item_id, sent_id')},
ev AS (SELECT item_id, sent_id, pos, coalesce(list_filter(string_split(ctx, ' '), lambda x: x NOT IN ('the', 'of', 'and'))[-1], '') AS ctx, w FROM e0), {Q.bigram_lookup('s', 'ev', 'm', 'item_id, sent_id, pos')}
SELECT {STATS} FROM s""")
def q_stop_ngram(spark, d):
    ev = M.stop_events(R.events_of(held_out(spark, d), 9, ["item_id", "sent_id"]), ["the", "of", "and"], 2)
    s = R.text_stats(R.lookup(ev, wb_model(spark, d, events=ev)))
    return s.select(*[F.col(c).cast("long").alias(c) for c in ("sentences", "words", "oovs", "zeroprobs")], F.round("logprob", 4).alias("logprob"))


@register("hidden_boundary_lm", f"""WITH {WB}, {EVENTS}, {Q.bigram_lookup('s', 'ev', 'm', 'item_id, sent_id, pos')},
x AS (SELECT s.*, CASE WHEN b.p IS NOT NULL THEN b.p ELSE u.p * coalesce(bw.bow, 1) END AS pe, CASE WHEN c.p IS NOT NULL THEN c.p WHEN cu.p IS NOT NULL THEN cu.p * coalesce(cw.bow, 1) ELSE 0 END AS pa
  FROM s LEFT JOIN m_b b ON b.ctx = s.ctx AND b.w = '</s>' JOIN m_u u ON u.w = '</s>' LEFT JOIN m_w bw ON bw.ctx = s.ctx LEFT JOIN m_b c ON c.ctx = '</s>' AND c.w = s.w LEFT JOIN m_u cu ON cu.w = s.w LEFT JOIN m_w cw ON cw.ctx = '</s>')
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, w, round(log10(greatest(p, pe * pa)), 6) AS logp FROM x WHERE greatest(p, pe * pa) > 0""")
def q_boundary(spark, d):
    ev = held_out_events(spark, d)
    out = M.sentence_boundary(ev, wb_model(spark, d, events=ev.select("ctx").union(spark.createDataFrame([("</s>",)], "ctx string"))), "</s>")
    return out.where(F.col("logp") > R.ZERO).select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.round("logp", 6).alias("logp"))


@register("dynamic_states", f"""WITH {TWO}, x AS (SELECT item_id, sent_id, pos, w, CASE WHEN item_id % 2 = 0 THEN pa ELSE pb END AS p FROM ab)
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, w, round(log10(p), 6) AS logp FROM x WHERE p > 0""")
def q_dynamic(spark, d):
    ev = held_out_events(spark, d)
    a, b = two_models(spark, d, ev)
    ev = ev.withColumn("state", F.when(F.col("item_id") % 2 == 0, "a").otherwise("b"))
    out = M.by_state(ev, {"a": a, "b": b}, "state").where(F.col("logp") > R.ZERO)
    return out.select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "w", F.round("logp", 6).alias("logp"))


@register("add_statistics", f"""WITH {SCORED}, a AS (SELECT {STATS} FROM s WHERE item_id % 2 = 0), b AS (SELECT {STATS} FROM s) SELECT b.sentences - a.sentences AS sentences, b.words - a.words AS words, b.oovs - a.oovs AS oovs, round(b.logprob - a.logprob, 1) AS logprob FROM a, b""")
def q_add(spark, d):
    ev = held_out_events(spark, d)
    scored = R.lookup(ev, wb_model(spark, d, events=ev))
    out = W.add_statistics([R.text_stats(scored), R.text_stats(scored.where("item_id % 2 = 0"))], [1, -1])
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("sentences", "words", "oovs")], F.round("logprob", 1).alias("logprob"))


@register("uniform_classes", """WITH c AS (SELECT lang AS class, source AS w FROM documents GROUP BY ALL) SELECT class, w, round(1.0 / count(*) OVER (PARTITION BY class), 6) AS p FROM c""")
def q_uniform(spark, d):
    c = table(spark, d, "documents").select(F.col("lang").alias("class"), F.col("source").alias("w")).distinct()
    return W.uniform_classes(c).select("class", "w", F.round("p", 6).alias("p"))


def _unigrams(sents: DataFrame) -> DataFrame:
    return C.count_ngrams(sents, 1).where(~F.col("w").isin("<s>", "</s>")).select("w", "cnt")


@register("vocabulary_selection")
def q_vocabulary(spark, d):
    sents = docs(spark, d)
    corpora = {k: cut(_unigrams(sents.where(F.col("lang") == k))) for k in ("de", "en", "es", "fr")}
    weights, _ = W.select_vocabulary(corpora, cut(_unigrams(held_out(spark, d))))
    return weights.select("w", F.round("weight", 3).alias("weight"))


@register("vocabulary_ranking")
def q_vocabulary_rank(spark, d):
    sents = docs(spark, d)
    sources = {k: cut(_unigrams(sents.where(F.col("lang") == k))) for k in ("de", "en", "es", "fr")}
    return spark.createDataFrame(W.rank_vocabulary(sources, _unigrams(held_out(spark, d)), 4), "source string, gain long")


CLASSES = [("ART", 0.5, ["the"]), ("ART", 0.2, ["a"]), ("ART", 0.3, ["la"]), ("PLACE", 0.6, ["of", "the"]), ("PLACE", 0.4, ["in", "the"]), ("LINK", 1.0, ["the", "of"])]

#: Held-out sentences with the longest expansion at each place, left to right, replaced by its class.
REPLACED = f"""{Q.HELD_OUT},
defs(class, p, e) AS (VALUES {", ".join(f"('{c}', {p}::DOUBLE, {e})" for c, p, e in CLASSES)}),
walk AS (
  SELECT item_id, sent_id, words, 1 AS i, CAST([] AS VARCHAR[]) AS done FROM tsent
  UNION ALL
  SELECT item_id, sent_id, words, i + greatest(coalesce(len(best.e), 1), 1), list_append(done, coalesce(best.class, words[i])) FROM (
    SELECT *, (SELECT arg_max({{'class': class, 'e': e}}, len(e)) FROM defs WHERE words[i:i + len(e) - 1] = e) AS best FROM walk WHERE i <= len(words))),
rsent AS (SELECT item_id, sent_id, done AS words FROM walk WHERE i > len(words))"""


def class_frame(spark) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class string, p double, expansion array<string>")


@register("class_replaced_multiword", f"WITH RECURSIVE {REPLACED}, {Q.counts('c', 'rsent', 2)} SELECT ord, {Q.gram()} AS ngram, CAST(cnt AS BIGINT) AS cnt FROM c")
def q_class_multiword(spark, d):
    return shown(C.count_ngrams(C.class_replaced(held_out(spark, d), class_frame(spark), ["item_id", "sent_id"]), 2))


@register("class_expansion_counts", f"""WITH RECURSIVE {REPLACED},
used AS (SELECT class, e, count(*) AS n FROM (SELECT words, item_id, sent_id, i, (SELECT arg_max({{'class': class, 'e': e}}, len(e)) FROM defs WHERE words[i:i + len(e) - 1] = e) AS best FROM walk WHERE i <= len(words)) JOIN defs ON class = best.class AND e = best.e GROUP BY ALL),
al AS (SELECT defs.class, defs.e, coalesce(n, 0) AS n FROM defs LEFT JOIN used ON defs.class = used.class AND defs.e = used.e)
SELECT class, array_to_string(e, ' ') AS expansion, CAST(n AS BIGINT) AS n, round((n + 1) / (sum(n) OVER (PARTITION BY class) + count(*) OVER (PARTITION BY class)), 8) AS p FROM al""")
def q_class_counts(spark, d):
    found = C.expansion_probabilities(C.class_spans(held_out(spark, d), class_frame(spark), ["item_id", "sent_id"]), class_frame(spark))
    return found.select("class", F.array_join("expansion", " ").alias("expansion"), "n", F.round("p", 8).alias("p"))


@register("class_expansion", f"""WITH RECURSIVE {REPLACED}, {Q.counts('c', 'rsent', 2)}, {Q.wb_bigram()},
ways AS (SELECT class AS tok, e, p FROM defs UNION ALL SELECT w, [w], 1.0::DOUBLE FROM m_u WHERE w NOT IN (SELECT class FROM defs) UNION ALL SELECT '<s>', ['<s>'], 1.0::DOUBLE),
pc AS (SELECT w AS tok, p FROM m_u UNION ALL SELECT '<s>', p FROM m_u WHERE w = '</s>'),
ex AS (
  SELECT x.e AS ws, len(x.e) AS f, len(x.e) AS z, u.p * x.p AS p FROM m_u u JOIN ways x ON x.tok = u.w WHERE u.p > 0
  UNION ALL SELECT list_concat(x.e, y.e), len(x.e), len(y.e), pc.p * b.p * x.p * y.p FROM m_b b JOIN pc ON pc.tok = b.ctx JOIN ways x ON x.tok = b.ctx JOIN ways y ON y.tok = b.w),
cut1 AS (SELECT ws, z, p, unnest(range(0, f)) AS a FROM ex), cut2 AS (SELECT ws, p, a, unnest(range(0, z)) AS b FROM cut1),
win AS (SELECT list_slice(ws, a + 1, len(ws) - b) AS g, sum(p) AS p FROM cut2 WHERE len(ws) - b > a GROUP BY 1),
held AS (SELECT [w] AS g FROM m_u UNION ALL SELECT ['<s>'] UNION ALL SELECT [ctx, w] FROM m_b),
plain AS (SELECT win.g, CASE WHEN len(win.g) = 1 THEN 0 ELSE coalesce(pc.p, 0) * coalesce(k.bow, 1) * coalesce(u.p, 0) END AS q FROM win LEFT JOIN pc ON pc.tok = win.g[1] LEFT JOIN m_w k ON k.ctx = win.g[1] LEFT JOIN m_u u ON u.w = win.g[2]
  WHERE len(win.g) <= 2 AND win.g NOT IN (SELECT g FROM held)),
joint AS (SELECT win.g, win.p + coalesce(q, 0) AS p FROM win LEFT JOIN plain ON win.g = plain.g WHERE len(win.g) <= 2),
two AS (SELECT g[1] AS ctx, g[2] AS w, p FROM joint WHERE len(g) = 2), one AS (SELECT g[1] AS w, p FROM joint WHERE len(g) = 1 AND g[1] <> '<s>' UNION ALL SELECT '<s>', p FROM m_u WHERE w = '</s>'),
whole AS (SELECT two.ctx, greatest(sum(two.p), coalesce(max(one.p), 0)) AS t FROM two LEFT JOIN one ON one.w = two.ctx GROUP BY two.ctx)
SELECT CAST(2 AS INTEGER) AS ord, two.ctx || ' ' || two.w AS ngram, round(log10(p / t), 6) AS logp FROM two JOIN whole ON two.ctx = whole.ctx
UNION ALL SELECT 1, w, round(log10(p / (SELECT sum(p) FROM one WHERE w <> '<s>')), 6) FROM one WHERE w <> '<s>'""")
def q_expansion(spark, d):
    """A class model of replaced text, as a word bigram model; expansions of two words make windows inside them."""
    replaced = cut(C.class_replaced(held_out(spark, d), class_frame(spark), ["item_id", "sent_id"]))
    model = E.train(C.count_ngrams(replaced, 2), 2, "wb").persist()
    return shown_probs(W.expand_classes(model, class_frame(spark), 2))


@register("changed_vocabulary")
def q_changed(spark, d):
    vocabulary = _unigrams(held_out(spark, d)).where("cnt >= 3").select("w")
    return shown_probs(W.change_vocabulary(E.train(C.count_ngrams(held_out(spark, d), 2), 2, "wb").persist(), vocabulary), None)


@register("least_backoff")
def q_least(spark, d):
    return shown_probs(W.with_least_backoff(E.train(C.count_ngrams(held_out(spark, d), 2), 2, "abs").persist(), 0.3), 2)


@register("empty_sentence")
def q_empty(spark, d):
    return shown_probs(W.with_empty_sentence(E.train(C.count_ngrams(held_out(spark, d), 2), 2, "wb").persist(), 0.1), 2)


@register("factored_model")
def q_factored(spark, d):
    tokens = blocks(spark, d).select("block", "lang", F.posexplode("words").alias("k", "w"), "words")
    tokens = tokens.select("block", F.col("lang").alias("l"), F.when(F.col("k") == 0, "<s>").otherwise(F.get("words", F.col("k") - 1)).alias("h"), "w")
    test = R.events_of(held_out(spark, d), 2, ["item_id", "sent_id"]).where("w <> '</s>'").select("item_id", "sent_id", "pos", F.col("ctx").alias("h"), F.lit("en").alias("l"), "w")
    spec, asked = X.Spec("w", ("h", "l")), R.contexts_of(test.withColumnRenamed("h", "ctx"), 2)
    counts = X.node_counts(tokens, spec, spec.under(spec.top), "block", None if asked is None else {"h": asked.withColumnRenamed("ctx", "h")})
    m = X.estimate(tokens, spec, counts=cut(counts))
    return m.score(test).where(F.col("logp") > R.ZERO).select("item_id", "sent_id", "pos", "w", F.round("logp", 6).alias("logp"))


EVENT_WORDS = "es AS (SELECT user_id, event_type AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), el AS (SELECT user_id, list(w ORDER BY k) AS words FROM es GROUP BY user_id)"


def user_sequences(spark, d) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return e.select("user_id", F.transform("l", lambda x: x["event_type"]).alias("words"))


@register("event_sequence_counts", f"WITH {EVENT_WORDS}, {Q.counts('c', 'el', 3)} SELECT ord, {Q.gram()} AS ngram, CAST(cnt AS BIGINT) AS cnt FROM c")
def q_event_counts(spark, d):
    return C.count_ngrams(user_sequences(spark, d), 3).select("ord", F.when(F.col("ctx") == "", F.col("w")).otherwise(F.concat_ws(" ", "ctx", "w")).alias("ngram"), "cnt")


@register("event_model_perplexity", f"""WITH {EVENT_WORDS}, {Q.counts('c', 'el', 2)}, {Q.wb_bigram()}, {Q.events('ev', 'el', 2, 'user_id')}, {Q.bigram_lookup('s', 'ev', 'm', 'user_id')}
SELECT user_id, round(sum(log10(p)), 4) AS logprob, count(*) AS events FROM s GROUP BY user_id""")
def q_event_model(spark, d):
    sents = user_sequences(spark, d)
    m = E.train(C.count_ngrams(sents, 2), 2, "wb")
    s = R.lookup(R.events_of(sents, 2, ["user_id"]), m)
    return s.groupBy("user_id").agg(F.round(F.sum("logp"), 4).alias("logprob"), F.count(F.lit(1)).alias("events"))


@register("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_windows(spark, d):
    e = table(spark, d, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@register("cache_mixture", r"""
WITH cw AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM conversations), t AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM cw),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS n FROM t), u AS (SELECT w, count(*)::DOUBLE / (SELECT count(*) FROM t) AS p FROM t GROUP BY w),
j AS (SELECT a.conv_id, a.n, a.w, count(b.w) FILTER (WHERE b.w = a.w) AS same FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.n < a.n AND b.n >= a.n - 20 GROUP BY a.conv_id, a.n, a.w)
SELECT conv_id, round(sum(log10(0.9::DOUBLE * p + 0.1::DOUBLE * CASE WHEN n > 1 THEN same::DOUBLE / least(n - 1, 20) ELSE 0 END)), 4) AS logprob FROM j JOIN u USING (w) GROUP BY conv_id""")
def q_cache_mix(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]+"), lambda w: w != "")).alias("k", "w"))
    cached = M.cache_probs(words, ["conv_id"], ["turn", "k"], 20)
    total = words.count()
    uni = words.groupBy("w").agg((F.count(F.lit(1)) / F.lit(float(max(1, total)))).alias("p"))
    scored = M.with_cache(cached.join(uni, "w").withColumn("logp", F.log10("p")), 0.1)
    return scored.groupBy("conv_id").agg(F.round(F.sum("logp"), 4).alias("logprob"))


@register("sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, session""")
def q_sessions(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long").alias("session"), "n")


@register("bucketed_model", f"WITH {Q.HELD_OUT},{Q.counts('c', 'tsent', 2)},{Q.wb_bigram()} SELECT CAST(2 AS INTEGER) AS ord, ctx || ' ' || w AS ngram, round(log10(p), 6) AS logp FROM m_b")
def q_bucketed(spark, d):
    """A Witten-Bell model whose counts are written in buckets and never dealt again."""
    return shown_probs(B.train(C.count_ngrams(held_out(spark, d), 2), 2, "wb", buckets=8), 2)


VERBAL = [(",", " ,COMMA"), (".", " .PERIOD"), ("%", " %PERCENT"), ("#", " #SHARP-SIGN"), ("|", ' "DOUBLE-QUOTE'), ("$", " @AT-SIGN")]


def _verbal_sql(text: str) -> str:
    for mark, word in VERBAL:
        text = f"replace({text}, '{mark}', '{word}')"
    return text


@register("plain_text", rf"""
WITH v AS (SELECT doc_id, string_split({_verbal_sql("text")}, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, sent_id, list_filter(regexp_split_to_array(l[sent_id], '[ 	
]+'), lambda x: x <> '') AS ws FROM (SELECT *, unnest(range(1, len(l) + 1)) AS sent_id FROM v)),
t AS (SELECT doc_id, sent_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM s),
q AS (SELECT *, sum(CASE WHEN w = '"DOUBLE-QUOTE' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_id, k) - 1 AS place FROM t),
r AS (SELECT doc_id, sent_id, k, CASE WHEN w = '"DOUBLE-QUOTE' THEN CASE WHEN place % 5 = 0 THEN 'quote' ELSE '' END
  ELSE replace(replace(replace(replace(replace(w, '@AT-SIGN', 'at'), '%PERCENT', 'percent'), ',COMMA', ''), '#SHARP-SIGN', ''), '.PERIOD', '') END AS w FROM q)
SELECT doc_id, sent_id, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY k)) AS digest FROM r WHERE w <> '' GROUP BY doc_id, sent_id""")
def q_plain_text(spark, d):
    """Every line of the documents with its marks spelled out, and read out again."""
    text = F.col("text")
    for mark, word in VERBAL:
        text = F.replace(text, F.lit(mark), F.lit(word))
    said = W.plain_sentences(text_source.sentences(table(spark, d, "documents").select("doc_id", text.alias("text"))))
    return said.where(F.size("words") > 0).select("doc_id", "sent_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))
