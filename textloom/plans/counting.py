"""Queries over sources, words and counts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import sequences as S
from textloom.operators import counts as C
from textloom.plans import sql as Q
from textloom.plans.session import cut, table
from textloom.sources.text import sentences, weighted_sentences, with_directives

#: The stop words of the stop-word query.
STOP = ("the", "of", "and", "de", "la", "und", "que", "to")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), keys=("doc_id", "lang", "source"))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "benchmark"), keys=("item_id",))


def parts_of(spark: SparkSession, d: str, most: int) -> int:
    """As many parts as shuffles have, or more where one would have more than ``most`` bytes of text."""
    size = table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def blocks(spark: SparkSession, d: str, n: int | None = None) -> DataFrame:
    """``docs`` dealt evenly by the column ``block``: as many blocks as shuffles have partitions, or ``n``, whatever the files' sizes."""
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = table(spark, d, "documents").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    return sentences(texts.repartition(n, "block"), keys=("block", "doc_id", "lang", "source"))


def counted(spark: SparkSession, d: str, order: int, contexts: DataFrame | None = None) -> DataFrame:
    if order == 1:
        return C.count_ngrams(docs(spark, d), 1)  # words combine well where they are read
    return C.count_ngrams(blocks(spark, d), order, block="block", contexts=contexts)


def shown(counts: DataFrame) -> DataFrame:
    return counts.select("ord", S.gram(F.col("ctx"), F.col("w")).alias("ngram"), "cnt")


SHOW = f"ord, {Q.gram()} AS ngram, CAST(cnt AS BIGINT) AS cnt"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("sentences", f"WITH {Q.SENTENCES} SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, array_to_string(words, ' ') AS sentence, CAST(len(words) AS BIGINT) AS n_words FROM sent")
def q_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.array_join("words", " ").alias("sentence"), F.size("words").cast("long").alias("n_words"))


@register("weighted_lines", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(quality || ' ' || replace(text, chr(10), ' '), '[ \t\r\n]+'), lambda x: x <> '') AS t FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CAST(t[1] AS DOUBLE) AS weight, array_to_string(list_slice(t, 2, len(t)), ' ') AS sentence FROM w WHERE len(t) > 1""")
def q_weighted_lines(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    lines = joined.select("doc_id", F.concat_ws(" ", F.col("quality").cast("string"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))
    return weighted_sentences(lines, keys=("doc_id",)).select("doc_id", "weight", F.array_join("words", " ").alias("sentence"))


@register("state_directives", """
WITH x AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations)
SELECT conv_id, turn, role = 'user' AS directive, CAST(s AS BIGINT) AS state_id FROM x""")
def q_state_directives(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("role") == "user", "@@ ").otherwise(""), F.coalesce("text", F.lit(""))).alias("line"))
    return with_directives(rows, "@@", "turn", group=("conv_id",)).select("conv_id", "turn", "directive", F.col("state_id").cast("long").alias("state_id"))


@register("sequence_scalars", f"""
WITH {Q.SENTENCES} SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, array_to_string(list_reverse(words), ' ') AS reversed, lower(array_to_string(words, ' ')) AS lowered,
  array_to_string({Q.padded()}, ' ') AS bounded, list_contains(words, 'the') AS has_the, array_to_string(list_filter(words, lambda x: x NOT IN ('the', 'of')), ' ') AS quiet FROM sent""")
def q_sequence_scalars(spark, d):
    w = F.col("words")
    return docs(spark, d).select(
        "doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.array_join(S.reverse_words(w), " ").alias("reversed"), F.array_join(S.lower_words(w), " ").alias("lowered"),
        F.array_join(S.with_boundaries(w), " ").alias("bounded"), F.array_contains(w, "the").alias("has_the"), F.array_join(S.without(w, ["the", "of"]), " ").alias("quiet"),
    )


@register("log_scalars", """
WITH p AS (SELECT event_id, log10((abs(value) + 1) / (abs(value) + 2)) AS a, log10(1 / (abs(value) + 3)) AS b FROM events)
SELECT event_id, round(a + log10(1 + pow(10.0, b - a)), 6) AS added, round(a + log10(1 - pow(10.0, b - a)), 6) AS subtracted,
  round_even(a * 2.302585092994046 * 10000.5, 0) AS intlog, greatest(round_even(a * 2.302585092994046 * 10000.5 / 1024, 0), -255.0::DOUBLE) AS bytelog FROM p""")
def q_log_scalars(spark, d):
    v = F.abs("value")
    rows = table(spark, d, "events").select("event_id", F.log10((v + 1) / (v + 2)).alias("a"), F.log10(1 / (v + 3)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("event_id", F.round(S.log_add(a, b), 6).alias("added"), F.round(S.log_sub(a, b), 6).alias("subtracted"), S.to_intlog(a).alias("intlog"), S.to_bytelog(a).alias("bytelog"))


@register("multiwords", r"""
WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS m FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split(m, '_'), lambda x: x <> ''), ' ') AS parts, CAST(len(list_filter(string_split(m, '_'), lambda x: x <> '')) AS BIGINT) AS n FROM p""")
def q_multiwords(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.array(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("words"))
    parts = S.split_multiwords(F.col("words"))
    return rows.select("p_partkey", F.array_join(parts, " ").alias("parts"), F.size(parts).cast("long").alias("n"))


@register("oov_mapping", f"""
WITH {Q.SENTENCES}, {Q.HELD_OUT}, v AS (SELECT DISTINCT unnest(words) AS w FROM sent),
x AS (SELECT item_id, sent_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM tsent)
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, string_agg(coalesce(v.w, '<unk>'), ' ' ORDER BY pos) AS mapped FROM x LEFT JOIN v ON x.w = v.w GROUP BY item_id, sent_id""")
def q_oov_mapping(spark, d):
    vocabulary = docs(spark, d).select(F.explode("words").alias("w")).distinct()
    out = C.map_oov(held_out(spark, d), vocabulary, ["item_id", "sent_id"])
    return out.select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.array_join("words", " ").alias("mapped"))


@register("alias_substitution", f"""
WITH {Q.HELD_OUT}, a AS (SELECT * FROM (VALUES ('the', 'DET'), ('of', 'PREP'), ('and', 'CONJ')) t(alias, word)),
x AS (SELECT item_id, sent_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM tsent)
SELECT item_id, CAST(sent_id AS BIGINT) AS sent_id, string_agg(coalesce(a.word, x.w), ' ' ORDER BY pos) AS words FROM x LEFT JOIN a ON x.w = a.alias GROUP BY item_id, sent_id""")
def q_alias(spark, d):
    aliases = spark.createDataFrame([("the", "DET"), ("of", "PREP"), ("and", "CONJ")], "alias string, word string")
    out = C.substitute_aliases(held_out(spark, d), aliases, ["item_id", "sent_id"])
    return out.select("item_id", F.col("sent_id").cast("long").alias("sent_id"), F.array_join("words", " ").alias("words"))


@register("factor_extraction", """
SELECT doc_id, 'W-' || lang || ':L-' || source AS token, lang AS f_w, source AS f_l FROM documents""")
def q_factors(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("W-"), "lang", F.lit(":L-"), "source").alias("token"))
    f = S.factors_of(F.col("token"))
    return rows.select("doc_id", "token", f["W"].alias("f_w"), f["L"].alias("f_l"))


@register("word_counts", f"WITH {Q.train_counts(1)} SELECT w AS word, CAST(cnt AS BIGINT) AS cnt FROM c")
def q_word_counts(spark, d):
    return counted(spark, d, 1).select(F.col("w").alias("word"), "cnt")


@register("bigram_counts", f"WITH {Q.train_counts(2)} SELECT {SHOW} FROM c WHERE ord = 2")
def q_bigram_counts(spark, d):
    return shown(counted(spark, d, 2).where("ord = 2"))


@register("ngram_counts_123", f"WITH {Q.train_counts(3)} SELECT {SHOW} FROM c")
def q_ngram_counts(spark, d):
    return shown(counted(spark, d, 3))


@register("min_order_counts", f"WITH {Q.train_counts(3)} SELECT {SHOW} FROM c WHERE ord >= 2")
def q_min_order(spark, d):
    return shown(C.count_ngrams(docs(spark, d), 3, least=2))


@register("weighted_counts", f"""
WITH {Q.SENTENCES}, ws AS (SELECT s.*, 0.5 + quality AS weight FROM sent s JOIN labels USING (doc_id)), {Q.grams('g', 'ws', 2, 'weight')}
SELECT ord, {Q.gram()} AS ngram, CAST(sum(weight) AS DOUBLE) AS cnt FROM g GROUP BY ord, ctx, w""")
def q_weighted_counts(spark, d):
    sents = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return shown(C.count_ngrams(sents, 2, weight=F.lit(0.5) + F.col("quality")))


CONTINUOUS = f"WITH {Q.SENTENCES}, whole AS (SELECT doc_id, flatten(list(words ORDER BY sent_id)) AS words FROM sent GROUP BY doc_id), {Q.counts('c', 'whole', 2, boundaries=False)}"


@register("continuous_bigrams", f"{CONTINUOUS} SELECT {SHOW} FROM c")
def q_continuous(spark, d):
    return shown(C.count_ngrams(C.continuous_sentences(docs(spark, d)), 2, boundaries=False))


@register("recomputed_lower", f"""
WITH {Q.train_counts(3)}, t AS (SELECT * FROM c WHERE ord = 3),
s2 AS (SELECT ctx AS g, sum(cnt) AS s FROM t GROUP BY ctx),
l2 AS (SELECT 2 AS ord, ctx, w, coalesce(s, cnt) AS cnt FROM (SELECT * FROM c WHERE ord = 2) b LEFT JOIN s2 ON b.ctx || ' ' || b.w = s2.g),
s1 AS (SELECT ctx AS g, sum(cnt) AS s FROM l2 GROUP BY ctx),
l1 AS (SELECT 1 AS ord, ctx, w, coalesce(s, cnt) AS cnt FROM (SELECT * FROM c WHERE ord = 1) b LEFT JOIN s1 ON b.w = s1.g)
SELECT {SHOW} FROM (SELECT * FROM t UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1)""")
def q_recomputed(spark, d):
    return shown(C.recompute_lower(cut(counted(spark, d, 3)), 3))


@register("min_count_filter", f"""
WITH {Q.train_counts(3)}, a AS (SELECT * FROM c WHERE ord = 1 AND cnt >= 3),
b AS (SELECT * FROM c WHERE ord = 2 AND cnt >= 2 AND ctx IN (SELECT w FROM a)),
e AS (SELECT * FROM c WHERE ord = 3 AND cnt >= 2 AND ctx IN (SELECT ctx || ' ' || w FROM b))
SELECT {SHOW} FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e)""")
def q_min_count(spark, d):
    return shown(C.at_least(cut(counted(spark, d, 3)), {1: 3, 2: 2, 3: 2}, 3))


@register("constant_counts", f"WITH {Q.train_counts(2)} SELECT ord, {Q.gram()} AS ngram, CAST(1 AS BIGINT) AS cnt FROM c")
def q_constant(spark, d):
    return shown(C.constant(counted(spark, d, 2)))


BOTH = f"WITH {Q.SENTENCES}, {Q.counts('c', 'sent', 2)}, {Q.HELD_OUT}, {Q.counts('t', 'tsent', 2)}"


@register("intersect_counts", f"{BOTH} SELECT ord, {Q.gram('c.ctx', 'c.w')} AS ngram, CAST(c.cnt AS BIGINT) AS cnt FROM c SEMI JOIN t USING (ord, ctx, w)")
def q_intersect(spark, d):
    return shown(C.intersect(counted(spark, d, 2), C.count_ngrams(held_out(spark, d), 2)))


@register("intersect_counts_zero", f"{BOTH} SELECT ord, {Q.gram('t.ctx', 't.w')} AS ngram, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt FROM t LEFT JOIN c USING (ord, ctx, w)")
def q_intersect_zero(spark, d):
    return shown(C.intersect(counted(spark, d, 2), C.count_ngrams(held_out(spark, d), 2), keep_zero=True))


@register("limit_vocab", f"""
{BOTH}, v AS (SELECT w FROM t WHERE ord = 1)
SELECT {SHOW} FROM c WHERE w IN (SELECT w FROM v) AND (ctx = '' OR ctx IN (SELECT w FROM v))""")
def q_limit_vocab(spark, d):
    vocabulary = C.count_ngrams(held_out(spark, d), 1).select("w")
    return shown(C.limit_vocabulary(counted(spark, d, 2), vocabulary, 2))


@register("merge_counts", f"{BOTH} SELECT ord, {Q.gram()} AS ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM c UNION ALL SELECT * FROM t) GROUP BY ord, ctx, w")
def q_merge(spark, d):
    return shown(C.merge(counted(spark, d, 2), C.count_ngrams(held_out(spark, d), 2)))


@register("lowered_counts", f"WITH {Q.train_counts(2)} SELECT ord, {Q.gram('lower(ctx)', 'lower(w)')} AS ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM c GROUP BY ord, lower(ctx), lower(w)")
def q_lowered(spark, d):
    return shown(C.lowered(counted(spark, d, 2)))


@register("reverse_counts", f"""
WITH {Q.train_counts(2)}, r AS (SELECT ord, list_transform(list_reverse(string_split({Q.gram()}, ' ')), lambda x: CASE WHEN x = '<s>' THEN '</s>' WHEN x = '</s>' THEN '<s>' ELSE x END) AS g, cnt FROM c)
SELECT ord, array_to_string(g, ' ') AS ngram, CAST(cnt AS BIGINT) AS cnt FROM r""")
def q_reverse(spark, d):
    return shown(C.reversed_counts(counted(spark, d, 2)))


@register("context_counts", f"WITH {Q.train_counts(2)} SELECT ord, ctx, CAST(sum(cnt) AS BIGINT) AS cnt FROM c WHERE ctx <> '' GROUP BY ord, ctx")
def q_context(spark, d):
    return C.context_counts(counted(spark, d, 2))


@register("subset_contexts", f"{BOTH} SELECT ord, {Q.gram('c.ctx', 'c.w')} AS ngram, CAST(cnt AS BIGINT) AS cnt FROM c WHERE ctx IN (SELECT ctx FROM t)")
def q_subset(spark, d):
    return shown(C.subset_by_context(counted(spark, d, 2), C.count_ngrams(held_out(spark, d), 2)))


@register("event_filter", f"WITH {Q.train_counts(3)} SELECT {SHOW} FROM c WHERE ord = 3 OR (ord > 1 AND {Q.first('ctx')} = '<s>')")
def q_events(spark, d):
    return shown(C.scoring_events(counted(spark, d, 3), 3))


@register("count_of_counts", f"WITH {Q.train_counts(3)} SELECT ord, CAST(cnt AS BIGINT) AS k, count(*) AS n FROM c GROUP BY ord, cnt")
def q_coc(spark, d):
    return C.counts_of_counts(counted(spark, d, 3))


@register("meta_counts", f"""
WITH {Q.train_counts(2)}, r AS (SELECT * FROM c WHERE ord = 1 OR cnt >= 2)
SELECT {SHOW} FROM r UNION ALL
SELECT ord, {Q.gram('ctx', "'__META__' || cnt")} AS ngram, count(*) AS cnt FROM c WHERE ord = 2 AND cnt < 2 AND ctx IN (SELECT ctx FROM r WHERE ord = 2) GROUP BY ord, ctx, c.cnt""")
def q_meta(spark, d):
    return shown(C.meta_counts(cut(counted(spark, d, 2)), {1: 1, 2: 2}, 2))


KN3 = f"""{Q.train_counts(3)},
x1 AS (SELECT w, count(*) AS e FROM c WHERE ord = 2 GROUP BY w),
x2 AS (SELECT {Q.shorter()} AS ctx2, w, count(*) AS e FROM c WHERE ord = 3 GROUP BY ctx2, w),
kn AS (SELECT ord, ctx, w, cnt FROM c WHERE ord = 3
  UNION ALL SELECT ord, c.ctx, c.w, CASE WHEN {Q.first('c.ctx')} = '<s>' THEN cnt ELSE coalesce(e, 0) END FROM c LEFT JOIN x2 ON c.ctx = x2.ctx2 AND c.w = x2.w WHERE ord = 2
  UNION ALL SELECT ord, c.ctx, c.w, CASE WHEN c.w = '<s>' THEN cnt ELSE coalesce(e, 0) END FROM c LEFT JOIN x1 ON c.w = x1.w WHERE ord = 1)"""


@register("kn_counts", f"WITH {KN3} SELECT {SHOW} FROM kn")
def q_kn_counts(spark, d):
    return shown(cut(C.kn_counts(counted(spark, d, 3), 3)))


STOPS = ", ".join(f"'{s}'" for s in STOP)


@register("stopword_counts", f"""
WITH {Q.SENTENCES}, p AS (SELECT {Q.padded()} AS ws FROM sent), j AS (SELECT ws, unnest(range(1, len(ws) + 1)) AS j FROM p),
n AS (SELECT ws[j] AS w, list_filter(list_slice(ws, 1, j - 1), lambda x: x NOT IN ({STOPS})) AS near FROM j),
o AS (SELECT w, near, unnest(range(1, least(2, len(near) + 1) + 1)) AS ord FROM n),
g AS (SELECT CAST(ord AS INTEGER) AS ord, CASE WHEN ord = 1 THEN '' ELSE near[len(near)] END AS ctx, w FROM o)
SELECT ord, {Q.gram()} AS ngram, count(*) AS cnt FROM g GROUP BY ord, ctx, w""")
def q_stop_counts(spark, d):
    return shown(C.stop_counts(docs(spark, d), 2, STOP))


@register("tagged_counts", f"""
WITH {Q.HELD_OUT}, j AS (SELECT words AS ws, unnest(range(1, len(words) + 1)) AS i FROM tsent),
win AS (SELECT list_slice(ws, i, i + 1) AS s FROM j), k AS (SELECT s, unnest(range(0, len(s))) AS k FROM win), n AS (SELECT s, k, unnest(range(k + 1, len(s) + 1)) AS n FROM k),
g AS (SELECT CAST(n AS INTEGER) AS ord, CASE WHEN n = 1 THEN s[1] WHEN k = 0 THEN s[1] || ' ' || s[2] ELSE 'T' || length(s[1]) || ' ' || s[2] END AS ngram FROM n)
SELECT ord, ngram, count(*) AS cnt FROM g GROUP BY ord, ngram""")
def q_tagged(spark, d):
    tagged = held_out(spark, d).select(F.transform("words", lambda w: F.struct(w.alias("word"), F.concat(F.lit("T"), F.length(w).cast("string")).alias("tag"))).alias("tagged"))
    return shown(C.tagged_counts(tagged, 2))


@register("class_replaced_counts", f"""
WITH {Q.HELD_OUT}, r AS (SELECT list_transform(words, lambda x: CASE WHEN x IN ('the', 'a', 'la', 'das') THEN 'ART' WHEN x IN ('of', 'de', 'von') THEN 'PREP' ELSE x END) AS words FROM tsent), {Q.counts('c', 'r', 2)}
SELECT {SHOW} FROM c""")
def q_class_replaced(spark, d):
    classes = spark.createDataFrame([("ART", 0.25, [w]) for w in ("the", "a", "la", "das")] + [("PREP", 0.3, [w]) for w in ("of", "de", "von")], "class string, p double, expansion array<string>")
    return shown(C.count_ngrams(C.class_replaced(held_out(spark, d), classes, ["item_id", "sent_id"]), 2))


@register("factored_counts", f"""
WITH {Q.SENTENCES}, t AS (SELECT lang AS l, source AS s, unnest(words) AS w FROM sent)
SELECT CAST((CASE WHEN grouping(l) = 0 THEN 2 ELSE 0 END) + (CASE WHEN grouping(s) = 0 THEN 1 ELSE 0 END) AS INTEGER) AS node, l, s, w, count(*) AS cnt
FROM t GROUP BY GROUPING SETS ((l, s, w), (l, w), (s, w), (w))""")
def q_factored(spark, d):
    tokens = docs(spark, d).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.explode("words").alias("w"))
    return C.factored_counts(tokens, ["l", "s"], "w")


@register("oov_rate", f"""
{BOTH}, o AS (SELECT t.w, t.cnt, v.w IS NULL AS miss, NOT suffix(t.w, '-') AS whole FROM t LEFT JOIN (SELECT w FROM c WHERE ord = 1) v ON t.w = v.w WHERE t.ord = 1 AND t.w NOT IN ('<s>', '</s>'))
SELECT CAST(sum(cnt) AS BIGINT) AS tokens, count(*) AS types, CAST(coalesce(sum(cnt) FILTER (WHERE miss), 0) AS BIGINT) AS oov_tokens, count(*) FILTER (WHERE miss) AS oov_types,
  CAST(coalesce(sum(cnt) FILTER (WHERE miss AND whole), 0) AS BIGINT) AS oov_whole_tokens, count(*) FILTER (WHERE miss AND whole) AS oov_whole_types FROM o""")
def q_oov_rate(spark, d):
    return C.oov_rate(C.count_ngrams(held_out(spark, d), 1), counted(spark, d, 1).where("ord = 1").select("w"))
