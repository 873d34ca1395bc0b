"""Queries over hypothesis lists, networks, lattices and hidden-variable decoders.

Hypotheses are made from the held-out sentences by rule (drop, replace, append), so both engines build
the same rows without random numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.kernels import decode as K
from textloom.kernels.lattice import automaton_of_model
from textloom.operators import counts as C
from textloom.operators import decode as X
from textloom.operators import estimate as E
from textloom.operators import nbest as N
from textloom.operators import score as R
from textloom.plans import sql as Q
from textloom.plans.counting import docs, held_out
from textloom.plans.modelling import shown_probs, wb_model
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


def references(spark, d) -> DataFrame:
    return held_out(spark, d).select(F.concat_ws("_", "item_id", "sent_id").alias("utt"), "words")


def hypotheses(spark, d) -> DataFrame:
    refs = references(spark, d)
    n = F.size("words")
    variants = [
        F.col("words"),
        F.slice("words", 1, n - 1),
        F.concat(F.array(F.lit("uh")), F.slice("words", 2, n)),
        F.concat("words", F.array(F.lit("yeah"))),
    ]
    parts = [refs.select("utt", F.lit(k).alias("rank"), v.alias("words")) for k, v in enumerate(variants)]
    hyps = reduce(DataFrame.unionByName, parts)
    size = F.length(F.array_join("words", " "))
    return hyps.select(
        "utt", "rank", "words", (-((size * 7 + F.col("rank") * 13) % 100) / 10.0).alias("ascore"), (-(F.size("words") * 1.5 + F.col("rank") * 0.25)).alias("lscore"), F.size("words").alias("nwords")
    )


HYPS = f"""{Q.HELD_OUT}, refs AS (SELECT item_id || '_' || sent_id AS utt, words FROM tsent),
h0 AS (SELECT utt, 0 AS rank, words FROM refs UNION ALL SELECT utt, 1, list_slice(words, 1, len(words) - 1) FROM refs
  UNION ALL SELECT utt, 2, list_concat(['uh'], list_slice(words, 2, len(words))) FROM refs UNION ALL SELECT utt, 3, list_concat(words, ['yeah']) FROM refs),
h AS (SELECT utt, rank, words, -((length(array_to_string(words, ' ')) * 7 + rank * 13) % 100) / 10.0::DOUBLE AS ascore, -(len(words) * 1.5::DOUBLE + rank * 0.25::DOUBLE) AS lscore, len(words) AS nwords FROM h0),
ht AS (SELECT *, ascore + 0.5::DOUBLE * lscore - 0.1::DOUBLE * nwords AS total FROM h),
hp AS (SELECT *, pow(10.0, (total - max(total) OVER (PARTITION BY utt)) / 4) / sum(pow(10.0, (total - mx) / 4)) OVER (PARTITION BY utt) AS posterior FROM (SELECT *, max(total) OVER (PARTITION BY utt) AS mx FROM ht))"""


def weighted(spark, d) -> DataFrame:
    return N.with_posteriors(hypotheses(spark, d), 1.0, 0.5, -0.1, 4.0)


@register("nbest_reweight", f"WITH {HYPS} SELECT utt, rank, round(total, 6) AS total FROM ht")
def q_reweight(spark, d):
    return N.reweight(hypotheses(spark, d), 1.0, 0.5, -0.1).select("utt", "rank", F.round("total", 6).alias("total"))


@register("nbest_rank", f"WITH {HYPS} SELECT utt, rank, CAST(row_number() OVER (PARTITION BY utt ORDER BY round(total, 6) DESC, rank) AS INTEGER) AS new_rank FROM ht")
def q_rank(spark, d):
    h = N.reweight(hypotheses(spark, d), 1.0, 0.5, -0.1).withColumn("total", F.round("total", 6))
    return N.rerank(h).select("utt", "rank", "new_rank")


@register("nbest_posterior", f"WITH {HYPS} SELECT utt, rank, round(posterior, 6) AS posterior FROM hp")
def q_posterior(spark, d):
    return weighted(spark, d).select("utt", "rank", F.round("posterior", 6).alias("posterior"))


@register("nbest_acoustic_norm", f"WITH {HYPS} SELECT utt, rank, round(ascore - max(ascore) OVER (PARTITION BY utt), 6) AS ascore, max(ascore) OVER (PARTITION BY utt) AS top FROM h")
def q_norm(spark, d):
    return N.normalise_acoustic(hypotheses(spark, d)).select("utt", "rank", F.round("ascore", 6).alias("ascore"), F.col("offset").alias("top"))


@register("nbest_mix", f"""WITH {HYPS}, z AS (SELECT utt, rank, pow(10.0, (ascore - max(ascore) OVER (PARTITION BY utt)) / 2) AS e FROM h)
SELECT utt, rank, round(0.7::DOUBLE * posterior + 0.3::DOUBLE * e / sum(e) OVER (PARTITION BY utt), 6) AS posterior FROM hp JOIN z USING (utt, rank)""")
def q_mix(spark, d):
    a, b = weighted(spark, d), N.with_posteriors(hypotheses(spark, d), 1.0, 0.0, 0.0, 2.0)
    return N.mix_lists([a, b], [0.7, 0.3]).select("utt", "rank", F.round("posterior", 6).alias("posterior"))


@register("nbest_merge", f"""WITH {HYPS}, a AS (SELECT utt, array_to_string(words, ' ') AS words, round(total, 6) AS total FROM ht UNION ALL SELECT utt, array_to_string(words, ' '), round(ascore, 6) FROM h)
SELECT utt, words, max(total) AS total FROM a GROUP BY utt, words""")
def q_merge(spark, d):
    a = N.reweight(hypotheses(spark, d), 1.0, 0.5, -0.1).withColumn("total", F.round("total", 6))
    b = hypotheses(spark, d).withColumn("total", F.round("ascore", 6))
    return N.merge_lists([a, b]).select("utt", F.array_join("words", " ").alias("words"), "total")


@register("nbest_oov_counts", f"""WITH {Q.SENTENCES}, v AS (SELECT DISTINCT unnest(words) AS w FROM sent), {HYPS}, x AS (SELECT utt, rank, unnest(words) AS w FROM h),
o AS (SELECT x.utt, x.rank, count(*) FILTER (WHERE v.w IS NULL) AS oovs FROM x LEFT JOIN v USING (w) GROUP BY ALL) SELECT h.utt, h.rank, coalesce(oovs, 0) AS oovs FROM h LEFT JOIN o USING (utt, rank)""")
def q_oov(spark, d):
    return N.oov_counts(hypotheses(spark, d), docs(spark, d).select(F.explode("words").alias("w")))


@register("nbest_format", f"WITH {HYPS} SELECT utt, rank, CAST(ascore AS VARCHAR) || ' ' || CAST(lscore AS VARCHAR) || ' ' || nwords || ' ' || array_to_string(words, ' ') AS line FROM h WHERE len(words) > 0")
def q_format(spark, d):
    return N.format_lines(hypotheses(spark, d).where(F.size("words") > 0))


@register("nbest_roundtrip", f"WITH {HYPS} SELECT utt, rank, ascore, lscore, CAST(nwords AS INTEGER) AS nwords, array_to_string(words, ' ') AS words FROM h")
def q_roundtrip(spark, d):
    return N.parse_text_format(N.format_lines(hypotheses(spark, d))).select("utt", "rank", "ascore", "lscore", "nwords", F.array_join("words", " ").alias("words"))


@register("anti_ngrams", f"""WITH {HYPS}, {Q.grams('g', 'hp', 2, 'utt, rank, posterior')}, {Q.grams('r', 'refs', 2, 'utt')}, rr AS (SELECT DISTINCT utt, ord, ctx, w FROM r)
SELECT ord, {Q.gram()} AS ngram, round(sum(posterior), 6) AS cnt FROM g ANTI JOIN rr USING (utt, ord, ctx, w) GROUP BY ord, ctx, w""")
def q_anti(spark, d):
    out = C.expected_counts(weighted(spark, d), 2, references(spark, d))
    from textloom.functions.sequences import gram

    return out.select("ord", gram(F.col("ctx"), F.col("w")).alias("ngram"), F.round("cnt", 6).alias("cnt"))


MESH = """mx AS (SELECT utt, words, posterior, max(len(words)) OVER (PARTITION BY utt) AS longest FROM hp), mp AS (SELECT utt, words, posterior, unnest(range(1, longest + 1)) AS pos FROM mx),
mesh AS (SELECT utt, CAST(pos AS INTEGER) AS pos, words[pos] AS word, sum(posterior) AS post FROM mp GROUP BY ALL)"""


def simple_mesh(spark, d) -> DataFrame:
    """The lists as networks with a column per position; hypotheses that have ended count as deletions."""
    h = weighted(spark, d).withColumn("_m", F.max(F.size("words")).over(Window.partitionBy("utt")))
    at = h.where("_m > 0").select("utt", "words", "posterior", F.explode(F.sequence(F.lit(1), "_m")).alias("pos"))
    return at.groupBy("utt", "pos", F.get(F.col("words"), F.col("pos") - 1).alias("word")).agg(F.sum("posterior").alias("post"))


@register("consensus", f"""WITH {HYPS}, {MESH}, b AS (SELECT utt, pos, word FROM (SELECT *, row_number() OVER (PARTITION BY utt, pos ORDER BY round(post, 9) DESC, coalesce(word, '') DESC) AS r FROM mesh) WHERE r = 1)
SELECT utt, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS words FROM b GROUP BY utt""")
def q_consensus(spark, d):
    return N.consensus(simple_mesh(spark, d).withColumn("post", F.round("post", 9)))


@register("mesh_normalised", f"""WITH {HYPS}, {MESH} SELECT utt, pos, word, round(CASE WHEN word IS NULL THEN greatest(0, 1 - coalesce(sum(post) FILTER (WHERE word IS NOT NULL) OVER (PARTITION BY utt, pos), 0)) ELSE post END, 6) AS post FROM mesh""")
def q_mesh_norm(spark, d):
    return N.normalise_deletions(simple_mesh(spark, d)).select("utt", "pos", "word", F.round("post", 6).alias("post"))


@register("bleu_statistics", f"""WITH {HYPS}, {Q.counts('a', 'h', 4, 'utt, rank', boundaries=False)}, {Q.counts('b', 'refs', 4, 'utt', boundaries=False)}
SELECT a.utt, rank, a.ord, CAST(sum(least(a.cnt, coalesce(b.cnt, 0))) AS BIGINT) AS matches, CAST(sum(a.cnt) AS BIGINT) AS total FROM a LEFT JOIN b ON a.utt = b.utt AND a.ord = b.ord AND a.ctx = b.ctx AND a.w = b.w GROUP BY a.utt, rank, a.ord""")
def q_bleu(spark, d):
    return N.bleu_statistics(hypotheses(spark, d), references(spark, d)).select("utt", "rank", "ord", F.col("match").alias("matches"), "total")


@register("nbest_rescore", f"""WITH {Q.train_counts(2)},{Q.wb_bigram()}, {HYPS}, {Q.events('ev', 'h', 2, 'utt, rank')}, {Q.bigram_lookup('s', 'ev', 'm', 'utt, rank')}
SELECT utt, rank, round(sum(CASE WHEN p > 0 THEN log10(p) ELSE 0 END), 5) AS lscore FROM s GROUP BY utt, rank""")
def q_rescore(spark, d):
    ev = R.events_of(hypotheses(spark, d), 2, ["utt", "rank"])
    scored = R.lookup(ev, wb_model(spark, d, events=ev))
    return R.text_stats(scored, ["utt", "rank"]).select("utt", "rank", F.round("logprob", 5).alias("lscore"))


# ---- kernels (rows only; tests compare them with brute force) ----


def aligned(pairs: str, first: str, diagonal: str, up: str, left: str, cost: str) -> str:
    """CTEs ``dp`` and ``done``: the edit table of ``pairs`` (utt, rank, r, h) by anti-diagonals; each cell extends the best of its neighbours.

    ``first`` are the fields of the empty alignment; ``diagonal``, ``up`` and ``left`` those of a step to a cell ``i`` of diagonal ``d + 1``.
    """
    start = f"{{'c': 0.0::DOUBLE, 'o': 0, {first}}}"
    ways = ", ".join([
        f"CASE WHEN i > 0 AND d + 1 - i > 0 THEN {{'c': a[i].c + CASE WHEN r[i] = h[d + 1 - i] THEN 0 ELSE {cost} END, 'o': 0, {diagonal}}} END",
        f"CASE WHEN i > 0 THEN {{'c': b[i].c + 3, 'o': 1, {up}}} END", f"CASE WHEN d + 1 - i > 0 THEN {{'c': b[i + 1].c + 3, 'o': 2, {left}}} END",
    ])
    return f"""
dp AS (
  SELECT utt, rank, r, h, 0 AS d, list_transform(range(0, len(r) + 1), lambda i: NULL::STRUCT(c DOUBLE, o INTEGER, {{types}})) AS a,
    list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i = 0 THEN {start} END) AS b FROM {pairs}
  UNION ALL
  SELECT utt, rank, r, h, d + 1, b, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN d + 1 - i BETWEEN 0 AND len(h) THEN list_sort(list_filter([{ways}], lambda q: q.c IS NOT NULL))[1] END)
  FROM dp WHERE d < len(r) + len(h)),
done AS (SELECT utt, rank, b[len(r) + 1] AS e FROM dp WHERE d = len(r) + len(h))"""


COUNTED = aligned(
    "pairs", "'s': 0, 'd': 0, 'n': 0", "'s': a[i].s + CASE WHEN r[i] = h[d + 1 - i] THEN 0 ELSE 1 END, 'd': a[i].d, 'n': a[i].n",
    "'s': b[i].s, 'd': b[i].d + 1, 'n': b[i].n", "'s': b[i + 1].s, 'd': b[i + 1].d, 'n': b[i + 1].n + 1", "4",
).replace("{types}", "s INTEGER, d INTEGER, n INTEGER")


@register("word_errors", f"""WITH RECURSIVE {HYPS}, pairs AS (SELECT utt, rank, refs.words AS r, h.words AS h FROM h JOIN refs USING (utt)), {COUNTED}
SELECT utt, rank, CAST(e.s AS BIGINT) AS sub, CAST(e.d AS BIGINT) AS del, CAST(e.n AS BIGINT) AS ins FROM done""")
def q_errors(spark, d):
    return N.word_errors(hypotheses(spark, d), references(spark, d))


@register("oracle_wer", f"""WITH RECURSIVE {HYPS}, pairs AS (SELECT utt, rank, refs.words AS r, h.words AS h FROM h JOIN refs USING (utt) WHERE rank > 0), {COUNTED}
SELECT utt, CAST(min(e.s + e.d + e.n) AS BIGINT) AS errors FROM done GROUP BY utt""")
def q_oracle(spark, d):
    return N.oracle_errors(hypotheses(spark, d).where("rank > 0"), references(spark, d))


@register("tag_transfer")
def q_tags(spark, d):
    """References with a tag after every third word; their tags in each hypothesis."""
    refs = references(spark, d).select("utt", F.flatten(F.transform("words", lambda w, k: F.when((k + 1) % 3 == 0, F.array(w, F.concat(F.lit("<t"), ((k + 1) % 2).cast("string"), F.lit(">")))).otherwise(F.array(w)))).alias("words"))
    return N.tag_transfer(hypotheses(spark, d), refs).select("utt", "rank", F.array_join("words", " ").alias("tagged"))


@register("mbr")
def q_mbr(spark, d):
    return N.minimum_risk(weighted(spark, d))


@register("mesh_align")
def q_mesh(spark, d):
    return N.confusion_network(weighted(spark, d)).select("utt", "pos", "word", F.round("post", 6).alias("post"))


@register("mesh_consensus")
def q_mesh_consensus(spark, d):
    return N.consensus(N.confusion_network(weighted(spark, d)))


@register("mesh_errors")
def q_mesh_errors(spark, d):
    return N.network_errors(N.confusion_network(weighted(spark, d)), references(spark, d))


@register("rover")
def q_rover(spark, d):
    a, b = weighted(spark, d), N.with_posteriors(hypotheses(spark, d), 1.0, 0.0, 0.0, 2.0)
    return N.combine_systems([(a, 0.6), (b, 0.4)])


@register("weight_tuning")
def q_tuning(spark, d):
    h = hypotheses(spark, d).where("rank > 0")
    w, value = N.optimise_weights(h, N.word_errors(h, references(spark, d)), ["ascore", "lscore"], [1.0, 0.5], 4.0, rounds=6)
    return spark.createDataFrame([(round(w[0], 4), round(w[1], 4), round(value, 4))], "am double, lm double, errors double")


def lattices(spark, d):
    return X.lattices_of_lists(N.reweight(hypotheses(spark, d), 1.0, 0.5, -0.1))


@register("lattice_posteriors")
def q_lattice_posteriors(spark, d):
    return X.node_posteriors(*lattices(spark, d), scale=4.0)


@register("lattice_nbest")
def q_lattice_nbest(spark, d):
    return X.best_paths(*lattices(spark, d), n=3)


@register("lattice_ngrams")
def q_lattice_ngrams(spark, d):
    return X.expected_ngrams(*lattices(spark, d), 2, 4.0).select("ord", "ngram", F.round("cnt", 6).alias("cnt"))


@register("lattice_packed")
def q_lattice_packed(spark, d):
    return X.over_lattices(*lattices(spark, d), lambda lat: [(len(lat.words), len(lat.pack().useful().words))], "nodes int, packed int")


@register("lattice_mesh")
def q_lattice_mesh(spark, d):
    return X.over_lattices(*lattices(spark, d), lambda lat: [(" ".join(lat.to_mesh(4.0).consensus()[0]),)], "words string")


@register("lattice_measures")
def q_lattice_measures(spark, d):
    return X.over_lattices(*lattices(spark, d), lambda lat: [(len(lat.words), round(lat.entropy(4.0), 5), round(lat.max_min_posterior(4.0), 6))], "nodes int, entropy double, path double")


def held_out_model(spark, d) -> X.TableModel:
    sents = held_out(spark, d)
    return X.table_model(E.train(C.count_ngrams(sents, 2), 2, "wb"))


@register("lattice_decode")
def q_lattice_decode(spark, d):
    model = spark.sparkContext.broadcast(held_out_model(spark, d))
    return X.over_lattices(*lattices(spark, d), lambda lat: [(" ".join(w), round(s, 5)) for s, w in lat.decode(model.value)], "words string, score double")


@register("lattice_expand")
def q_lattice_expand(spark, d):
    model = spark.sparkContext.broadcast(held_out_model(spark, d))

    def kernel(lat):
        new = lat.expand(model.value)
        return [(len(new.words), " ".join(new.viterbi()[1]))]

    return X.over_lattices(*lattices(spark, d), kernel, "nodes int, words string")


@register("disambig")
def q_disambig(spark, d):
    """Lower-cased words back to their written forms: candidates are the forms seen, with their shares."""
    sents = held_out(spark, d)
    forms = sents.select(F.explode("words").alias("w")).groupBy(F.lower("w").alias("k"), "w").agg(F.count(F.lit(1)).alias("n")).collect()
    table_: dict[str, list] = {}
    for r in forms:
        table_.setdefault(r["k"], []).append((r["w"], float(r["n"])))
    shares = {k: sorted((w, n / sum(x for _, x in v)) for w, n in v) for k, v in table_.items()}
    return X.disambiguate(sents.select("item_id", "sent_id", F.transform("words", F.lower).alias("words")), ["item_id", "sent_id"], shares, held_out_model(spark, d))


@register("hidden_events")
def q_hidden(spark, d):
    """Sentence ends as events of running text."""
    lines = C.continuous_sentences(held_out(spark, d).select("item_id", "sent_id", F.concat("words", F.array(F.lit("<#s>"))).alias("words")), "item_id")
    model = X.table_model(E.train(C.count_ngrams(lines, 2), 2, "wb"))
    plain = lines.select("item_id", F.filter("words", lambda w: w != "<#s>").alias("words"))
    return X.hidden_events(plain, ["item_id"], ["<#s>"], model)


@register("segment")
def q_segment(spark, d):
    return X.segment(C.continuous_sentences(held_out(spark, d), "item_id"), ["item_id"], held_out_model(spark, d))


@register("class_trellis")
def q_class_trellis(spark, d):
    sents = held_out(spark, d)
    classes = {w: [("ART", 0.25, (w,))] for w in ("the", "a", "la", "die")} | {"of": [("OFTHE", 0.5, ("of", "the"))]}
    model = held_out_model(spark, d)
    model.probs[("ART",)] = -2.0
    model.probs[("OFTHE",)] = -3.0
    return X.class_scores(sents, ["item_id", "sent_id"], model, classes)


@register("disfluency_model")
def q_disfluency(spark, d):
    model = held_out_model(spark, d)
    for e, p in (("<DEL1>", -3.0), ("<DEL2>", -3.5), ("<REP1>", -2.5), ("<REP2>", -3.0), ("<SDEL>", -3.0)):
        model.probs[(e,)] = p
    return X.per_word(held_out(spark, d), ["item_id", "sent_id"], K.disfluency_probs, model)


@register("hmm_of_ngrams")
def q_hmm(spark, d):
    m = held_out_model(spark, d)
    moves = {"A": {"A": 0.8, "B": 0.2}, "B": {"A": 0.3, "B": 0.7}}
    return X.per_word(held_out(spark, d), ["item_id", "sent_id"], lambda w, s: K.hmm_probs(w, s[0], s[1], "A"), ({"A": m, "B": m}, moves))


@register("adaptive_mixture")
def q_adaptive(spark, d):
    sents = held_out(spark, d)
    half = [X.table_model(E.train(C.count_ngrams(sents.where(f"item_id % 2 = {k}"), 2), 2, "wb")) for k in (0, 1)]
    return X.per_word(sents, ["item_id", "sent_id"], lambda w, ms: K.adaptive_mixture(w, ms, [0.5, 0.5]), half)


@register("generate")
def q_generate(spark, d):
    from textloom.operators.generate import sample_sentences

    return sample_sentences(spark, held_out_model(spark, d), 200, seed=7)


@register("model_automaton")
def q_automaton(spark, d):
    m = E.train(C.count_ngrams(held_out(spark, d), 2), 2, "wb").persist()
    probs = [(r["ctx"], r["w"], r["logp"]) for r in m.probs.collect()]
    _, edges = automaton_of_model(probs, [(r["ctx"], r["bow"]) for r in m.bows.collect()])
    return spark.createDataFrame([(a, b, round(w, 6)) for a, b, w in edges], "src int, dst int, weight double")


@register("arpa_roundtrip")
def q_arpa(spark, d):
    from textloom.sources import arpa

    m = E.train(C.count_ngrams(held_out(spark, d), 2), 2, "wb")
    return shown_probs(arpa.parse(spark, arpa.lines(m)), None, 4)


@register("nbest_from_conversations")
def q_turns(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("utt"), F.col("turn").cast("int").alias("rank"), F.split(F.coalesce("text", F.lit("")), r"\s+").alias("words"))
    return N.minimum_risk(cut(turns.select("utt", "rank", "words", F.lit(0.25).alias("posterior"))))
