"""N-best list analytics: columns where SQL suffices, one kernel per utterance where alignment is needed.

Hypotheses: ``utt``, ``rank``, ``words`` array<string>, ``ascore``, ``lscore``, ``nwords``. Utterances are
independent and small, so a kernel's group is one utterance.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.alignment import alignment, step_count, transferred_tags
from textloom.kernels import align as A


def reweight(hyps: DataFrame, am: float = 1.0, lm: float = 1.0, wt: float = 0.0) -> DataFrame:
    """``total`` = am * acoustic + lm * language + wt * words."""
    return hyps.withColumn("total", am * F.col("ascore") + lm * F.col("lscore") + wt * F.col("nwords"))


def rerank(hyps: DataFrame, by: Sequence[Column] | None = None) -> DataFrame:
    """Add ``new_rank`` from 1 by total, ties by the old rank."""
    order = by or [F.col("total").desc(), F.col("rank")]
    return hyps.withColumn("new_rank", F.row_number().over(Window.partitionBy("utt").orderBy(*order)))


def with_posteriors(hyps: DataFrame, am: float = 1.0, lm: float = 1.0, wt: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Add ``posterior``: softmax of the scaled total; the stored total where all weights are zero."""
    scored = hyps if am == lm == wt == 0 else reweight(hyps, am, lm, wt)
    same = Window.partitionBy("utt")
    p = F.pow(F.lit(10.0), (F.col("total") - F.max("total").over(same)) / scale)
    return scored.withColumn("_p", p).withColumn("posterior", F.col("_p") / F.sum("_p").over(same)).drop("_p")


def normalise_acoustic(hyps: DataFrame) -> DataFrame:
    """Acoustic scores relative to the best of the utterance, which ``offset`` keeps."""
    top = F.max("ascore").over(Window.partitionBy("utt"))
    return hyps.withColumn("offset", top).withColumn("ascore", F.col("ascore") - F.col("offset"))


def denormalise_acoustic(hyps: DataFrame) -> DataFrame:
    return hyps.withColumn("ascore", F.col("ascore") + F.col("offset")).drop("offset")


def undo_language_score(hyps: DataFrame, scores: DataFrame, lm: float, wt: float) -> DataFrame:
    """Acoustic scores without the recogniser's language and word weights; ``scores`` has (utt, rank, logprob)."""
    joined = hyps.join(scores, ["utt", "rank"], "left")
    return joined.withColumn("ascore", F.col("ascore") - lm * F.coalesce("logprob", F.lit(0.0)) - wt * F.col("nwords")).drop("logprob")


def mix_lists(lists: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    """Weighted sum of the posteriors of aligned lists."""
    parts = [x.select("utt", "rank", "words", (F.col("posterior") * w).alias("_p")) for x, w in zip(lists, weights, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("utt", "rank").agg(F.first("words").alias("words"), F.sum("_p").alias("posterior"))


def merge_lists(lists: Sequence[DataFrame], best: bool = True) -> DataFrame:
    """One list without repeated word strings: the best total of each (or the log sum)."""
    every = reduce(DataFrame.unionByName, [x.select("utt", "words", "total") for x in lists])
    top = F.max("total")
    score = top if best else top + F.log10(F.sum(F.pow(F.lit(10.0), "total")) / F.pow(F.lit(10.0), top))
    merged = every.groupBy("utt", "words").agg(score.alias("total"))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("utt").orderBy(F.col("total").desc(), F.array_join("words", " "))))


def oov_counts(hyps: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unknown words of each hypothesis."""
    known = vocabulary.select(F.col("w").alias("_v")).distinct()
    rows = hyps.select("utt", "rank", F.explode_outer("words").alias("_w")).join(known, F.col("_w") == F.col("_v"), "left")
    return rows.groupBy("utt", "rank").agg(F.count_if(F.col("_w").isNotNull() & F.col("_v").isNull()).alias("oovs"))


def pause_and_pronunciation(hyps: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sum of log pronunciation probabilities; ``winfo`` has word and phones, the dictionary word, pron and p."""
    rows = hyps.select("utt", "rank", F.explode("winfo").alias("x")).select("utt", "rank", F.col("x.word").alias("word"), F.col("x.phones").alias("pron"))
    joined = rows.join(dictionary.select("word", F.array_join("pron", " ").alias("pron"), "p"), ["word", "pron"], "left")
    return joined.groupBy("utt", "rank").agg(F.sum(F.coalesce(F.log10("p"), F.lit(0.0))).alias("pronscore"))


def parse_text_format(lines: DataFrame, line: str = "line") -> DataFrame:
    """Three-column log10 lists: ``ascore lscore nwords word ...`` per line."""
    t = F.filter(F.split(F.col(line), r"\s+"), lambda w: w != "")
    keep = [c for c in lines.columns if c != line]
    return lines.where(F.size(t) >= 3).select(*keep, t[0].cast("double").alias("ascore"), t[1].cast("double").alias("lscore"), t[2].cast("int").alias("nwords"), F.slice(t, 4, F.size(t)).alias("words"))


def parse_bytelog_format(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lists of a score in byte logs in parentheses before the words."""
    from textloom.functions.sequences import from_bytelog, words_of

    keep = [c for c in lines.columns if c != line]
    score = F.regexp_extract(F.col(line), r"^\s*\(\s*(-?[0-9.]+)\s*\)", 1)
    rest = words_of(F.regexp_replace(F.col(line), r"^\s*\([^)]*\)", ""))
    return lines.where(score != "").select(*keep, from_bytelog(score.cast("double")).alias("total"), rest.alias("words"))


def parse_named_scores(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines ``id ||| words ||| name=value ... ``: scores become a map."""
    parts = F.split(F.col(line), r"\s*\|\|\|\s*")
    return lines.select(parts[0].alias("utt"), F.filter(F.split(parts[1], r"\s+"), lambda w: w != "").alias("words"), F.transform_values(F.str_to_map(parts[2], F.lit(" "), F.lit("=")), lambda k, v: v.cast("double")).alias("scores"))


def read_list_set(spark: SparkSession, path: str) -> DataFrame:
    """``utt``, ``rank``, ``line`` of a folder of lists, one file an utterance, named for it; ranks are the order in the file.

    A file is one row of the scan (a list is bounded by its length n), so its lines keep their order; which parser the
    lines need is the caller's choice.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z0-9]+)?(\.gz|\.bz2)?$", 1).alias("utt"), "value")
    lines = files.select(F.url_decode(F.replace("utt", F.lit("+"), F.lit("%2B"))).alias("utt"), F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("rank", "line"))
    return lines


def format_lines(hyps: DataFrame) -> DataFrame:
    return hyps.select("utt", "rank", F.concat_ws(" ", F.col("ascore").cast("string"), F.col("lscore").cast("string"), F.col("nwords").cast("string"), F.array_join("words", " ")).alias("line"))


def format_ctm(timed: DataFrame) -> DataFrame:
    """Time-marked lines of (utt, channel, start, dur, word, confidence)."""
    return timed.select("utt", F.format_string("%s %s %.2f %.2f %s %.6f", "utt", "channel", "start", "dur", "word", "confidence").alias("line"))


# ---- kernels ----


def spread(pairs: DataFrame) -> DataFrame:
    """Hypotheses over all tasks: few bytes each, but much work, so their size says nothing about how many a task should have."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "utt", "rank")


def word_errors(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Substitutions, deletions and insertions of each hypothesis."""
    joined = hyps.select("utt", "rank", "words").join(refs.select("utt", F.col("words").alias("ref")), "utt")
    steps = spread(joined).withColumn("_s", alignment(F.col("ref"), F.col("words")))
    return steps.select("utt", "rank", *[step_count(F.col("_s"), k).alias(k) for k in ("sub", "del", "ins")])


def tag_transfer(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Each hypothesis with the tags (``<...>``) of its reference put where the words they follow are."""
    joined = hyps.join(refs.select("utt", F.col("words").alias("_ref")), "utt")
    return spread(joined).withColumn("words", transferred_tags(F.col("_ref"), F.col("words"))).drop("_ref")


def oracle_errors(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Errors of the best hypothesis; utterances without hypotheses lose all their words."""
    e = word_errors(hyps, refs).groupBy("utt").agg(F.min(F.col("sub") + F.col("del") + F.col("ins")).alias("_e"))
    return refs.join(e, "utt", "left").select("utt", F.coalesce("_e", F.size("words")).cast("long").alias("errors"))


def per_utterance(hyps: DataFrame, function, schema: str, columns: Sequence[str] = ("rank", "words", "posterior")) -> DataFrame:
    """Run a kernel on each utterance's hypotheses, in rank order."""
    listed = hyps.groupBy("utt").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("h"))

    def run(batches):
        for batch in batches:
            rows = [(u, *r) for u, h in zip(batch["utt"], batch["h"], strict=True) for r in function(list(h))]
            yield pd.DataFrame(rows, columns=["utt", *[f.split()[0] for f in schema.split(", ")]])

    key = dict(hyps.dtypes)["utt"]
    return listed.mapInPandas(run, f"utt {key}, {schema}")


def minimum_risk(hyps: DataFrame) -> DataFrame:
    """The hypothesis with the least expected errors."""

    def best(h):
        i, risk = A.minimum_risk([list(x["words"]) for x in h], [x["posterior"] for x in h])
        return [(int(h[i]["rank"]), " ".join(h[i]["words"]), round(float(risk), 6))]

    return per_utterance(hyps, best, "rank int, words string, risk double")


def confusion_network(hyps: DataFrame) -> DataFrame:
    """``pos``, ``word`` (null: deletion), ``post`` of the network of each list."""

    def build(h):
        mesh = A.Mesh()
        for x in h:
            mesh.add(list(x["words"]), float(x["posterior"]))
        return [(k, w, p) for k, column in enumerate(mesh.columns) for w, p in column.items()]

    return per_utterance(hyps, build, "pos int, word string, post double")


def consensus(mesh: DataFrame, delete_bias: float = 1.0) -> DataFrame:
    """The most probable word of each column, ties by word, deletions left out."""
    weight = F.when(F.col("word").isNull(), F.col("post") * delete_bias).otherwise(F.col("post"))
    best = mesh.groupBy("utt", "pos").agg(F.max_by("word", F.struct(weight, F.coalesce("word", F.lit("")))).alias("word"))
    listed = best.groupBy("utt").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("_l"))
    return listed.select("utt", F.array_join(F.filter(F.transform("_l", lambda x: x["word"]), lambda w: w.isNotNull()), " ").alias("words"))


def normalise_deletions(mesh: DataFrame) -> DataFrame:
    """Deletion posteriors that make each column sum to the column's total."""
    column = Window.partitionBy("utt", "pos")
    others = F.sum(F.when(F.col("word").isNotNull(), F.col("post")).otherwise(0.0)).over(column)
    return mesh.withColumn("post", F.when(F.col("word").isNull(), F.greatest(F.lit(0.0), 1 - others)).otherwise(F.col("post")))


def network_errors(mesh: DataFrame, refs: DataFrame) -> DataFrame:
    """The least word errors of any path of each network."""
    listed = mesh.groupBy("utt").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "post"))).alias("h")).join(refs.select("utt", F.col("words").alias("ref")), "utt")

    @F.pandas_udf("long")
    def error(h: pd.Series, ref: pd.Series) -> pd.Series:
        out = []
        for rows, r in zip(h, ref, strict=True):
            columns: dict[int, dict] = {}
            for x in rows:
                columns.setdefault(x["pos"], {})[x["word"]] = x["post"]
            out.append(A.Mesh([columns[k] for k in sorted(columns)], 1.0).error(list(r)))
        return pd.Series(out)

    return listed.select("utt", error("h", "ref").alias("errors"))


def combine_systems(systems: Sequence[tuple[DataFrame, float]], delete_bias: float = 1.0) -> DataFrame:
    """Several systems' lists in one network each utterance; weights scale their posteriors."""
    parts = [h.select("utt", "rank", "words", (F.col("posterior") * w).alias("posterior"), F.lit(k).alias("system")) for k, (h, w) in enumerate(systems)]
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("utt").orderBy(F.col("posterior").desc(), "system", "rank")
    every = every.withColumn("rank", F.row_number().over(order))
    return consensus(confusion_network(every), delete_bias)


def bleu_statistics(hyps: DataFrame, refs: DataFrame, order: int = 4) -> DataFrame:
    """Clipped n-gram matches and totals per hypothesis and order, and lengths."""
    from textloom.operators.counts import count_ngrams

    h = count_ngrams(hyps, order, by=["utt", "rank"], boundaries=False)
    r = count_ngrams(refs, order, by=["utt"], boundaries=False).withColumnRenamed("cnt", "_r")
    joined = h.join(r, ["utt", "ord", "ctx", "w"], "left")
    return joined.groupBy("utt", "rank", "ord").agg(F.sum(F.least("cnt", F.coalesce("_r", F.lit(0)))).alias("match"), F.sum("cnt").alias("total"))


def bleu(stats: DataFrame, hyp_length: int, ref_length: int, order: int = 4) -> float:
    import math

    rows = {r["ord"]: (r["m"], r["t"]) for r in stats.groupBy("ord").agg(F.sum("match").alias("m"), F.sum("total").alias("t")).collect()}
    if not hyp_length or any(not rows.get(n, (0, 0))[0] for n in range(1, order + 1)):
        return 0.0
    precision = sum(math.log(rows[n][0] / rows[n][1]) for n in range(1, order + 1)) / order
    return math.exp(precision + min(0.0, 1 - ref_length / hyp_length))


def optimise_weights(hyps: DataFrame, errors: DataFrame, scores: Sequence[str], start: Sequence[float], scale: float = 1.0, rounds: int = 40) -> tuple[list[float], float]:
    """Score weights with the least expected errors: Nelder-Mead on the driver over one distributed aggregate per step."""
    from textloom.plans.session import cut

    rows = cut(hyps.join(errors, ["utt", "rank"]).select("utt", "rank", *scores, (F.col("sub") + F.col("del") + F.col("ins")).alias("_e")))

    def objective(weights: Sequence[float]) -> float:
        total = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(s) for w, s in zip(weights, scores, strict=True)])
        same = Window.partitionBy("utt")
        p = F.pow(F.lit(10.0), (total - F.max(total).over(same)) / scale)
        return rows.withColumn("_p", p).groupBy("utt").agg((F.sum(F.col("_p") * F.col("_e")) / F.sum("_p")).alias("x")).agg(F.sum("x")).first()[0]

    return nelder_mead(objective, list(start), rounds)


def nelder_mead(objective, start: list[float], rounds: int = 100, size: float = 0.5, tolerance: float = 1e-6) -> tuple[list[float], float]:
    """Simplex search; deterministic."""
    n = len(start)
    points = [list(start)] + [[x + (size if i == k else 0.0) for i, x in enumerate(start)] for k in range(n)]
    simplex = sorted((objective(p), p) for p in points)
    for _ in range(rounds):
        if abs(simplex[-1][0] - simplex[0][0]) <= tolerance:
            break
        centre = [sum(p[i] for _, p in simplex[:-1]) / n for i in range(n)]
        at = lambda k: [c + k * (w - c) for c, w in zip(centre, simplex[-1][1], strict=True)]
        reflected = at(-1.0)
        value = objective(reflected)
        if value < simplex[0][0]:
            further = at(-2.0)
            v2 = objective(further)
            simplex[-1] = min((value, reflected), (v2, further))
        elif value < simplex[-2][0]:
            simplex[-1] = (value, reflected)
        else:
            inner = at(0.5)
            v2 = objective(inner)
            if v2 < simplex[-1][0]:
                simplex[-1] = (v2, inner)
            else:
                best = simplex[0][1]
                simplex = [simplex[0]] + [(objective(q), q) for q in ([b + 0.5 * (x - b) for b, x in zip(best, p, strict=True)] for _, p in simplex[1:])]
        simplex.sort()
    return simplex[0][1], simplex[0][0]
