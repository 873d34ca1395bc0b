"""Transformations of whole models, vocabulary selection and text rewriting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import but_last, gram, last_word, shorter, split_multiwords, to_log
from textloom.operators import em
from textloom.operators.estimate import renormalise, renormalised
from textloom.operators.score import ZERO, Model, lookup, met
from textloom.plans.session import cut
from textloom.schema import BOS, EOS


def rescored(model: Model, other: Model) -> Model:
    """The n-grams of a model with the probabilities of another, weights recomputed."""
    words = model.probs.where(F.col("ord") == 1).select("ctx", "w")
    levels = {1: cut(lookup(words, other.upto(1), every=True).select("ctx", "w", "logp"))}
    for n in range(2, model.order + 1):
        rows = met([model, other], n).where("has0")
        # the other's words alone are those of the shorter context for bigrams only
        levels[n] = rows.select("ctx", "w", F.col("own1").alias("logp"), F.col("low1").alias("lowlog")) if n == 2 else cut(rows.select("ctx", "w", F.col("own1").alias("logp")))
    return renormalised(levels)


def sub_model(model: Model, order: int) -> Model:
    """The lower orders of a model."""
    return Model(order, model.probs.where(F.col("ord") <= order), model.bows.where(F.col("len") < order))


def unigrams(model: Model, linear: bool = True) -> DataFrame:
    rows = model.probs.where((F.col("ord") == 1) & (F.col("logp") > ZERO))
    return rows.select("w", (F.pow(F.lit(10.0), F.col("logp")) if linear else F.col("logp")).alias("p"))


def change_vocabulary(model: Model, vocabulary: DataFrame) -> Model:
    """Only n-grams over the vocabulary; words it adds share the unigram mass of those it drops; weights recomputed."""
    known = vocabulary.select("w").union(vocabulary.sparkSession.createDataFrame([(BOS,), (EOS,)], "w string")).distinct()
    rows = model.probs.join(known, "w", "left_semi").select("ord", "ctx", "w", "logp")
    for k in range(model.order - 1):
        word = F.get(F.split("ctx", " "), k)
        rows = rows.where((F.col("ctx") == "") | word.isNull()).unionByName(rows.where((F.col("ctx") != "") & word.isNotNull()).join(known.withColumnRenamed("w", "_v"), word == F.col("_v"), "left_semi"))
    one = rows.where("ord = 1")
    new = known.join(one.select("w"), "w", "left_anti")
    mass, extra = one.where(F.col("logp") > ZERO).agg(F.sum(F.pow(F.lit(10.0), "logp"))).first()[0] or 0.0, new.count()
    added = new.select(F.lit(1).alias("ord"), F.lit("").alias("ctx"), "w", to_log(F.lit(max(0.0, 1 - mass) / max(1, extra))).alias("logp"))
    return renormalise(Model(model.order, cut(rows.unionByName(added)), model.bows))


def with_dummy_weights(model: Model) -> Model:
    """A zero back-off weight for every n-gram below the top order that has none."""
    have = model.bows.select("len", "ctx")
    need = model.probs.where(F.col("ord") < model.order).select(F.col("ord").alias("len"), gram(F.col("ctx"), F.col("w")).alias("ctx"))
    return Model(model.order, model.probs, model.bows.unionByName(need.join(have, ["len", "ctx"], "left_anti").withColumn("bow", F.lit(0.0))))


def with_least_backoff(model: Model, mass: float) -> Model:
    """Contexts that leave less than ``mass`` to back-off are scaled down to leave that."""
    sums = model.probs.where(F.col("ord") > 1).groupBy("ord", "ctx").agg(F.sum(F.pow(F.lit(10.0), "logp")).alias("_s"))
    shift = F.when(mass - (1 - F.col("_s")) > 3e-6, F.log10(F.lit(1 - mass)) - F.log10("_s")).otherwise(0.0)
    high = model.probs.where(F.col("ord") > 1).join(sums, ["ord", "ctx"]).select("ord", "ctx", "w", (F.col("logp") + shift).alias("logp"))
    return renormalise(Model(model.order, cut(model.probs.where(F.col("ord") == 1).unionByName(high)), model.bows))


def multiword_model(model: Model, multiwords: DataFrame, separator: str = "_") -> DataFrame:
    """Unigram and bigram probabilities of multiwords (column ``w``) as the chain product of their parts, after each context of the model."""
    parts = multiwords.select("w", split_multiwords(F.array("w"), separator).alias("parts")).where(F.size("parts") > 1)
    contexts = model.bows.where("len = 1").select("ctx").unionByName(model.bows.sparkSession.createDataFrame([("",)], "ctx string"))
    # one row per multiword, context that can precede its first part, and part
    first = model.probs.where((F.col("ord") == 2)).select("ctx", F.col("w").alias("_first")).unionByName(parts.select(F.lit("").alias("ctx"), F.col("parts")[0].alias("_first")).distinct())
    pairs = parts.join(first, F.col("parts")[0] == F.col("_first")).join(contexts, "ctx", "left_semi")
    steps = pairs.select("w", F.col("ctx").alias("_c"), F.posexplode("parts").alias("_k", "_p"), "parts")
    steps = steps.select(F.col("w").alias("_m"), "_c", F.when(F.col("_k") == 0, F.col("_c")).otherwise(F.get("parts", F.col("_k") - 1)).alias("ctx"), F.col("_p").alias("w"))
    return lookup(steps, model).groupBy(F.col("_c").alias("ctx"), F.col("_m").alias("w")).agg(F.sum("logp").alias("logp"))


def multiword_scores(events: DataFrame, model: Model, keys: Sequence[str], separator: str = "_") -> DataFrame:
    """Sum of the log probabilities of a sequence with its multiwords split."""
    from textloom.operators.score import events_of, text_stats

    split = events.select(*keys, split_multiwords(F.col("words"), separator).alias("words"))
    return text_stats(lookup(events_of(split, model.order, keys), model), keys)


def context_logprob(grams: DataFrame, model: Model) -> DataFrame:
    """Add ``joint``, the base-10 log probability of a sequence ``g`` (words joined by blanks); a start symbol counts as an end symbol."""
    words = F.split("g", " ")
    rows = grams.select("g").distinct().select("g", words.alias("ws"), F.explode(F.sequence(F.lit(1), F.size(words))).alias("j"))
    start = (F.col("j") == 1) & (F.col("ws")[0] == BOS)
    near = F.greatest(F.lit(1), F.col("j") - (model.order - 1)) if model.order > 1 else F.col("j")
    ctx = F.array_join(F.slice("ws", near, F.col("j") - near), " ")
    events = rows.select("g", F.when(start, "").otherwise(ctx).alias("ctx"), F.when(start, EOS).otherwise(F.get("ws", F.col("j") - 1)).alias("w"))
    return lookup(events, model).groupBy("g").agg(F.sum("logp").alias("joint"))


def expand_classes(model: Model, classes: DataFrame, order: int = 0) -> Model:
    """A class model of any order over words: what the joint probabilities of expanded n-grams give as conditionals.

    ``classes`` (``class``, ``expansion``, ``p``) may have expansions of several words. Every n-gram of the model is expanded
    in all ways; its joint probability goes to every window that begins inside its first token's expansion and ends
    inside its last one's, and is added up per window. A window that the model itself does not hold as an n-gram adds its
    plain probability. An n-gram's conditional is its joint probability over that of its context (or over the sum of the
    context's n-grams if that is larger, as for the empty one); weights are computed anew. ``order`` 0 keeps the longest window.
    """
    held = model.probs.where(F.col("logp") > ZERO).select(gram(F.col("ctx"), F.col("w")).alias("_gram"), F.col("ctx").alias("g"), "logp")
    held = held.join(context_logprob(held.where("g <> ''"), model), "g", "left").select("_gram", (F.col("logp") + F.coalesce("joint", F.lit(0.0))).alias("joint"))
    rows = cut(held).select("joint", F.split("_gram", " ").alias("toks"), F.array().cast("array<string>").alias("ws"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    ways = classes.select(F.col("class").alias("_c"), F.col("expansion").alias("_e"), F.log10("p").alias("_q"))
    for k in range(model.order):
        token = F.get("toks", F.lit(k))
        size = F.size("_e")
        done = rows.where(F.size("toks") <= k)
        met = rows.where(F.size("toks") > k).join(ways, token == F.col("_c"), "left").withColumn("_e", F.coalesce("_e", F.array(token)))
        met = met.select((F.col("joint") + F.coalesce("_q", F.lit(0.0))).alias("joint"), "toks", F.concat("ws", "_e").alias("ws"), (size if k == 0 else F.col("first")).alias("first"), size.alias("last"))
        rows = met.unionByName(done)
    trims = F.flatten(F.transform(F.sequence(F.lit(0), F.col("first") - 1), lambda a: F.transform(F.sequence(F.lit(0), F.col("last") - 1), lambda z: F.struct(a.alias("a"), z.alias("z")))))
    windows = F.filter(F.transform(trims, lambda t: F.slice("ws", t["a"] + 1, F.greatest(F.size("ws") - t["a"] - t["z"], F.lit(0)))), lambda x: F.size(x) > 0)
    sums = cut(rows.select(F.pow(F.lit(10.0), "joint").alias("p"), F.explode(windows).alias("x")).groupBy(F.array_join("x", " ").alias("g"), F.size("x").alias("ord")).agg(F.sum("p").alias("p")))
    longest = sums.agg(F.max("ord")).first()[0] or 1
    order = min(order or longest, longest)
    sums = sums.where(F.col("ord") <= order)
    plain = sums.join(model.probs.select(gram(F.col("ctx"), F.col("w")).alias("g")), "g", "left_anti")
    plain = plain.join(context_logprob(plain, model), "g").select("g", F.pow(F.lit(10.0), "joint").alias("_plain"))
    joint = cut(sums.join(plain, "g", "left").select("g", "ord", (F.col("p") + F.coalesce("_plain", F.lit(0.0))).alias("p")))
    end = lookup(model.probs.sparkSession.createDataFrame([("", EOS)], "ctx string, w string"), model).select(F.lit(BOS).alias("ctx"), F.pow(F.lit(10.0), "logp").alias("_of"))
    of = joint.where(F.col("g") != BOS).select(F.col("g").alias("ctx"), F.col("p").alias("_of")).unionByName(end)
    split = joint.where(F.col("g") != BOS).select("ord", but_last(F.col("g")).alias("ctx"), last_word(F.col("g")).alias("w"), "p")
    whole = split.groupBy("ctx").agg(F.sum("p").alias("_sum")).join(of, "ctx", "left").select("ctx", F.greatest("_sum", F.coalesce("_of", F.lit(0.0))).alias("_whole"))
    probs = split.join(whole, "ctx").select("ord", "ctx", "w", to_log(F.col("p") / F.col("_whole")).alias("logp"))
    start = model.probs.where((F.col("ord") == 1) & (F.col("w") == BOS)).select("ord", "ctx", "w", "logp")
    return renormalise(Model(order, cut(probs.unionByName(start)), model.bows))


def uniform_classes(classes: DataFrame) -> DataFrame:
    """Every expansion of a class alike likely."""
    return classes.withColumn("p", 1 / F.count(F.lit(1)).over(Window.partitionBy("class")))


def with_empty_sentence(model: Model, p: float) -> Model:
    """A model that gives the empty sentence the probability p: other words after the start are scaled."""
    top = model.probs.where((F.col("ord") == 2) & (F.col("ctx") == BOS))
    scale = F.log10(F.lit(1 - p))
    rest = model.probs.join(top.select("ord", "ctx", "w"), ["ord", "ctx", "w"], "left_anti").select("ord", "ctx", "w", "logp")
    own = top.where(F.col("w") != EOS).withColumn("logp", F.col("logp") + scale).select("ord", "ctx", "w", "logp")
    end = model.probs.sparkSession.createDataFrame([(2, BOS, EOS)], "ord int, ctx string, w string").withColumn("logp", F.log10(F.lit(p)))
    return renormalise(Model(model.order, cut(rest.unionByName(own).unionByName(end)), model.bows))


def subset(model: Model, events: DataFrame) -> Model:
    """Only the n-grams that scoring the events could use."""
    ctx = events.select(F.col("ctx").alias("g")).unionByName(events.select(shorter(F.col("ctx")).alias("g"))).unionByName(events.select(F.lit("").alias("g"))).distinct()
    words = events.select("w").distinct()
    probs = model.probs.join(words, "w", "left_semi").join(ctx.withColumnRenamed("g", "ctx"), "ctx", "left_semi").select("ord", "ctx", "w", "logp")
    return Model(model.order, probs, model.bows.join(ctx.withColumnRenamed("g", "ctx"), "ctx", "left_semi").select("len", "ctx", "bow"))


def add_statistics(parts: Sequence[DataFrame], signs: Sequence[int]) -> DataFrame:
    """Sum (or difference) of text statistics."""
    names = ["sentences", "words", "oovs", "zeroprobs", "logprob"]
    rows = reduce(DataFrame.unionByName, [p.select(*[(F.col(c) * s).alias(c) for c in names]) for p, s in zip(parts, signs, strict=True)])
    return rows.agg(*[F.sum(c).alias(c) for c in names])


def select_vocabulary(corpora: dict[str, DataFrame], held_out: DataFrame, scale: float = 1e6) -> tuple[DataFrame, dict[str, float]]:
    """Union vocabulary with counts mixed by the corpora's EM weights on held-out counts; each corpus is a Witten-Bell unigram model."""
    names = sorted(corpora)
    words = reduce(DataFrame.unionByName, [corpora[n].select("w") for n in names]).distinct()
    out = words
    for k, n in enumerate(names):
        total, types = corpora[n].agg(F.sum("cnt"), F.count(F.lit(1))).first()
        size = words.count()
        left = types / (total + types) / max(1, size - types) if size > types else 0.0
        p = corpora[n].select("w", (F.col("cnt") / F.lit(float(total + types))).alias(f"p{k}"))
        out = out.join(p, "w", "left").withColumn(f"p{k}", F.coalesce(f"p{k}", F.lit(float(left))))
    out = cut(out)
    cols = [f"p{k}" for k in range(len(names))]
    lam = em.best_mix(out.join(held_out.select("w", F.col("cnt").alias("n")), "w"), cols, precision=1e-5, max_rounds=100, weight="n")
    mixed = sum((F.lit(x) * F.col(c) for x, c in list(zip(lam, cols, strict=True))[1:]), F.lit(lam[0]) * F.col(cols[0]))
    return out.select("w", (mixed * scale).alias("weight")), dict(zip(names, lam, strict=True))


def rank_vocabulary(sources: dict[str, DataFrame], target: DataFrame, steps: int = 5) -> list[tuple[str, int]]:
    """Greedy choice of the source whose words remove most unknown tokens of the target per type added; ties by name."""
    left, chosen, have = cut(target.select("w", "cnt")), [], None
    names = sorted(sources)
    for _ in range(min(steps, len(names))):
        best = None
        for n in names:
            new = sources[n].select("w").distinct()
            new = new if have is None else new.join(have, "w", "left_anti")
            types = new.count()
            gain = left.join(new, "w", "left_semi").agg(F.sum("cnt")).first()[0] or 0
            if types and (best is None or gain / types > best[0]):
                best = (gain / types, n, gain)
        if best is None:
            break
        _, n, gain = best
        chosen.append((n, int(gain)))
        words = sources[n].select("w").distinct()
        have = words if have is None else have.union(words).distinct()
        left = cut(left.join(words, "w", "left_anti"))
        names.remove(n)
    return chosen


#: Verbalised punctuation and what it stands for.
#: Fixed values of the interchange format: verbalised marks that are spoken, and those that are not.
SPOKEN = {"@AT-SIGN": "at", "&AMPERSAND": "and", "+PLUS": "plus", "=EQUALS": "equals", "%PERCENT": "percent", "/SLASH": "slash", ".POINT": "point"}
SILENT = [",COMMA", "?QUESTION-MARK", ":COLON", "#SHARP-SIGN", "'SINGLE-QUOTE", ";SEMI-COLON", "!EXCLAMATION-POINT", "{LEFT-BRACE", "}RIGHT-BRACE", "(LEFT-PAREN", ")RIGHT-PAREN", ".PERIOD", "...ELLIPSIS", "--DASH", "-HYPHEN"]
QUOTE = '"DOUBLE-QUOTE'


def plain_text(words: Column, quotes_before: Column | None = None, every: int = 5) -> Column:
    """Words with verbalised punctuation as they are read out: some marks become words, the others go.

    Of the double quotes every fifth is read out, counted from the start of a document: ``quotes_before`` tells how many
    its earlier lines have (none if not given).
    """
    line = F.array_join(words, " ")
    for mark, word in [*SPOKEN.items(), *[(m, "") for m in SILENT]]:
        line = F.replace(line, F.lit(mark), F.lit(word))
    left = F.filter(F.split(line, " "), lambda w: w != "")
    before = F.lit(0) if quotes_before is None else quotes_before

    def read(w: Column, i: Column) -> Column:
        place = before + F.size(F.filter(F.slice(left, F.lit(1), i), lambda x: x == QUOTE))
        return F.when(w != QUOTE, w).when(place % every == 0, "quote").otherwise("")

    return F.filter(F.transform(left, read), lambda w: w != "")


def plain_sentences(sents: DataFrame, doc: str = "doc_id", order: str = "sent_id", every: int = 5) -> DataFrame:
    """Sentences read out, with quotes counted along each document; lines of markup (``<...``) go."""
    sents = sents.where(~F.coalesce(F.get("words", F.lit(0)).startswith("<"), F.lit(False)))
    marks = F.size(F.filter("words", lambda w: w == QUOTE))
    earlier = F.coalesce(F.sum(marks).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = sents.withColumn("_before", earlier)
    return counted.withColumn("words", plain_text(F.col("words"), F.col("_before"), every)).drop("_before")
