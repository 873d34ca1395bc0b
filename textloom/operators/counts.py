"""N-gram counting and count algebra.

All orders are counted in one explode and one hash aggregation, which combines before its shuffle. An
n-gram is a context string and a word, so prefixes, suffixes and back-off keys are plain string columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.sequences import but_last, first_word, gram, last_word, shorter, suffix, with_boundaries
from textloom.plans.session import cut
from textloom.schema import BOS, EOS, META, NON_EVENTS, UNK


def grams_of(words: Column, order: int, least: int = 1) -> Column:
    """Structs (ord, ctx, w) of all n-grams of a sequence, up to ``order`` words."""

    def ending_at(j: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.least(F.lit(order), j)),
            lambda n: F.struct(n.alias("ord"), F.array_join(F.slice(words, j - n + 1, n - 1), " ").alias("ctx"), F.get(words, j - 1).alias("w")),
        )

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), ending_at))
    return every if least == 1 else F.filter(every, lambda g: g["ord"] >= least)


def count_ngrams(sents: DataFrame, order: int, *, by: Sequence[str] = (), weight: Column | None = None, boundaries: bool = True, least: int = 1, block: str | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """Counts of all orders; ``weight`` makes them fractional, ``by`` keeps them apart.

    Where sentences lie dealt by the column ``block``, only the longest n-gram that ends at each place is counted, inside its
    block; those counts are dealt by the last word, which all shorter n-grams at their end share, and give theirs as they lie.
    With ``contexts`` (``ctx``, each with all its ends), n-grams of two words or more are counted behind these alone, and all words.
    """
    if contexts is not None and (block is None or order < 2):
        raise ValueError("contexts are asked of n-grams of two words or more, counted in blocks")
    words = with_boundaries(F.col("words")) if boundaries else F.col("words")
    extra = [weight.alias("_weight")] if weight is not None else []
    whole = block is not None and order > 1
    kept = [*by, *([block] if whole else []), *["_weight" for _ in extra]]
    # a row per place, then one per order: both explodes compile, which functions over nested arrays do not. The outer
    # explode asks no condition of the words, which would be evaluated before them and split each line several times more
    rows = sents.select(*kept[: len(kept) - len(extra)], *extra, words.alias("_words")).select(*kept, "_words", F.posexplode_outer("_words").alias("_at", "_w")).where("_at is not null")
    before = {k: F.get("_words", F.col("_at") - k) for k in range(1, order)}
    total = F.sum("_weight") if extra else F.count(F.lit(1))
    if whole:
        rows = rows.select(*kept, F.concat_ws(" ", *[before[k] for k in range(order - 1, 0, -1)]).alias("_ctx"), F.col("_w").alias("w"))
        if contexts is not None:  # the longest end of the context that is asked for, before anything is counted or dealt
            for k in range(order - 1, 0, -1):
                rows = rows.join(contexts.select(F.col("ctx").alias(f"_k{k}")), suffix(F.col("_ctx"), k) == F.col(f"_k{k}"), "left")
            rows = rows.withColumn("_ctx", F.coalesce(*[F.col(f"_k{k}") for k in range(order - 1, 0, -1)], F.lit(""))).drop(*[f"_k{k}" for k in range(1, order)])
        rows = rows.groupBy(*by, block, "_ctx", "w").agg(total.alias("_n")).drop(block).repartition("w")
        held = F.when(F.col("_ctx") == "", 0).otherwise(F.length("_ctx") - F.length(F.replace("_ctx", F.lit(" "))) + 1)
        ending = [F.when(held >= n - 1, F.struct(F.lit(n).alias("ord"), suffix(F.col("_ctx"), n - 1).alias("ctx"))) for n in range(least, order + 1)]
        rows = rows.select(*by, "w", "_n", F.explode(F.array(*ending)).alias("g")).where("g is not null")
        return rows.groupBy(*by, "g.ord", "g.ctx", "w").agg(F.sum("_n").alias("cnt"))
    ending = [F.when(F.col("_at") >= n - 1, F.struct(F.lit(n).alias("ord"), F.concat_ws(" ", *[before[k] for k in range(n - 1, 0, -1)]).alias("ctx"), F.col("_w").alias("w"))) for n in range(least, order + 1)]
    rows = rows.select(*kept, F.explode(F.array(*ending)).alias("g")).where("g is not null")
    return rows.groupBy(*by, "g.ord", "g.ctx", "g.w").agg(total.alias("cnt"))


def continuous_sentences(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One long sequence per key, lines joined in order."""
    listed = sents.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sent_id", "words"))).alias("_l"))
    return listed.select(key, F.flatten(F.transform("_l", lambda x: x["words"])).alias("words"))


def merge(*counts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, counts).groupBy("ord", "ctx", "w").agg(F.sum("cnt").alias("cnt"))


def recompute_lower(counts: DataFrame, order: int) -> DataFrame:
    """Lower orders summed from their children, from the top; n-grams without children keep their count."""
    out, level = [], counts.where(F.col("ord") == order)
    for n in range(order - 1, 0, -1):
        out.append(level)
        sums = level.groupBy("ctx").agg(F.sum("cnt").alias("_s")).select(but_last(F.col("ctx")).alias("ctx"), last_word(F.col("ctx")).alias("w"), "_s")
        own = counts.where(F.col("ord") == n)
        level = own.join(sums, ["ctx", "w"], "full").select(F.lit(n).alias("ord"), "ctx", "w", F.coalesce("_s", "cnt").alias("cnt"))
    out.append(level)
    return reduce(DataFrame.unionByName, out)


def at_least(counts: DataFrame, minimum: dict[int, int], order: int) -> DataFrame:
    """N-grams with the minimum count of their order whose prefixes all stay too."""
    kept = []
    for n in range(1, order + 1):
        level = counts.where((F.col("ord") == n) & (F.col("cnt") >= minimum.get(n, 1)))
        if n > 1:
            level = level.join(kept[-1].select(gram(F.col("ctx"), F.col("w")).alias("ctx")), "ctx", "left_semi").select(*counts.columns)
        kept.append(level)
    return reduce(DataFrame.unionByName, kept)


def constant(counts: DataFrame, value: int = 1) -> DataFrame:
    return counts.withColumn("cnt", F.lit(value).cast("long"))


def intersect(counts: DataFrame, template: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Counts of the n-grams of a template only; with ``keep_zero``, also those that do not occur."""
    keys = template.select("ord", "ctx", "w").distinct()
    if keep_zero:
        return keys.join(counts, ["ord", "ctx", "w"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return counts.join(keys, ["ord", "ctx", "w"], "left_semi")


def limit_vocabulary(counts: DataFrame, vocabulary: DataFrame, order: int) -> DataFrame:
    """N-grams all of whose words are in the vocabulary (column ``w``)."""
    known = vocabulary.select(F.col("w").alias("_v")).union(vocabulary.sparkSession.createDataFrame([(BOS,), (EOS,)], "_v string")).distinct()
    out = counts.withColumn("_all", F.split(gram(F.col("ctx"), F.col("w")), " "))
    for k in range(order):  # the counts are read once; places beyond an n-gram's end ask for a word that is always known
        out = out.join(known, F.coalesce(F.get("_all", F.lit(k)), F.lit(BOS)) == F.col("_v"), "left_semi")
    return out.drop("_all")


def map_oov(sents: DataFrame, vocabulary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words outside the vocabulary (column ``w``) become the unknown word."""
    known = vocabulary.select(F.col("w").alias("_v")).distinct()
    rows = sents.select(*keys, F.posexplode("words").alias("_at", "_w")).join(known, F.col("_w") == F.col("_v"), "left")
    rows = rows.withColumn("_w", F.coalesce("_v", F.lit(UNK)))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_w"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["_w"]).alias("words"))


def substitute_aliases(sents: DataFrame, aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words with an alias row (``alias``, ``word``) become the word it stands for."""
    rows = sents.select(*keys, F.posexplode("words").alias("_at", "_w")).join(aliases, F.col("_w") == F.col("alias"), "left")
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("word", "_w").alias("_w")))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["_w"]).alias("words"))


def lowered(counts: DataFrame) -> DataFrame:
    return counts.select("ord", F.lower("ctx").alias("ctx"), F.lower("w").alias("w"), "cnt").groupBy("ord", "ctx", "w").agg(F.sum("cnt").alias("cnt"))


def reversed_counts(counts: DataFrame) -> DataFrame:
    """N-grams backwards, with the sentence boundaries swapped."""
    words = F.transform(F.reverse(F.split(gram(F.col("ctx"), F.col("w")), " ")), lambda x: F.when(x == BOS, F.lit(EOS)).when(x == EOS, F.lit(BOS)).otherwise(x))
    g = F.array_join(words, " ")
    return counts.select("ord", but_last(g).alias("ctx"), last_word(g).alias("w"), "cnt")


def context_counts(counts: DataFrame) -> DataFrame:
    """The n-gram of each context, with the summed count of what follows it."""
    return counts.where("ctx <> ''").groupBy("ord", "ctx").agg(F.sum("cnt").alias("cnt"))


def subset_by_context(counts: DataFrame, contexts: DataFrame) -> DataFrame:
    return counts.join(contexts.select("ctx").distinct(), "ctx", "left_semi").select(*counts.columns)


def scoring_events(counts: DataFrame, order: int) -> DataFrame:
    """N-grams that a model of the order scores: of that order, or shorter ones at the sentence start."""
    start = (F.col("ord") > 1) & (first_word(F.col("ctx")) == BOS)
    return counts.where((F.col("ord") == order) | start)


def counts_of_counts(counts: DataFrame, highest: int | None = None) -> DataFrame:
    """Number of n-grams ``n`` with each count ``k``, per order."""
    rows = counts.where(F.col("cnt") <= highest) if highest else counts
    return rows.groupBy("ord", F.col("cnt").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def meta_counts(counts: DataFrame, cutoff: dict[int, int], order: int) -> DataFrame:
    """N-grams under their order's cut-off become rows of a meta word that carries how many there were; only below prefixes that have a real row."""
    real = counts.where(reduce(lambda a, b: a | b, [(F.col("ord") == n) & (F.col("cnt") >= cutoff.get(n, 1)) for n in range(1, order + 1)]))
    low = counts.join(real, ["ord", "ctx", "w"], "left_anti")
    folded = low.groupBy("ord", "ctx", F.concat(F.lit(META), F.col("cnt").cast("string")).alias("w")).agg(F.count(F.lit(1)).alias("cnt"))
    prefixes = real.select(F.col("ord").alias("_o"), F.col("ctx").alias("_c")).distinct()
    folded = folded.join(prefixes, (F.col("ord") == F.col("_o")) & (F.col("ctx") == F.col("_c")), "left_semi")
    return real.unionByName(folded)


def kn_counts(counts: DataFrame, order: int) -> DataFrame:
    """Counts for Kneser-Ney estimation: below the top order, the number of distinct left extensions, taken from the
    unmodified next order; n-grams that start with a non-event keep their count, and none are created.

    An n-gram meets its extensions in one grouping, which needs no exchange where counts still lie by their last word.
    """
    below = F.when((F.col("ord") > 1) & (F.col("cnt") > 0), F.struct((F.col("ord") - 1).alias("ord"), shorter(F.col("ctx")).alias("ctx"), F.lit(None).alias("own"), F.lit(1).cast("long").alias("ext")))
    itself = F.struct("ord", "ctx", F.col("cnt").alias("own"), F.lit(0).cast("long").alias("ext"))
    rows = counts.where(F.col("ord") <= order).select("w", F.explode(F.array(itself, below)).alias("g")).where("g is not null")
    met = rows.groupBy("g.ord", "g.ctx", "w").agg(F.sum("g.own").alias("cnt"), F.sum("g.ext").alias("_ext")).where("cnt is not null")
    raw = (F.col("ord") == order) | first_word(gram(F.col("ctx"), F.col("w"))).isin(*NON_EVENTS)
    return met.select("ord", "ctx", "w", F.when(raw, F.col("cnt")).otherwise(F.col("_ext")).alias("cnt"))


def stop_counts(sents: DataFrame, order: int, stop_words: Sequence[str]) -> DataFrame:
    """Counts whose contexts hold the last words that are no stop words."""
    stop = list(stop_words)
    # each word that is no stop word is the nearest for the places behind it up to the next such, so a line takes time in
    # proportion to its length; before the first one there is none
    placed = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: ~x["w"].isin(stop))
    rows = sents.select(with_boundaries(F.col("words")).alias("_words"))
    rows = rows.select("_words", F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("w"))), placed).alias("_near"))
    rows = rows.select("_words", "_near", F.posexplode("_near").alias("_k", "_x"))
    following = F.coalesce(F.get("_near", F.col("_k") + 1)["at"], F.size("_words") - 1)
    behind = F.slice("_words", F.col("_x.at") + 2, following - F.col("_x.at"))
    rows = rows.select("_near", "_k", F.explode(behind).alias("_w"))
    back = {k: F.get("_near", F.col("_k") - k)["w"] for k in range(order - 1)}
    ending = [F.when(F.col("_k") >= n - 1, F.struct(F.lit(n).alias("ord"), F.concat_ws(" ", *[back[k] for k in range(n - 2, -1, -1)]).alias("ctx"), F.col("_w").alias("w"))) for n in range(1, order + 1)]
    rows = rows.select(F.explode(F.array(*ending)).alias("g")).where("g is not null")
    return rows.groupBy("g.ord", "g.ctx", "g.w").agg(F.count(F.lit(1)).alias("cnt"))


def tagged_counts(sents: DataFrame, order: int) -> DataFrame:
    """Counts of ``tagged`` (array of word and tag): all word n-grams from a start, then with tokens replaced one after the
    other by their tags, n-grams longer than the number replaced."""
    tok = F.col("tagged")

    def starting_at(i: Column) -> Column:
        window = F.slice(tok, i, order)

        def replaced(k: Column) -> Column:
            text = F.transform(window, lambda t, p: F.when(p < k, F.coalesce(t["tag"], t["word"])).otherwise(t["word"]))
            return F.transform(F.sequence(k + 1, F.size(window)), lambda n: F.slice(text, 1, n))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(window) - 1), replaced))

    rows = sents.where(F.size("tagged") > 0).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(tok)), starting_at))).alias("g"))
    g = F.array_join("g", " ")
    return rows.groupBy(F.size("g").alias("ord"), but_last(g).alias("ctx"), last_word(g).alias("w")).agg(F.count(F.lit(1)).alias("cnt"))


def class_spans(sents: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where class expansions stand in sentences: keys, ``at`` (from 1), ``size``, ``class``, ``expansion``; leftmost, longest, without overlap.

    Every stretch of words as long as some expansion is looked up by an equi-join. The longest match of a place is a span; a
    span that begins where no earlier one reaches is taken, and from it the choice goes on to the first span behind it. Those
    steps are followed by doubling: in each round the taken spans reach as far again, so that a chain of overlapping spans
    takes a number of rounds that grows with its logarithm. An expansion of several classes counts for the most likely (ties by name).
    """
    sizes = sorted(r[0] for r in classes.where(F.size("expansion") > 0).select(F.size("expansion")).distinct().collect())
    text = F.array_join("expansion", " ")
    best = classes.where(F.size("expansion") > 0).groupBy(text.alias("_t")).agg(F.min_by(F.struct("class", "expansion"), F.struct(-F.col("p"), F.col("class"))).alias("_b"))
    words = F.col("words")
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.array(*map(F.lit, sizes)), lambda n: F.struct(i.alias("at"), n.alias("size")))))
    fits = F.filter(starts, lambda x: x["at"] + x["size"] - 1 <= F.size(words))
    rows = sents.where(F.size("words") > 0).select(*keys, F.explode(F.transform(fits, lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), F.array_join(F.slice(words, x["at"], x["size"]), " ").alias("_t")))).alias("x"))
    met = rows.select(*keys, "x.*").join(best, "_t")
    spans = met.groupBy(*keys, "at").agg(F.max_by(F.struct("size", "_b"), "size").alias("m")).select(*keys, "at", "m.size", "m._b.class", "m._b.expansion")
    if not sizes or sizes[-1] == 1:
        return spans
    line = Window.partitionBy(*keys).orderBy("at")
    reach = F.max(F.col("at") + F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    step = F.coalesce(*[F.when(F.col("size") == n, F.min("at").over(line.rangeBetween(n, Window.unboundedFollowing))) for n in sizes])
    spans = cut(spans.withColumns({"_head": F.coalesce(F.col("at") >= reach, F.lit(True)), "_to": step}))
    heads = spans.where("_head").select(*keys, "at")
    # what a head takes is certain; a step that leads to a head needs no following
    jumps = cut(spans.join(heads.withColumnRenamed("at", "_to").withColumn("_known", F.lit(True)), [*keys, "_to"], "left").where(F.col("_to").isNotNull() & F.col("_known").isNull()).select(*keys, "at", F.col("_to").alias("to")))
    taken = heads
    while not jumps.isEmpty():
        more = cut(taken.join(jumps, [*keys, "at"]).select(*keys, F.col("to").alias("at")))
        if more.isEmpty():
            break
        taken = cut(taken.unionByName(more).distinct())
        jumps = cut(jumps.join(jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far")), [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")))
    return spans.join(taken, [*keys, "at"], "left_semi").select(*keys, "at", "size", "class", "expansion")


def class_replaced(sents: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sentences with the expansions of classes (``class``, ``p``, ``expansion``) replaced by their class."""
    spans = class_spans(sents, classes, keys)
    covered = spans.select(*keys, F.explode(F.expr("sequence(at, at + size - 1)")).alias("_at"), "at", F.col("class").alias("_c"))
    rows = sents.select(*keys, F.posexplode("words").alias("_p", "_w")).withColumn("_at", F.col("_p") + 1).drop("_p")
    rows = rows.join(covered, [*keys, "_at"], "left").where(F.col("at").isNull() | (F.col("at") == F.col("_at")))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_c", "_w").alias("_w")))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["_w"]).alias("words"))


def class_replaced_counts(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts with expansions replaced inside each n-gram; what becomes alike is added up under its new order."""
    rows = counts.select("ord", "ctx", "w", "cnt", F.split(gram(F.col("ctx"), F.col("w")), " ").alias("words"))
    new = class_replaced(rows.select("ord", "ctx", "w", "words"), classes, ["ord", "ctx", "w"]).join(counts, ["ord", "ctx", "w"])
    text = F.array_join("words", " ")
    return new.groupBy(F.size("words").alias("ord"), but_last(text).alias("ctx"), last_word(text).alias("w")).agg(F.sum("cnt").alias("cnt"))


def expansion_probabilities(spans: DataFrame, classes: DataFrame, add: float = 1.0) -> DataFrame:
    """``class``, ``expansion``, ``n``, ``p``: how often each expansion stood for its class, smoothed by an added count."""
    n = spans.groupBy("class", "expansion").agg(F.count(F.lit(1)).alias("n"))
    rows = classes.select("class", "expansion").distinct().join(n, ["class", "expansion"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = rows.groupBy("class").agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return rows.join(whole, "class").select("class", "expansion", "n", F.when(F.col("_t") + F.col("_k") * add > 0, (F.col("n") + add) / (F.col("_t") + F.col("_k") * add)).otherwise(0.0).alias("p"))


def factored_counts(tokens: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """Counts of the child with every subset of its parents: the nodes of a back-off graph are the cube's grouping sets."""
    cube = tokens.cube(*parents, child).agg(F.count(F.lit(1)).alias("cnt"), F.grouping_id().alias("_g"))
    node = (F.lit(2 ** len(parents) - 1) - F.shiftright("_g", 1)).cast("int")
    return cube.where(F.col("_g").bitwiseAND(1) == 0).select(node.alias("node"), *parents, child, "cnt")


def expected_counts(hyps: DataFrame, order: int, exclude: DataFrame | None = None) -> DataFrame:
    """Expected n-gram counts of hypotheses with a ``posterior``; n-grams of the references are left out."""
    counts = count_ngrams(hyps, order, by=["utt"], weight=F.col("posterior"))
    if exclude is not None:
        seen = count_ngrams(exclude, order, by=["utt"]).select("utt", "ord", "ctx", "w")
        counts = counts.join(seen, ["utt", "ord", "ctx", "w"], "left_anti")
    return counts.groupBy("ord", "ctx", "w").agg(F.sum("cnt").alias("cnt"))


def oov_rate(counts: DataFrame, vocabulary: DataFrame, fragment: str = "-") -> DataFrame:
    """Tokens and types outside the vocabulary, with and without word fragments."""
    known = vocabulary.select(F.col("w").alias("_v")).distinct()
    one = counts.where((F.col("ord") == 1) & ~F.col("w").isin(BOS, EOS)).join(known, F.col("w") == F.col("_v"), "left")
    out, whole = F.col("_v").isNull(), ~F.col("w").endswith(fragment)
    return one.agg(
        F.sum("cnt").alias("tokens"), F.count(F.lit(1)).alias("types"),
        F.coalesce(F.sum(F.when(out, F.col("cnt"))), F.lit(0)).alias("oov_tokens"), F.count_if(out).alias("oov_types"),
        F.coalesce(F.sum(F.when(out & whole, F.col("cnt"))), F.lit(0)).alias("oov_whole_tokens"), F.count_if(out & whole).alias("oov_whole_types"),
    )
