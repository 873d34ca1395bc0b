"""Kernels over sentences and lattices as DataFrame operators.

A model table is gathered for a kernel only below ``limit`` rows, checked before; beyond that its rows
are first restricted to the words that the sentences and their candidates hold, and if it is still larger,
the sentences are dealt into blocks of vocabulary by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.kernels import decode as K
from textloom.kernels.lattice import Lattice
from textloom.kernels.lm import TableModel
from textloom.operators.score import Model

MODEL_ROWS = 5_000_000


def table_model(model: Model, words: DataFrame | None = None, limit: int = MODEL_ROWS) -> TableModel:
    """The model in memory, restricted to n-grams over ``words`` (column ``w``) if given; refuses one over the limit."""
    probs, bows = model.probs, model.bows
    if words is not None:
        known = words.select("w").union(words.sparkSession.createDataFrame([("<s>",), ("</s>",), ("<unk>",)], "w string")).distinct()
        probs = probs.join(known, "w", "left_semi")
        if model.order <= 2:
            context = known.select(F.col("w").alias("ctx")).union(words.sparkSession.createDataFrame([("",)], "ctx string"))
            probs, bows = probs.join(context, "ctx", "left_semi"), bows.join(context, "ctx", "left_semi")
    n = probs.count()
    if n > limit:
        raise ValueError(f"the model has {n} rows for these words; split the sentences by vocabulary")
    rows = [(r["ctx"], r["w"], r["logp"]) for r in probs.select("ctx", "w", "logp").toLocalIterator()]
    weights = [(r["ctx"], r["bow"]) for r in bows.select("ctx", "bow").toLocalIterator()]
    return TableModel.from_rows(model.order, rows, weights)


def over_sentences(sents: DataFrame, keys: Sequence[str], kernel: Callable, schema: str, shared=None) -> DataFrame:
    """Rows of ``kernel(words, shared)`` for each sentence; the shared object is broadcast once."""
    handle = sents.sparkSession.sparkContext.broadcast(shared)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                for out in kernel(list(row[-1]), handle.value):
                    rows.append((*row[:-1], *out))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    kinds = dict(sents.dtypes)
    return sents.select(*keys, "words").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def disambiguate(sents: DataFrame, keys: Sequence[str], candidates: dict, model: TableModel, **options) -> DataFrame:
    """Best hidden word string of each sentence."""

    def kernel(words, shared):
        found = K.disambiguate(words, shared[0], shared[1], **options)
        return [(" ".join(found[0][1]), round(found[0][0], 5))] if found else []

    return over_sentences(sents, keys, kernel, "tags string, score double", (candidates, model))


def hidden_events(sents: DataFrame, keys: Sequence[str], events: Sequence[str], model: TableModel, **options) -> DataFrame:
    """Each word followed by its event, if any."""

    def kernel(words, shared):
        found = K.hidden_events(words, list(events), shared, **options)
        return [(" ".join(x for w, e in zip(words, found[0][1], strict=True) for x in ([w] if e == K.NO_EVENT else [w, e])), round(found[0][0], 5))] if found else []

    return over_sentences(sents, keys, kernel, "tagged string, score double", model)


def segment(sents: DataFrame, keys: Sequence[str], model: TableModel, bias: float = 0.0) -> DataFrame:
    """Sentence starts within each sequence."""
    return over_sentences(sents, keys, lambda words, m: [(" ".join(("<s> " if s else "") + w for w, s in zip(words, K.segment(words, m, bias), strict=True)),)], "segmented string", model)


def class_scores(sents: DataFrame, keys: Sequence[str], model: TableModel, classes: dict) -> DataFrame:
    """Log probability of each sentence under a class model."""

    def kernel(words, shared):
        probs = K.class_probs(words, *shared)
        return [(round(sum(p for p in probs if p > K.ZERO), 5), sum(p == K.ZERO for p in probs))]

    return over_sentences(sents, keys, kernel, "logprob double, zeros int", (model, classes))


def per_word(sents: DataFrame, keys: Sequence[str], kernel: Callable, shared) -> DataFrame:
    """Sum of a kernel's word log probabilities."""
    return over_sentences(sents, keys, lambda words, s: [(round(sum(p for p in kernel(words, s) if p > K.ZERO), 5),)], "logprob double", shared)


# ---- lattices ----


def over_lattices(nodes: DataFrame, edges: DataFrame, kernel: Callable[[Lattice], list[tuple]], schema: str) -> DataFrame:
    """Rows of a kernel for each lattice; nodes (lat, node, word), edges (lat, src, dst, weight); start 0, end 1."""
    n = nodes.groupBy("lat").agg(F.collect_list(F.struct("node", "word")).alias("n"))
    e = edges.groupBy("lat").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("e"))
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for lat, ns, es in batch.itertuples(index=False):
                lattice = Lattice.from_rows([(x["node"], x["word"]) for x in ns], sorted((x["src"], x["dst"], x["weight"]) for x in es), 0, 1)
                rows += [(lat, *r) for r in kernel(lattice)]
            yield pd.DataFrame(rows, columns=["lat", *names])

    return n.join(e, "lat").mapInPandas(run, f"lat {dict(nodes.dtypes)['lat']}, {schema}")


def lattices_of_lists(hyps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A lattice per utterance with one path per hypothesis, weighted by its total."""
    base = hyps.select(F.col("utt").alias("lat"), (F.col("rank") * 1000 + 2).alias("_b"), "words", "total")
    inner = base.select("lat", F.posexplode("words").alias("_k", "word"), "_b")
    ends = hyps.select(F.col("utt").alias("lat")).distinct().select("lat", F.explode(F.array(F.lit(0), F.lit(1))).alias("node"), F.lit(None).cast("string").alias("word"))
    nodes = inner.select("lat", (F.col("_b") + F.col("_k")).cast("int").alias("node"), "word").unionByName(ends.select("lat", F.col("node").cast("int").alias("node"), "word"))
    n = F.size("words")
    path = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("_b") + k), F.array(F.lit(1)))
    steps = base.where(n > 0).select("lat", "total", path.alias("_path"))
    steps = steps.select("lat", "total", "_path", F.posexplode(F.slice("_path", 1, F.size("_path") - 1)).alias("_k", "src"))
    edges = steps.select("lat", F.col("src").cast("int").alias("src"), F.get(F.col("_path"), F.col("_k") + 1).cast("int").alias("dst"), F.when(F.col("_k") == 0, F.col("total")).otherwise(0.0).alias("weight"))
    return nodes, edges


def best_paths(nodes: DataFrame, edges: DataFrame, n: int = 1) -> DataFrame:
    return over_lattices(nodes, edges, lambda lat: [(k + 1, " ".join(w), round(s, 6)) for k, (s, w) in enumerate(lat.nbest(n))], "rank int, words string, score double")


def node_posteriors(nodes: DataFrame, edges: DataFrame, scale: float = 1.0) -> DataFrame:
    return over_lattices(nodes, edges, lambda lat: [(n, lat.words[n], round(p, 6)) for n, p in sorted(lat.posteriors(scale).items())], "node int, word string, posterior double")


def expected_ngrams(nodes: DataFrame, edges: DataFrame, order: int, scale: float = 1.0) -> DataFrame:
    """Expected n-gram counts summed over all lattices."""
    rows = over_lattices(nodes, edges, lambda lat: [(len(g), " ".join(g), p) for g, p in lat.expected_ngrams(order, scale).items()], "ord int, ngram string, p double")
    return rows.groupBy("ord", "ngram").agg(F.sum("p").alias("cnt"))
