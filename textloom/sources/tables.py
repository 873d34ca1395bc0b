"""Counts and models as Parquet directories: the storage formats of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.sequences import first_word, gram
from textloom.operators.counts import limit_vocabulary
from textloom.operators.score import Model


def write_counts_table(counts: DataFrame, path: str) -> None:
    """Counts by order, in files that hold ranges of first words: readers skip files and row groups by their bounds."""
    rows = counts.select("ord", "ctx", "w", "cnt", first_word(gram(F.col("ctx"), F.col("w"))).alias("first"))
    # a frequent first word is spread by the second key
    rows.repartitionByRange("ord", "first", "ctx", "w").sortWithinPartitions("ord", "first", "ctx", "w").write.partitionBy("ord").parquet(path)


def read_counts_table(spark: SparkSession, path: str, order: int | None = None, first: tuple[str, str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Counts of one or all orders, of first words in a closed range, or of words all in a vocabulary (column ``w``).

    An order is a folder and a range is pushed to the scan. A vocabulary asks for the range of its words, then for the
    words themselves; an empty one leaves no rows but those of sentence boundaries.
    """
    rows = spark.read.parquet(path)
    if order is not None:
        rows = rows.where(F.col("ord") == order)
    if first is not None:
        rows = rows.where(F.col("first").between(*first))
    if vocabulary is None:
        return rows.select("ord", "ctx", "w", "cnt")
    low, high = vocabulary.agg(F.min("w"), F.max("w")).first()
    boundary = F.col("first").isin("<s>", "</s>")
    rows = rows.where(boundary if low is None else boundary | F.col("first").between(low, high))
    top = order or spark.read.parquet(path).agg(F.max("ord")).first()[0] or 1
    return limit_vocabulary(rows.select("ord", "ctx", "w", "cnt"), vocabulary, top)


def write_model_table(model: Model, path: str) -> None:
    """A model as two tables, by order and by context length."""
    model.probs.repartition("ord", "ctx").write.partitionBy("ord").parquet(f"{path}/probs")
    model.bows.repartition("len", "ctx").write.partitionBy("len").parquet(f"{path}/bows")


def read_model_table(spark: SparkSession, path: str) -> Model:
    # schemas are given because a unigram model has no weights, and so no files, to learn one from
    probs = spark.read.schema("ctx string, w string, logp double, ord int").parquet(f"{path}/probs").select("ord", "ctx", "w", "logp")
    bows = spark.read.schema("ctx string, bow double, len int").parquet(f"{path}/bows").select("len", "ctx", "bow")
    return Model(probs.agg(F.max("ord")).first()[0] or 1, probs, bows)
