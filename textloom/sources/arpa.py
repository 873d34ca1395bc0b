"""ARPA model files: a text format of one section per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.sequences import but_last, gram, last_word
from textloom.operators.score import ZERO, Model
from textloom.schema import ARPA_ZERO


def rows(model: Model) -> DataFrame:
    """``ord``, ``ngram``, ``logp`` and ``bow`` (null without one) of a model's n-grams."""
    g = model.probs.select("ord", gram(F.col("ctx"), F.col("w")).alias("ngram"), F.when(F.col("logp") == ZERO, F.lit(ARPA_ZERO)).otherwise(F.col("logp")).alias("logp"))
    b = model.bows.select(F.col("len").alias("_l"), F.col("ctx").alias("_c"), F.when(F.col("bow") == ZERO, F.lit(ARPA_ZERO)).otherwise(F.col("bow")).alias("bow"))
    return g.join(b, (F.col("ord") == F.col("_l")) & (F.col("ngram") == F.col("_c")), "left").drop("_l", "_c")


def lines(model: Model) -> DataFrame:
    """``section``, ``key`` and ``value``: the file's lines, to be sorted by section and key."""
    body = rows(model)
    number = lambda c: F.format_string("%.7g", c)
    text = F.concat_ws("\t", number("logp"), "ngram", F.when(F.col("bow").isNotNull(), number("bow")))
    grams = body.select(F.col("ord").alias("section"), F.col("ngram").alias("key"), text.alias("value"))
    spark = body.sparkSession
    counts = body.groupBy("ord").count().select(F.lit(0).alias("section"), F.format_string("1%03d", "ord").alias("key"), F.format_string("ngram %d=%d", "ord", "count").alias("value"))
    fixed = [(0, "0", "\\data\\"), (99, "", "\\end\\")] + [(n, "", f"\\{n}-grams:") for n in range(1, model.order + 1)]
    return spark.createDataFrame(fixed, "section int, key string, value string").unionByName(counts).unionByName(grams)


def write(model: Model, path: str) -> None:
    """One text file, sections and n-grams in order."""
    lines(model).repartitionByRange(1, "section", "key").sortWithinPartitions("section", "key").select("value").write.text(path)


def parse(spark: SparkSession, text: DataFrame, order: int | None = None) -> Model:
    """A model of lines (``section``, ``value``); orders above ``order`` are skipped."""
    fields = F.split("value", r"\t")
    body = text.where((F.col("section") > 0) & (F.col("section") < 99) & ~F.col("value").startswith("\\")).select(F.col("section").alias("ord"), fields.alias("f"))
    if order:
        body = body.where(F.col("ord") <= order)
    n = order or body.agg(F.max("ord")).first()[0] or 1
    real = lambda c: F.when(c <= ARPA_ZERO, F.lit(ZERO)).otherwise(c)
    g = F.col("f")[1]
    probs = body.select("ord", but_last(g).alias("ctx"), last_word(g).alias("w"), real(F.col("f")[0].cast("double")).alias("logp"))
    bows = body.where((F.size("f") > 2) & (F.col("ord") < n)).select(F.col("ord").alias("len"), g.alias("ctx"), real(F.get("f", F.lit(2)).cast("double")).alias("bow"))
    return Model(n, probs, bows)


def read(spark: SparkSession, path: str, order: int | None = None) -> Model:
    """A model file; sections are told apart by the header lines before them, within each file."""
    raw = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    header = F.regexp_extract("value", r"^\\(\d+)-grams:", 1)
    raw = raw.withColumn("_h", F.when(header != "", header.cast("int")).when(F.col("value").startswith("\\end"), 99).when(F.col("value").startswith("\\data"), 0))
    # headers are a handful of rows: each line takes the last header before it
    heads = [(r["_n"], r["_h"]) for r in raw.where(F.col("_h").isNotNull()).select("_n", "_h").collect()]
    section = F.lit(0)
    for n, h in sorted(heads):
        section = F.when(F.col("_n") >= n, F.lit(h)).otherwise(section)
    lines_ = raw.where(F.trim("value") != "").select(section.alias("section"), F.regexp_replace(F.trim("value"), r"^(\S+)\s+", "$1\t").alias("value"))
    # words may be separated by blanks and the weight by a blank or a tab
    size = F.size(F.split(F.regexp_replace("value", r"\s+", " "), " "))
    flat = F.split(F.regexp_replace("value", r"\s+", " "), " ")
    k = F.col("section")
    body = lines_.withColumn("value", F.when((k > 0) & (k < 99) & (size > 1), F.concat_ws("\t", flat[0], F.array_join(F.slice(flat, 2, k), " "), F.when(size > k + 1, F.element_at(flat, -1)))).otherwise(F.col("value")))
    return parse(spark, body, order)
