"""Text sources: one line is one sentence, words separated by blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.sequences import words_of


def sentences(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, ``sent_id`` (line number from 1) and ``words`` of every non-empty line."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_line"))
    some = lines.where(F.col("_line").rlike("[^ \\t\\r\\n]"))  # asked of the line: a condition on the words would split it twice
    return some.select(*keys, (F.col("_at") + 1).alias("sent_id"), words_of(F.col("_line")).alias("words"))


def weighted_sentences(df: DataFrame, line: str = "line", last: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines whose first (or last) word is their weight."""
    words = words_of(F.col(line))
    weight = F.element_at(words, -1 if last else 1).cast("double")
    rest = F.slice(words, 1, F.size(words) - 1) if last else F.slice(words, 2, F.size(words))
    return df.where(F.size(words) > 1).select(*keys, weight.alias("weight"), rest.alias("words"))


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Lines of text files (gz and bz2 are read by Spark's codecs) with ``file`` and ``words``."""
    if encoding:
        raw = spark.read.option("encoding", encoding).option("lineSep", "\n").csv(path, schema="value string", sep="\x00", quote="")
    else:
        raw = spark.read.text(path)
    out = raw.select(F.input_file_name().alias("file"), F.col("value").alias("line"), words_of(F.col("value")).alias("words"))
    return out.where(F.size("words") > 0)


def read_marked_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of uncompressed text files of mixed encodings: a byte order mark at a file's start tells UTF-16 (either order) or UTF-8.

    Files without a mark are UTF-8. A file is decoded as a whole in one task.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    head, rest = F.hex(F.substring("content", 1, 3)), lambda n: F.substring(F.col("content"), n + 1, 1 << 30)
    text = (
        F.when(head.startswith("FFFE"), F.decode(rest(2), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
        .when(head == "EFBBBF", F.decode(rest(3), "UTF-8")).otherwise(F.decode("content", "UTF-8"))
    )
    lines = raw.select("file", F.explode(F.split(text, "\\r?\\n")).alias("line"))
    return lines.select("file", "line", words_of(F.col("line")).alias("words")).where(F.size("words") > 0)


def with_directives(df: DataFrame, escape: str, order: str, line: str = "line", group: tuple[str, ...] = ()) -> DataFrame:
    """Number the stretches between lines that start with the escape; directives get ``directive`` true."""
    from pyspark.sql import Window

    mark = F.col(line).startswith(escape)
    running = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("directive", mark).withColumn("state_id", F.sum(mark.cast("int")).over(running))


def read_counts(spark: SparkSession, path: str, fractional: bool = False) -> DataFrame:
    """``w1 ... wk <tab> count`` lines as counts."""
    from textloom.functions.sequences import but_last, last_word

    raw = spark.read.text(path).select(F.trim(F.regexp_extract("value", r"^(.*\S)\s+(\S+)\s*$", 1)).alias("g"), F.regexp_extract("value", r"(\S+)\s*$", 1).alias("c"))
    g = F.regexp_replace("g", r"\s+", " ")
    rows = raw.where("g <> ''").select(g.alias("g"), F.col("c").cast("double" if fractional else "long").alias("cnt"))
    out = rows.select((F.size(F.split("g", " "))).alias("ord"), but_last(F.col("g")).alias("ctx"), last_word(F.col("g")).alias("w"), "cnt")
    return out.groupBy("ord", "ctx", "w").agg(F.sum("cnt").alias("cnt"))


def write_counts(counts: DataFrame, path: str, order: int | None = None, ordered: bool = False) -> None:
    """Counts as text, all orders or one, sorted if asked (a distributed sort: part files are in order)."""
    from textloom.functions.sequences import gram

    rows = counts if order is None else counts.where(F.col("ord") == order)
    rows = rows.select(gram(F.col("ctx"), F.col("w")).alias("g"), "cnt")
    rows = rows.orderBy("g") if ordered else rows
    rows.select(F.concat_ws("\t", "g", F.col("cnt").cast("string")).alias("value")).write.text(path)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """``CLASS [p] word ...`` lines as ``class``, ``p`` and ``expansion``; without p all expansions of a class are alike likely."""
    from pyspark.sql import Window

    raw = spark.read.text(path).select(words_of(F.col("value")).alias("t")).where(F.size("t") > 1)
    number = F.expr("try_cast(t[1] as double)")
    rows = raw.select(F.col("t")[0].alias("class"), number.alias("p"), F.when(number.isNull(), F.slice("t", 2, F.size("t"))).otherwise(F.slice("t", 3, F.size("t"))).alias("expansion"))
    same = Window.partitionBy("class")
    return rows.withColumn("p", F.coalesce("p", 1 / F.count(F.lit(1)).over(same)))


def read_map(spark: SparkSession, path: str, sequences: bool = False) -> DataFrame:
    """``word target [p] target [p] ...`` lines as (w1, w2, p); with ``sequences``, ``word p w w w`` as a dictionary."""
    raw = spark.read.text(path).select(words_of(F.col("value")).alias("t")).where(F.size("t") > 1)
    if sequences:
        number = F.expr("try_cast(t[1] as double)")
        return raw.select(F.col("t")[0].alias("word"), F.when(number.isNull(), F.slice("t", 2, F.size("t"))).otherwise(F.slice("t", 3, F.size("t"))).alias("pron"), F.coalesce(number, F.lit(1.0)).alias("p"))
    items = raw.select(F.col("t")[0].alias("w1"), F.posexplode(F.slice("t", 2, F.size("t"))).alias("at", "item"), "t")
    follow = F.expr("try_cast(get(t, at + 2) as double)")
    return items.where(F.expr("try_cast(item as double)").isNull()).select("w1", F.col("item").alias("w2"), F.coalesce(follow, F.lit(1.0)).alias("p"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``utterance word ...`` lines."""
    raw = spark.read.text(path).select(words_of(F.col("value")).alias("t")).where(F.size("t") > 0)
    return raw.select(F.col("t")[0].alias("utt"), F.slice("t", 2, F.size("t")).alias("words"))
