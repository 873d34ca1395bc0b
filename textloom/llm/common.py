"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every operator here: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; one of this machine only where all of Spark runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Texts sent to a Python worker at once; Spark's own 10,000 are no bound where texts may be long.
BATCH_ROWS, DEFAULT_BATCH_ROWS = "1000", "10000"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in small batches, unless the session has a size of its own (it holds for the session)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def trim() -> None:
    """Give freed memory of a Python worker back: workers are reused, and what one stage held would count in the next."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def guarded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no operator uses for its own columns, and the new name of each column."""
    names = {c: f"__own{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def unit_draw(seed: str, *keys: Column) -> Column:
    """A reproducible number strictly between 0 and 1 for each key, alike on every engine with MD5."""
    joined = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], amount: str | None = None, *, prefix: str = "_"
) -> DataFrame:
    """Add ``{prefix}rank`` (from 1) and, if asked, ``{prefix}total`` (inclusive running sum of ``amount``) within each group.

    A range partitioning by group and order splits any group over as many tasks as it needs; each
    slice is numbered on its own and shifted by the totals of the slices before it, of which a group
    has at most as many as there are partitions. A null group is a group like any other.
    """
    spark = df.sparkSession
    pid, rank, total = f"{prefix}slice", f"{prefix}rank", f"{prefix}total"
    part, rows_in, sum_in, rows_to, sum_to = (f"{prefix}{x}" for x in ("part", "rows_in", "sum_in", "rows_to", "sum_to"))
    keys = [F.col(g).asc_nulls_last() for g in group]
    dealt = df.repartitionByRange(shuffle_width(spark), *keys, *order).withColumn(pid, F.spark_partition_id())
    dealt = cut(dealt)
    inside = Window.partitionBy(pid, *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count(F.lit(1)).alias(rows_in)] + ([F.sum(amount).alias(sum_in)] if amount else [])
    shift = dealt.groupBy(pid, *group).agg(*sums)
    shift = shift.withColumn(rows_to, F.coalesce(F.sum(rows_in).over(before), F.lit(0)))
    if amount:
        shift = shift.withColumn(sum_to, F.coalesce(F.sum(sum_in).over(before), F.lit(0)))
    shift = shift.select(
        F.col(pid).alias(part), *[F.col(g).alias(f"{prefix}of_{g}") for g in group], rows_to, *([sum_to] if amount else [])
    )
    numbered = dealt.withColumn(rank, F.row_number().over(inside).cast("long"))
    if amount:
        numbered = numbered.withColumn(total, F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    match = F.col(pid) == F.col(part)
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"{prefix}of_{g}"))
    out = numbered.join(shift, match)
    out = out.withColumn(rank, F.col(rank) + F.col(rows_to))
    if amount:
        out = out.withColumn(total, F.col(total) + F.col(sum_to))
    return out.drop(pid, part, rows_to, sum_to, *[f"{prefix}of_{g}" for g in group])


#: Edges of one node from which its rows are dealt to several tasks in the joins of connected components, and to how many.
HOT_DEGREE, SALTS = 2048, 8


def salted_join(rows: DataFrame, key: str, other: str, table: DataFrame, table_key: str, salts: int) -> DataFrame:
    """Inner join of ``rows`` to ``table`` (one row per key) with the rows of a key dealt to ``salts`` parts by ``other``."""
    if salts < 2:
        return rows.join(table, F.col(key) == F.col(table_key))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    copied = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, (F.col(key) == F.col(table_key)) & (F.col("_salt") == F.col("_copy"))).drop("_salt", "_copy")


def connected_components(edges: DataFrame, a: str, b: str, *, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: ``node``, ``root`` (the smallest node reachable).

    Alternates the large-star and small-star rewirings, each a grouped minimum and one join back, until
    the edge set no longer changes. While a node has many edges, as the centre of a large star has, the joins
    deal the edges of each node to several tasks. Edges stay distributed; only a count, a checksum and the
    greatest number of edges of a node reach the driver.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut(now.select(big.alias("u"), small.alias("v")).distinct())
    seen: tuple | None = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        degree = both.groupBy("u").count().agg(F.max("count")).first()[0] or 0
        salts = SALTS if degree > HOT_DEGREE else 1
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), "u", "v", least, "c", salts).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        wired = salted_join(large, "u", "v", floor, "c", salts)
        now = wired.select(F.col("v").alias("u"), F.col("m").alias("v")).union(wired.select("u", F.col("m").alias("v")))
        now = cut(now.where("u <> v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.union(roots)
