"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset and a
stride drawn from its name. Shards take turns, each claiming the first slot of its order that is still
free, until the table is full; so their shares differ by one slot at most, and when a shard joins or
leaves few slots change hands. A row's slot is a hash of its key modulo the table size, and the broadcast
table gives its shard in one probe. The table has ``table_size`` rows whatever the data, which bounds
the broadcast; rows are not shuffled.

A null key is hashed as a value of its own; equal keys (ties, repeated rows) share a shard; empty tables
give empty results; the caller's other columns stay as they are, and ``slot`` and ``shard`` replace
columns of those names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import guarded


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's walk over the slots."""
    draw = lambda use: int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:15], 16)
    return draw("offset") % size, draw("stride") % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int) -> np.ndarray:
    """Shard index of each slot."""
    if not is_prime(size) or len(shards) > size or not shards or len(set(shards)) < len(shards):
        raise ValueError("the table size must be a prime, no smaller than the number of distinct shards")
    table = np.full(size, -1, np.int32)
    walks = [list(preference(s, size)) for s in shards]
    left = size
    while left:
        for k, walk in enumerate(walks):
            if not left:
                break
            at, stride = walk
            while table[at] >= 0:
                at = (at + stride) % size
            table[at] = k
            walk[0] = (at + stride) % size
            left -= 1
    return table


def slot_of(key: Column, size: int) -> Column:
    """60 bits of the key's MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    filled = fill_table(shards, size)
    return spark.createDataFrame(pd.DataFrame({"_slot": np.arange(size), "_shard": [shards[k] for k in filled]}), "_slot long, _shard string")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], table_size: int = 16381) -> DataFrame:
    """Add ``slot`` and ``shard``."""
    table = lookup_table(df.sparkSession, shards, table_size)
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    own, names = guarded(df)
    placed = own.withColumn("slot", slot_of(F.col(names[key]), table_size)).join(F.broadcast(table), F.col("slot") == F.col("_slot"), "left")
    return placed.select(*[F.col(names[c]).alias(c) for c in kept], "slot", F.col("_shard").alias("shard"))


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, table_size: int = 16381, files_per_shard: int = 4) -> None:
    """Write one folder per shard; each shard's rows are dealt over several tasks by slot."""
    placed = assign_shards(df, key, shards, table_size)
    placed.repartition("shard", F.pmod("slot", F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)
