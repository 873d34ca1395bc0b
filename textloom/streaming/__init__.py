"""Structured Streaming operators: running counts, windows over events, and a stateful cache model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.sequences import with_boundaries, words_of
from textloom.operators.counts import grams_of


def running_counts(lines: DataFrame, order: int, line: str = "text") -> DataFrame:
    """N-gram counts of a stream of texts so far (update or complete mode)."""
    rows = lines.select(F.explode(F.split(F.col(line), "\n")).alias("_l")).select(words_of(F.col("_l")).alias("words")).where(F.size("words") > 0)
    rows = rows.select(with_boundaries(F.col("words")).alias("_w")).select(F.explode(grams_of(F.col("_w"), order)).alias("g"))
    return rows.groupBy("g.ord", "g.ctx", "g.w").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event types per window of event time, late events within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def cache_stream(words: DataFrame, key: str, history: int) -> DataFrame:
    """Relative frequency of each word among the last ``history`` words of its stream, which is the state.

    ``words`` has the key, ``at`` (order within the stream) and ``w``; rows of a key arrive in order of
    micro-batches and are sorted within one.
    """
    kind = dict(words.dtypes)[key]

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, w in zip(rows["at"], rows["w"], strict=True):
            out.append((k[0], at, w, last.count(w) / len(last) if last else 0.0))
            last = [*last, w][-history:]
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "at", "w", "cache"])

    return words.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, at long, w string, cache double", "last array<string>", "append", GroupStateTimeout.NoTimeout)
