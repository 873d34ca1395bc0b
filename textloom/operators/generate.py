"""Random sentences from a model in memory, by inverse cumulative probability in word order."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.kernels.lm import TableModel


def sample_sentences(spark: SparkSession, model: TableModel, n: int, seed: int = 0, prefix: tuple[str, ...] = (), longest: int = 200) -> DataFrame:
    """``id`` and ``sentence``; each sentence has its own generator, so results do not depend on partitioning."""
    handle = spark.sparkContext.broadcast(model)

    def run(batches):
        m = handle.value
        vocabulary = sorted({k[-1] for k in m.probs if len(k) == 1 and k[0] != "<s>"})
        known: dict[tuple[str, ...], list[float]] = {}
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                words, history = list(prefix), ["<s>", *prefix]
                while len(words) < longest:
                    ctx = m.used(history)
                    if ctx not in known:
                        known[ctx] = np.cumsum([10 ** m.log_prob(w, ctx) for w in vocabulary]).tolist()
                    sums = known[ctx]
                    w = vocabulary[min(bisect.bisect_left(sums, rng.random() * sums[-1]), len(vocabulary) - 1)]
                    if w == "</s>":
                        break
                    words.append(w)
                    history.append(w)
                rows.append((int(i), " ".join(words)))
            yield pd.DataFrame(rows, columns=["id", "sentence"])

    return spark.range(n).select(F.col("id")).mapInPandas(run, "id long, sentence string")
