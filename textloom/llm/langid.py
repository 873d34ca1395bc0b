"""Language identification by Bayesian evidence fusion.

The posterior of a language given a document multiplies
* the likelihood of its text under byte-trigram models, fitted on at most ``sample`` labelled rows per
  language (a documented bound; those whose id and text hash lowest) and applied to whole texts;
* the reliability of a declared language (markup ``lang`` or a metadata column);
* the reliability of the address suffix or the first path segment, where there is an address;
* a prior of the host, from grouped counts of all documents labelled by their text alone: the host's counts
  are smoothed by those of its parent (the address suffix), these by the counts of the whole corpus. A
  document's own vote is left out.
Rejected (``kept`` false) are texts without a letter, texts whose best posterior is under ``least``, and
texts that are far less likely under their language than nearly all of its sample.

Texts of any length are read whole, one at a time. Null and empty texts have no text evidence and are rejected with language null; null declared
languages, addresses and hosts give no evidence (rows without host share one group). Equal posteriors go to
the first language by code. Rows stand alone, repeated rows get equal results. Without any labelled row
nothing can be fitted and every row is rejected. The caller's columns stay; results have the prefix ``li_`` and replace columns of
those names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, guarded, small_batches

BUCKETS = 1 << 13
RESULTS = ("li_lang", "li_posterior", "li_text_lang", "li_kept")
#: Languages that country suffixes speak for.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: Every ASCII byte that is no letter becomes a blank; bytes of other characters stay.
FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def trigram_buckets(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, those of blanks only left out."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    b = np.concatenate(([32], FOLD[raw], [32])).astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    code = code[code != 0x202020]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)


def fit(docs: DataFrame, *, id_col: str, text: str, label: str, languages: Sequence[str], sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood table [bucket, language], and each language's floor of the mean log-likelihood."""
    languages = list(languages)
    # the lowest hashes of id and text: rows that tie are equal in both, and one of them is as good as another
    order = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text), F.lit("")))
    slim = docs.where(F.col(label).isin(languages)).select(F.col(label).alias("l"), order.alias("h")).distinct()
    for group in (["l", F.pmod("h", F.lit(256))], ["l"]):  # the lowest of parts of a language first: one may hold most rows
        slim = slim.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("h"))).where(F.col("r") <= sample).drop("r")
    lowest = slim
    lowest = cut(lowest.select(F.col("l").alias("_l"), F.col("h").alias("_h")))
    rows = docs.select(F.col(label).alias("l"), order.alias("h"), F.col(text).alias("t"))
    # at most ``sample`` rows per language
    rows = cut(rows.join(F.broadcast(lowest), (F.col("l") == F.col("_l")) & (F.col("h") == F.col("_h"))).groupBy("l", "h").agg(F.first("t").alias("t")).select("l", "t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for batch in batches:
            for lang, t in zip(batch.column("l").to_pylist(), batch.column("t"), strict=True):
                found = np.bincount(trigram_buckets(t.as_py()), minlength=BUCKETS)
                counts[lang] = counts.get(lang, 0) + found
        yield pa.record_batch({"l": pa.array(list(counts), pa.string()), "c": pa.array([c.tolist() for c in counts.values()], pa.list_(pa.int64()))})

    table = np.full((len(languages), BUCKETS), 0.5)
    for lang, c in rows.mapInArrow(count, "l string, c array<long>").collect():
        table[languages.index(lang)] += np.array(c)
    logs = np.log(table / table.sum(1, keepdims=True)).T.copy()
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    @F.arrow_udf("double")
    def mean(texts: pa.Array, labels: pa.Array) -> pa.Array:
        out = []
        for t, lang in zip(texts, labels.to_pylist(), strict=True):
            b = trigram_buckets(t.as_py())
            out.append(float(shared.value[b, languages.index(lang)].mean()) if len(b) >= 50 else None)
        return pa.array(out, pa.float64())

    lows = dict(rows.select("l", mean("t", "l").alias("m")).groupBy("l").agg(F.expr("percentile(m, 0.01)")).collect())
    floor = np.array([(lows.get(lang) or -math.inf) - 2.0 for lang in languages])
    return logs, floor


def with_text_evidence(df: DataFrame, logs: np.ndarray, text: str, out: str = "_ll") -> DataFrame:
    """Add the log-likelihood of the whole text under each language (and its number of trigrams, last)."""
    shared = df.sparkSession.sparkContext.broadcast(logs)

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        rows = np.empty((len(texts), logs_width + 1))
        for i, t in enumerate(texts):
            b = trigram_buckets(t.as_py())
            if len(b) < BUCKETS:
                rows[i, :-1] = shared.value[b].sum(0)
            else:
                rows[i, :-1] = np.bincount(b, minlength=BUCKETS) @ shared.value
            rows[i, -1] = len(b)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * (logs_width + 1), pa.array(rows.ravel()))

    logs_width = logs.shape[1]
    return df.withColumn(out, evidence.asNondeterministic()(F.col(text)))


def argmax_label(scores: Column, languages: Sequence[str], n: int) -> Column:
    """The first language with the highest score."""
    top = F.array_max(F.slice(scores, 1, n))
    return F.array(*[F.lit(x) for x in languages])[(F.array_position(scores, top) - 1).cast("int")]


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, suffix and first path segment (null if absent)."""
    clean = lambda x: F.when(x != "", F.lower(x))
    host = clean(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    segment = clean(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return host, F.element_at(F.split(host, r"\."), -1), segment


def identify(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", declared: str | None = "lang", url: str | None = None,
    host: str | None = "source", languages: Sequence[str] = ("de", "en", "es", "fr"), sample: int = 500, temper: float = 0.5,
    declared_trust: float = 0.9, suffix_trust: float = 0.6, strength: float = 20.0, least: float = 0.5, host_rows: int = 200_000,
    model: tuple[np.ndarray, np.ndarray] | None = None, training: DataFrame | None = None,
) -> DataFrame:
    """Add ``li_lang``, ``li_posterior``, ``li_text_lang`` and ``li_kept``."""
    small_batches(docs.sparkSession)
    languages = sorted(languages)
    n = len(languages)
    logs, floor = model or fit(training or docs, id_col=id_col, text=text, label=declared, languages=languages, sample=sample)
    columns = [c for c in docs.columns if c not in RESULTS]
    docs, names = guarded(docs)
    id_col, text = names[id_col], names[text]
    declared, url, host = (names[c] if c else None for c in (declared, url, host))
    own_host, parent, segment = address_parts(F.col(url)) if url else (F.col(host) if host else F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    base = docs.withColumn("_h", F.coalesce(own_host, F.lit(""))).withColumn("_p", F.coalesce(parent, F.lit(""))).withColumn("_seg", segment)

    def labelled(df: DataFrame) -> DataFrame:
        scored = with_text_evidence(df, logs, text)
        seen = F.element_at("_ll", n + 1) > 0
        return scored.withColumn("li_text_lang", F.when(seen, argmax_label(F.col("_ll"), languages, n)))

    slim = labelled(base.select("_h", "_p", F.col(text)))
    votes = [F.count_if(F.col("li_text_lang") == x).alias(f"_v{i}") for i, x in enumerate(languages)]
    hosts = cut(slim.groupBy("_h", "_p").agg(*votes))
    add = [F.sum(f"_v{i}").alias(f"_w{i}") for i in range(n)]
    parents = hosts.groupBy(F.col("_p").alias("_pp")).agg(*add)
    whole = [x or 0 for x in hosts.agg(*add).first()]
    priors = hosts.join(parents, F.col("_p") == F.col("_pp")).drop("_pp").withColumnsRenamed({"_h": "_hh", "_p": "_hp"})
    priors = cut(priors)
    scored = labelled(base)
    same = (F.col("_h") == F.col("_hh")) & (F.col("_p") == F.col("_hp"))
    if priors.count() <= host_rows:
        joined = scored.join(F.broadcast(priors), same)
    else:  # hosts in their millions: each host's row is copied to some salts, over which a hot host's documents spread
        salts = 16
        salted = priors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = scored.withColumn("_mine", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text)), F.lit(salts)).cast("int"))
        joined = joined.join(salted, same & (F.col("_mine") == F.col("_salt"))).drop("_mine", "_salt")
    own = [F.coalesce((F.col("li_text_lang") == x).cast("int"), F.lit(0)) for x in languages]
    voted = F.col("li_text_lang").isNotNull().cast("int")
    total = lambda p: sum((F.col(f"{p}{i}") for i in range(1, n)), F.col(f"{p}0"))
    scores = []
    for i, x in enumerate(languages):
        corpus = (F.lit(whole[i]) - own[i] + 1) / (F.lit(sum(whole)) - voted + n)
        region = (F.col(f"_w{i}") - own[i] + strength * corpus) / (total("_w") - voted + strength)
        prior = (F.col(f"_v{i}") - own[i] + strength * region) / (total("_v") - voted + strength)
        score = F.element_at("_ll", i + 1) * temper + F.log(prior)
        for said, trust in ((F.lower(F.substring(F.col(declared), 1, 2)) if declared else None, declared_trust), (F.col("_seg"), suffix_trust), (suffix_language(F.col("_p")), suffix_trust)):
            if said is not None:
                known = said.isin(*languages)
                score = score + F.when(known, F.when(said == x, math.log(trust)).otherwise(math.log((1 - trust) / max(1, n - 1)))).otherwise(0.0)
        scores.append(score)
    joined = joined.withColumn("_s", F.array(*scores))
    top = F.array_max("_s")
    joined = joined.withColumn("li_posterior", 1 / F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.exp(s - top)))
    joined = joined.withColumn("_best", (F.array_position("_s", top) - 1).cast("int"))
    count = F.element_at("_ll", n + 1)
    best_mean = F.element_at("_ll", F.col("_best") + 1) / count
    low = F.array(*[F.lit(float(f)) for f in floor])[F.col("_best")]
    joined = joined.withColumn("li_lang", F.when(count > 0, F.array(*[F.lit(x) for x in languages])[F.col("_best")]))
    kept = (count > 0) & (F.col("li_posterior") >= least) & ((count < 50) | (best_mean >= low))
    joined = joined.withColumn("li_kept", F.coalesce(kept, F.lit(False)))
    return joined.select(*[F.col(names[c]).alias(c) for c in columns], *RESULTS)


def suffix_language(suffix: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])[suffix]
