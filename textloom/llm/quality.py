"""Quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and words in repeated 3-word windows of the whole text.
The method's verdict compares three histograms of a document with the reference of its language: characters
by class, the language's commonest words (the rest in one bin), and common against other words alone. References
are sums over all documents of the language. The measure is the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1); a document fails if a distance exceeds its limit and the document is long enough for
that histogram to mean something (minimum-length guards). The limit of the third, which tells foreign and invented
words, has a fixed part for what good documents differ and four standard errors of a share in that many words.

References: every language that a row names, however rare, so a verdict hangs on documents of the same language
only; of each the ``common`` most frequent words, ties by word; exact counts over the whole corpus. Per language
these few numbers reach the driver. Documents that name none, or one without any word, are held against every
reference and judged by the nearest.
Null and empty texts have no words and fail the base rule; texts of any length are read whole, one at a time;
a null language has no reference; ties and repeated rows get equal results; an empty table gives an empty
result. The caller's columns stay; the result is one struct, ``q_rules`` unless ``out`` names it otherwise, which
replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import SPACE_CLASS, small_batches, trim

SYMBOLS = b"#*$%&|<>"
LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER, HIGH = range(8)
CLASSES = 8


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for b in range(256):
        if 97 <= b <= 122:
            table[b] = LOWER
        elif 65 <= b <= 90:
            table[b] = UPPER
        elif 48 <= b <= 57:
            table[b] = DIGIT
        elif b == 32 or 9 <= b <= 13:
            table[b] = SPACE
        elif b in b".,;:!?'\"-()":
            table[b] = STOP
        elif b in SYMBOLS:
            table[b] = SYMBOL
        elif b >= 128:
            table[b] = HIGH
    return table


CLASS_OF = _classes()
LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text as UTF-8."""
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    code = np.frombuffer(b"".join(words), np.uint8)
    chars = int(np.count_nonzero((code & 0xC0) != 0x80))
    symbols = sum(raw.count(bytes([s])) for s in SYMBOLS)
    dup, seen = 0, set()
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        if len(number) < 1 << 21:
            window = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:  # more distinct words than three fit in 63 bits: number the pairs first
            _, pair = np.unique(ids[:-2] << 31 | ids[1:-1], return_inverse=True)
            window = pair.astype(np.int64) << 31 | ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    return n, chars, symbols, dup, repeated


def class_histogram(raw: bytes) -> np.ndarray:
    """Characters by class; a character counts once, by its first byte."""
    b = np.frombuffer(raw, np.uint8)
    return np.bincount(CLASS_OF[b[LEAD[b]]], minlength=CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms along the last axis."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    return np.sqrt(np.maximum(0.0, (part(p) + part(q)) / 2))


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang", common: int = 48) -> dict:
    """Per language: the common words, their counts with the rest last, and the character classes; whole corpus."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    words = known.select("l", F.explode(F.split(F.lower("t"), SPACE_CLASS)).alias("w")).where("w <> ''")
    counts = words.groupBy("l", "w").count()
    rank = Window.partitionBy("l").orderBy(F.col("count").desc(), "w")
    top = counts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= common)
    refs: dict = {}
    for row in top.orderBy("l", "r").collect():
        ref = refs.setdefault(row["l"], {"words": {}, "counts": [], "classes": np.zeros(CLASSES, np.int64), "all": 0})
        ref["words"][row["w"].encode()] = len(ref["counts"])
        ref["counts"].append(row["count"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for x, t in zip(batch.column("l").to_pylist(), batch.column("t"), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                found = np.concatenate((class_histogram(raw), [len(raw.split())]))
                total[x] = total[x] + found if x in total else found
        yield pa.record_batch({"l": pa.array(list(total), pa.string()), "c": pa.array([c.tolist() for c in total.values()], pa.list_(pa.int64()))})

    sums = known.mapInArrow(classes, "l string, c array<long>").select("l", *[F.col("c")[i].alias(f"c{i}") for i in range(CLASSES + 1)])
    for row in sums.groupBy("l").agg(*[F.sum(f"c{i}") for i in range(CLASSES + 1)]).collect():
        if row[0] in refs:
            refs[row[0]]["classes"] = np.array(row[1:-1])
            refs[row[0]]["all"] = row[-1]
    for ref in refs.values():
        ref["counts"] = np.array([*ref["counts"], max(0, ref["all"] - sum(ref["counts"]))], float)
    return dict(sorted(refs.items()))


def judge(raw: bytes, words: list[bytes], lang: str | None, refs: dict) -> tuple[float, float, float]:
    """Distances of character classes, of common words, and of their share to the reference, or to the nearest one."""
    hist = class_histogram(raw).astype(float)
    lowered = None
    best = (2.0, 2.0, 2.0)
    for ref in [refs[lang]] if lang in refs else refs.values():
        if lowered is None:
            lowered = raw.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass").split()
        found = np.zeros(len(ref["counts"]))
        for w in lowered:
            found[ref["words"].get(w, -1)] += 1
        share = distance(two_bins(found), two_bins(ref["counts"]))
        triple = (float(distance(hist, ref["classes"].astype(float))), float(distance(found, ref["counts"])), float(share))
        best = min(best, triple, key=sum)
    return best if best[0] <= 1 else (0.0, 0.0, 0.0)


def two_bins(counts: np.ndarray) -> np.ndarray:
    """Common words against all others."""
    return np.array([counts[:-1].sum(), counts[-1]])


#: Four standard errors of a share of 0.3 in n words, as a distance: 4 sqrt(0.3 * 0.7 / n) / sqrt(8 ln 2 * 0.3 * 0.7).
SHARE_ERRORS = 4 / np.sqrt(8 * np.log(2))


def with_quality(
    docs: DataFrame, refs: dict, *, text: str = "text", lang: str = "lang", out: str = "q_rules", min_words: int = 50, class_limit: float = 0.30, word_limit: float = 0.50,
    share_limit: float = 0.10, class_words: int = 50, word_words: int = 50, share_words: int = 50,
) -> DataFrame:
    """Add the struct ``out``: base counts, ``class_distance``, ``word_distance``, ``share_distance``, ``base_failed``, ``kept``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    distances = ["class_distance", "word_distance", "share_distance"]

    @F.arrow_udf(", ".join([*(f"{x} long" for x in names), *(f"{x} double" for x in distances), "base_failed boolean", "kept boolean"]))
    def measure(texts: pa.Array, langs: pa.Array) -> pa.Array:
        rows = []
        for t, x in zip(texts, langs.to_pylist(), strict=True):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            words = raw.split()
            counts = base_counts(raw, words)
            n, repeated = counts[0], counts[4]
            failed = n < min_words or 100 * repeated > 50 * n
            a, b, c = judge(raw, words, x, shared.value) if n else (0.0, 0.0, 0.0)
            off = n >= class_words and a > class_limit or n >= word_words and b > word_limit or n >= share_words and c > share_limit + SHARE_ERRORS / np.sqrt(n)
            rows.append((*counts, a, b, c, failed, not failed and not off))
        trim()
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_()] * 2
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, [*names, *distances, "base_failed", "kept"])

    return docs.withColumn(out, measure.asNondeterministic()(F.col(text), F.col(lang).cast("string")))
