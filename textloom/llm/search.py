"""Ranked lexical search: document-sharded postings with integer impacts, one term at a time.

Every task turns the documents it reads into shards: for the terms of the queries the postings (document of the shard,
occurrences) in rows of one compressed-sparse-row layout, term after term, and each document's length. Shards are written
as a table in the shared folder, so texts are read once. Collection figures (documents with a term, all their
terms, documents of each query term) are aggregates over it. Then every shard computes its postings' integer impacts once and
answers all queries: an item's terms add their impacts to a dense array over the shard's documents, one term after another,
and its best are selected by partition with the ties at the border ordered by document id. A task merges the
shards it has, and a window over the rest gives each item its best.

A shard holds at most ``SHARD_DOCS`` documents and about ``SHARD_POSTINGS`` postings (a document is never split). Items are taken in
blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, a pass over the documents each, so that what is sent to all tasks is bounded
whatever the number of items. No item pairs with a document that shares no term with it.

Terms are the maximal runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased. Scores are 64-bit
integers: with N documents that have a term, L terms in them, n terms in a document, df documents with a term and tf occurrences,
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``, ``m = 75 + (25 n N) div L`` and a term's impact ``w * (10**9 tf div (1000 tf + 12 m))``.

Defined results: a null or empty text has no term; such a document is never found and such an item finds nothing. Every row is a
document and every item row an item of its own, repeated ids or not. Equal scores are ordered by ascending document id, a null
id last; rows equal in score and id follow in no particular order, their rows being the same. An empty table gives an empty
result. Whole texts are read; extra columns are not.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import small_batches
from textloom.plans.session import new_folder

SHARD_DOCS, SHARD_POSTINGS = 32_768, 2_000_000
BLOCK_ITEMS, BLOCK_CHARS = 4096, 16_000_000
#: Fixed values of the score.
SCALE, FLAT, SLOPE, LENGTH = 1_000_000_000, 75, 25, 12
#: Separators become blanks and A-Z lower case; the bytes of other characters stay.
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
SHARD = "n_docs long, total long, ids binary, known binary, lengths binary, offsets binary, docs binary, tfs binary"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(TABLE).split() if text else []


class Shard:
    """Documents that one task has read, until there are enough of them."""

    def __init__(self, size: int):
        self.size, self.ids, self.lengths = size, [], []
        self.term, self.doc, self.tf = [], [], []

    def add(self, doc_id: int | None, words: list[bytes], place: dict[bytes, int]) -> None:
        here = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        for word, times in Counter(words).items():
            term = place.get(word)
            if term is not None:
                self.term.append(term)
                self.doc.append(here)
                self.tf.append(times)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.term) >= SHARD_POSTINGS

    def row(self) -> dict:
        term, doc, tf = np.array(self.term, np.int32), np.array(self.doc, np.uint16), np.array(self.tf, np.int64)
        order = np.argsort(term, kind="stable")
        offsets = np.searchsorted(term[order], np.arange(self.size + 1)).astype(np.int32)
        lengths = np.array(self.lengths, np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        known = np.array([i is not None for i in self.ids], np.bool_)
        arrays = {"ids": ids, "known": known, "lengths": lengths, "offsets": offsets, "docs": doc[order], "tfs": tf[order].astype(np.uint32)}
        return {"n_docs": len(ids), "total": int(lengths.sum()), **{k: v.tobytes() for k, v in arrays.items()}}


SHARD_SCHEMA = pa.schema([("n_docs", pa.int64()), ("total", pa.int64()), *[(n, pa.binary()) for n in ("ids", "known", "lengths", "offsets", "docs", "tfs")]])


def shards(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with at least one term as shards of postings of the terms of ``vocabulary``."""
    place = {t: k for k, t in enumerate(vocabulary)}
    send = docs.sparkSession.sparkContext.broadcast(place)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(len(send.value))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, body in zip(ids, batch.column(1), strict=True):
                words = terms(body.as_py())
                if words:
                    shard.add(doc_id, words, send.value)
                    if shard.full():
                        yield pa.RecordBatch.from_pylist([shard.row()], SHARD_SCHEMA)
                        shard = Shard(len(send.value))
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], SHARD_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(build, SHARD)


def document_counts(index: DataFrame) -> dict[int, int]:
    """Documents of each term that has some, by its number."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for offsets in batch.column(0):
                df = np.diff(np.frombuffer(offsets.as_py(), np.int32)).astype(np.int64)
                total = df if total is None else total + df
        if total is not None:
            term = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"term": term.astype(np.int64), "df": total[term]})

    per = index.select("offsets").mapInArrow(spread, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in per.collect()}  # at most the terms of one block of items


def impacts(tf: np.ndarray, length: np.ndarray, weight: np.ndarray, n: int, total: int) -> np.ndarray:
    m = FLAT + SLOPE * length * n // total
    return weight * (SCALE * tf // (1000 * tf + LENGTH * m))


def best(score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest positive scores, equal ones by id with unknown ids last, in no particular order."""
    found = np.flatnonzero(score)
    if len(found) <= k:
        return found
    reached = score[found]
    border = np.partition(reached, len(found) - k)[len(found) - k]
    over, level = found[reached > border], found[reached == border]
    rest = k - len(over)
    if len(level) > rest:  # the ties at the border, by id
        level = level[np.lexsort((ids[level], ~known[level]))[:rest]]
    return np.concatenate((over, level))


def answer(index: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """Each task's best documents of each item (its number, its terms and their repeats)."""
    send = index.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = send.value
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)  # noqa: B023, E731
                ids, known, lengths, offsets = read("ids", np.int64), read("known", np.bool_), read("lengths", np.int64), read("offsets", np.int32)
                docs, tf = read("docs", np.uint16).astype(np.int32), read("tfs", np.uint32).astype(np.int64)
                gain = impacts(tf, lengths[docs], np.repeat(weights, np.diff(offsets)), n, total)
                score = np.zeros(len(ids), np.int64)
                for number, words, repeats in items:
                    score[:] = 0
                    for word, times in zip(words, repeats, strict=True):
                        low, high = offsets[word], offsets[word + 1]
                        score[docs[low:high]] += gain[low:high] * times
                    top = best(score, ids, known, k)
                    if len(top):
                        new = score[top], ids[top], known[top]
                        held[number] = tuple(np.concatenate(p) for p in zip(held[number], new, strict=True)) if number in held else new
                        if len(held[number][0]) > 8 * k:
                            held[number] = _merged(held[number], k)
        for number, found in held.items():
            score, ids, known = _merged(found, k)
            yield pa.RecordBatch.from_pydict({"item": pa.array([number] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=~known), "score": pa.array(score, pa.int64())})

    return index.drop("n_docs", "total").mapInArrow(search, "item long, doc_id long, score long")


def _merged(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    top = best(*found, k)
    return tuple(part[top] for part in found)


def blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The items in bounded blocks."""
    block, chars = [], 0
    for item, body in items.select(F.col(id_col).cast("long"), F.col(text).cast("binary")).toLocalIterator():
        body = bytes(body or b"")
        if block and (len(block) >= BLOCK_ITEMS or chars + len(body) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((item, body))
        chars += len(body)
    if block:
        yield block


def search(items: DataFrame, docs: DataFrame, k: int = 20, *, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for block in blocks(items, item_id, item_text):
        found = _search_block(spark, block, docs, k, doc_id, doc_text)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.withColumnRenamed("item_id", item_id) if item_id != "item_id" else out


def _search_block(spark: SparkSession, block: list, docs: DataFrame, k: int, doc_id: str, doc_text: str) -> DataFrame:
    words = [Counter(terms(body)) for _, body in block]
    vocabulary = sorted(set().union(*words))
    folder = new_folder(spark)
    shards(docs, vocabulary, doc_id, doc_text).write.parquet(folder)
    index = spark.read.schema(SHARD).parquet(folder)
    facts = index.agg(F.sum("n_docs").alias("n"), F.sum("total").alias("total")).first()
    n, total = facts["n"] or 0, facts["total"] or 1
    df = document_counts(index)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = [(i, np.array([place[t] for t in c if df.get(place[t])], np.int64), np.array([r for t, r in c.items() if df.get(place[t])], np.int64)) for i, c in enumerate(words)]
    top = answer(index, asked, weights, n, total, k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
