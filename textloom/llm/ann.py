"""Nearest neighbours by cosine over shifted space-filling curves.

Distinct vectors (a vector that many rows share is searched once) are projected on a few random orthogonal
directions, shifted, and ordered along a Hilbert curve, several times with other directions and shifts. Spark
range-partitions each ordering, of keys without vectors; running ranks cut it into blocks of ``block`` neighbours.
A query meets the block it lies in and the one on either side, on every curve; the windows' best merge and are
reranked by exact cosines of the original vectors in double precision.

The windows alone give high recall only where vectors have structure. So the merged list is then completed: its last
score is a bound; blocks of the first curve, and runs of them called parts, have a cap (mean direction and
smallest cosine to it). A query is sent to the parts whose cap can still beat its bound, and there compared with the
blocks whose cap can. Structured data leave few; data without structure leave most, as for any exact search, and cost
then grows as queries times rows, in bounded blocks, while the vectors shuffled grow as queries times parts.

Scores that are given are sums over the components of two unit vectors, always in the same order, so a pair has
one score whatever block it met in. Ties go to the smaller id, also within a hot group of equal vectors, of which the
``k + 1`` smallest ids suffice.

Vectors that are null, zero or hold null or non-finite components, and rows without id, take no part. Vectors are
compared with those of their own length, one length after the other. Every other row is a candidate, so rows that
repeat an id and its vector count as often as they stand there; rows of the query's own id are no candidates, and an id
asked for with several vectors gets one list, of the nearest to any. Empty tables give empty results; fewer rows than
``k`` give all there are. Columns of the caller never clash: only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, running_totals, shuffle_width

CHUNK = 512
#: Candidates held beyond those asked for while scores come from matrix products, which may differ in the last bits.
SLACK = 4
#: Caps of parts are sent to all tasks up to this size; beyond it every part is asked.
CAPS_BYTES = 64 << 20
MATCH = "q long, qh long, rep long, h long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (rows) with ``bits`` per coordinate (transposed Gray form)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << bits - 1
    while level > 1:
        low = level - 1
        for i in range(dims):
            turn = (x[i] & level) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    level = 1 << bits - 1
    while level > 1:
        parity ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= parity
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def directions(dim: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions [curve, dim, dims] and shifts [curve, dims]."""
    rng = np.random.default_rng(seed)
    dims = min(dim, dims)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dims)))[0] for _ in range(curves)]), rng.uniform(0, 1, (curves, dims))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True) if len(x) else np.ones((0, 1))
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best_of(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the best scores of each row, ties up to rounding to smaller ids."""
    score = np.round(score, 12)
    if score.shape[1] > 8 * keep:
        cutoff = -np.partition(-score, keep - 1, axis=1)[:, keep - 1 : keep]
        score = np.where(score >= cutoff, score, -np.inf)
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)
    return order[:, :keep]


def on_curves(rows: DataFrame, dim: int, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """The Hilbert key of each row (rep, h, v) on each curve."""
    axes, shifts = directions(dim, curves, dims, seed)
    reach = 4.0 / np.sqrt(dim) if dim > 16 else 1.0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v"), dim))
            for c in range(curves):
                place = (x @ axes[c] / reach + 1) / 2 * 0.5 + shifts[c] * 0.5
                cells = np.clip(place * (1 << bits), 0, (1 << bits) - 1)
                key = hilbert_keys(cells, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(key), batch.column("rep"), batch.column("h")], ["curve", "key", "rep", "h"])

    return rows.select("rep", "h", "v").mapInArrow(keys, "curve int, key long, rep long, h long")


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal values in ``names`` of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([np.asarray(batch.column(c)) for c in names], 1)
        edges = [*(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        start = 0
        for end in edges:
            part = batch.slice(start, end - start)
            if held and any(held[0].column(c)[0].as_py() != part.column(c)[0].as_py() for c in names):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            start = end
    if held:
        yield pa.Table.from_batches(held)


class Side:
    """Identities and unit vectors of some rows."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, dim: int):
        self.rep, self.h = np.asarray(rows.column("rep")), np.asarray(rows.column("h"))
        self.x = unit(matrix(rows.column("v"), dim))

    def some(self, chosen: np.ndarray | slice) -> Side:
        out = object.__new__(Side)
        out.rep, out.h, out.x = self.rep[chosen], self.h[chosen], self.x[chosen]
        return out


def compare(queries: Side, held: Side, keep: int, floor: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The best candidates of each query with the score of each pair, those under a query's floor left out."""
    for at in range(0, len(queries.rep), CHUNK):
        q = queries.some(slice(at, at + CHUNK))
        top = best_of(q.x @ held.x.T, held.rep, keep + SLACK)
        rows, found = np.repeat(np.arange(len(top)), top.shape[1]), top.ravel()
        score = (q.x[rows] * held.x[found]).sum(1)
        if floor is not None:
            fine = score >= floor[at : at + CHUNK][rows] - 1e-9
            rows, found, score = rows[fine], found[fine], score[fine]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q.rep[rows], q.h[rows], held.rep[found], held.h[found], score)], ["q", "qh", "rep", "h", "score"])


def window_matches(placed: DataFrame, dim: int, keep: int) -> DataFrame:
    """Queries against the rows of their own and the neighbouring blocks, on each curve."""
    dealt = placed.select(F.posexplode("blocks").alias("curve", "block"), "asked", "rep", "h", "v")
    members = dealt.select("curve", "block", F.lit(False).alias("query"), "rep", "h", "v")
    near = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))
    queries = dealt.where("asked").select("curve", near.alias("block"), F.lit(True).alias("query"), "rep", "h", "v")
    both = members.unionByName(queries).repartition(shuffle_width(placed.sparkSession), "curve", "block").sortWithinPartitions("curve", "block", "query")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["curve", "block"]):
            asks = np.asarray(group.column("query"))
            if asks.any() and not asks.all():
                every = Side(group, dim)
                yield from compare(every.some(asks), every.some(~asks), keep)

    return both.mapInArrow(match, MATCH)


def top_lists(matches: DataFrame, keep: int) -> DataFrame:
    one = matches.groupBy("q", "qh", "rep", "h").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q", "qh").orderBy(F.col("score").desc(), "rep", "h")
    return one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)


def cap(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean direction of some unit vectors, and the smallest cosine to it."""
    mean = x.sum(0)
    size = np.sqrt(mean @ mean)
    mean = mean / size if size > 1e-12 else np.eye(1, x.shape[1])[0]
    return mean, float(np.clip((x @ mean).min(), -1, 1))


def can_beat(queries: np.ndarray, limits: np.ndarray, mean: np.ndarray, least: float) -> np.ndarray:
    """Which queries may find a cosine of at least their limit inside a cap."""
    angle = np.arccos(np.clip(queries @ mean, -1, 1)) - np.arccos(least)
    return np.cos(np.maximum(angle, 0)) >= limits - 1e-9


def part_caps(members: DataFrame, dim: int) -> list[tuple[int, np.ndarray, float]] | None:
    """The cap of every part of rows dealt and sorted by part; nothing if they are too many to send around."""

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part"]):
            mean, least = cap(unit(matrix(group.column("v"), dim)))
            yield pa.record_batch({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "mean": pa.array([mean.tolist()], pa.list_(pa.float64())), "least": pa.array([least])})

    found = cut(members.mapInArrow(caps, "part int, mean array<double>, least double"))
    if found.count() * (8 * dim + 16) > CAPS_BYTES:
        return None
    return [(r["part"], np.array(r["mean"]), r["least"]) for r in found.orderBy("part").collect()]


def cap_matches(placed: DataFrame, lists: DataFrame, dim: int, keep: int, per_task: int) -> DataFrame:
    """Queries against every block whose cap can beat their bound, in the parts whose cap can."""
    spark = placed.sparkSession
    members = placed.select(F.col("blocks")[0].alias("block"), "rep", "h", "v", "asked")
    count, last = members.agg(F.count(F.lit(1)), F.max("block")).first()
    parts = max(1, -(-count // per_task))
    part = F.floor(F.col("block") * parts / F.lit((last or 0) + 1)).cast("int")
    members = cut(members.withColumn("part", part).repartition(min(parts, 4 * shuffle_width(spark)), "part").sortWithinPartitions("part", "block", "rep", "h"))
    caps = part_caps(members, dim) if parts > 1 else None
    bound = lists.groupBy("q", "qh").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
    bound = bound.select("q", "qh", F.when(F.col("n") < keep, F.lit(-2.0)).otherwise(F.col("bound")).alias("bound"))
    asked = members.where("asked").join(bound, (F.col("rep") == F.col("q")) & (F.col("h") == F.col("qh")), "left").select("rep", "h", "v", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    if caps is None:
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "rep", "h", "v", "bound")
    else:
        sent = spark.sparkContext.broadcast(caps)

        @F.arrow_udf("array<int>")
        def wanted(vectors: pa.Array, limits: pa.Array) -> pa.Array:
            x, limit = unit(matrix(vectors, dim)), np.asarray(limits)
            may = np.stack([can_beat(x, limit, mean, least) for _, mean, least in sent.value], 1)
            names = np.array([name for name, _, _ in sent.value], np.int32)
            return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(may.sum(1)))).astype(np.int32), pa.array(np.broadcast_to(names, may.shape)[may]))

        asked = asked.select(F.explode(wanted.asNondeterministic()("v", "bound")).alias("part"), "rep", "h", "v", "bound")
    asked = asked.select("part", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "rep", "h", "v", "bound")
    held = members.select("part", F.lit(0).alias("kind"), "block", "rep", "h", "v", F.lit(0.0).alias("bound"))
    both = held.unionByName(asked).repartition(min(parts, 4 * shuffle_width(spark)), "part").sortWithinPartitions("part", "kind", "block", "rep", "h")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, side, blocks = None, None, []
        building: list[pa.RecordBatch] = []
        for group in sliced(batches):
            kind, here = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
            if here != at:
                at, building, side = here, [], None
            if kind == 0:
                building.append(group)
                continue
            if not building:
                continue
            if side is None:
                table = pa.Table.from_batches(building)
                side, block = Side(table, dim), np.asarray(table.column("block"))
                heads = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)])).tolist()
                blocks = [(slice(a, b), *cap(side.x[a:b])) for a, b in zip(heads[:-1], heads[1:], strict=True)]
            queries, limit = Side(group, dim), np.asarray(group.column("bound"))
            for where, mean, least in blocks:
                may = can_beat(queries.x, limit, mean, least)
                if may.any():
                    yield from compare(queries.some(may), side.some(where), keep, limit[may])

    return both.mapInArrow(match, MATCH)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where part or kind changes and to at most CHUNK rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([np.asarray(batch.column("part")), np.asarray(batch.column("kind"))], 1)
        edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for s in range(a, b, CHUNK):
                yield batch.slice(s, min(b, s + CHUNK) - s)


def valid_vectors(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id`` and ``v`` of rows that take part; vectors of single precision stay so until they are compared."""
    single = isinstance(table.schema[vector].dataType, T.ArrayType) and isinstance(table.schema[vector].dataType.elementType, T.FloatType)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def nearest(
    table: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", query: str | None = None, k: int = 5, curves: int = 4, dims: int = 8, bits: int = 6,
    block: int = 512, per_task: int = 65_536, seed: int = 7, complete: bool = True,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest other rows of each row that meets ``query`` (SQL over ``id``)."""
    rows = valid_vectors(table, id_col, vector)
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in lengths:
        found = found.unionByName(_nearest_of(rows.where(F.size("v") == dim), dim, F.expr(query or "true"), k, curves, dims, bits, block, per_task, seed, complete))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest_of(rows: DataFrame, dim: int, asked_row: Column, k: int, curves: int, dims: int, bits: int, block: int, per_task: int, seed: int, complete: bool) -> DataFrame:
    """Candidates of all queries among the vectors of one length, the ``k`` nearest of each at least."""
    keep = k + 1
    marked = rows.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    # equal vectors meet by two hashes; of each the first few ids stay, and the vector with the first
    order = Window.partitionBy("h", "h2").orderBy("id")
    firsts = marked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).withColumn("rep", F.first("id").over(order))
    firsts = cut(firsts.select("rep", "h", "h2", "id", F.when(F.col("r") == 1, F.col("v")).alias("v")))
    distinct = firsts.where("v is not null").select("rep", "h", "h2", "v")
    asks = marked.where(asked_row).select("id", F.col("h").alias("_h"), F.col("h2").alias("_h2")).distinct()
    asks = cut(asks.join(distinct.select("rep", "h", "h2"), (F.col("_h") == F.col("h")) & (F.col("_h2") == F.col("h2"))).select("id", "rep", "h"))
    marks = asks.select(F.col("rep").alias("_r"), F.col("h").alias("_rh")).distinct()
    keys = running_totals(on_curves(distinct, dim, curves, dims, bits, seed), ["curve"], [F.col("key"), F.col("rep"), F.col("h")], prefix="_c_")
    keys = keys.groupBy(F.col("rep").alias("_k"), F.col("h").alias("_kh")).agg(F.sort_array(F.collect_list(F.struct("curve", F.floor((F.col("_c_rank") - 1) / block).cast("long").alias("block")))).alias("blocks"))
    placed = distinct.join(keys, (F.col("rep") == F.col("_k")) & (F.col("h") == F.col("_kh")))
    placed = placed.join(marks, (F.col("rep") == F.col("_r")) & (F.col("h") == F.col("_rh")), "left")
    placed = cut(placed.select("rep", "h", "v", F.col("blocks.block").alias("blocks"), F.col("_r").isNotNull().alias("asked")))
    lists = cut(top_lists(window_matches(placed, dim, keep), keep))
    if complete:
        more = cap_matches(placed, lists, dim, keep, per_task)
        lists = cut(top_lists(lists.select("q", "qh", "rep", "h", "score").unionByName(more), keep))
    members = firsts.select(F.col("rep").alias("_r"), F.col("h").alias("_rh"), F.col("id").alias("vec_id"))
    pairs = lists.join(members, (F.col("rep") == F.col("_r")) & (F.col("h") == F.col("_rh"))).select("q", "qh", "score", "vec_id")
    asks = asks.select(F.col("id").alias("query_id"), F.col("rep").alias("_q"), F.col("h").alias("_qh"))
    return pairs.join(asks, (F.col("q") == F.col("_q")) & (F.col("qh") == F.col("_qh"))).where("vec_id <> query_id").select("query_id", "vec_id", "score")
