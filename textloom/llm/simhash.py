"""SimHash near-duplicate detection over a Gray-order hierarchical index.

A document's fingerprint is the bitwise majority of the XXH64 (seed 42) values of its word shingles.
Distinct fingerprints, not documents, are searched: exact copies meet in one grouped aggregation.

Search within ``radius`` differing bits:

* the free bits are split into ``radius + 1`` parts; two linked fingerprints agree on one part at least,
  so each fingerprint is dealt once per part to the bucket of those that share its bits there. A bucket
  over ``bucket_limit`` is dealt again by parts of its still free bits, which loses no pair, until at most
  log2(bucket_limit) bits are free or there are 4,096 kinds of buckets. At radius 2 the former comes first (81 kinds),
  so no bucket exceeds the limit. At radius 7 a bucket of over 8,192 fingerprints may be left after four levels,
  with 37 bits free: one task searches it, in memory in proportion to the bucket;
* inside a bucket, fingerprints are sorted by Gray rank, so neighbours share long bit patterns. Each node
  of the tree over that order keeps the mask of bits shared by all below it and not yet by its parent,
  and their pattern. A query walks down adding the differences found in each node's mask and leaves a whole
  group as soon as the sum exceeds the radius;
* a bucket gives a star of links per component found in it, not its pairs; pairs are folded into labels some queries
  at a time, and what is connected already is not compared.

``near_duplicates`` links fingerprints at the radius alone. In ``similar_documents`` the fingerprint only proposes: it is
then made of single words of some length, which edits hardly move, twice with independent hashes, at a wider
radius, and a 512-bit SimHash of five-word shingles sorts out most of what is far off. A pair is linked only if the
Jaccard similarity of its five-word shingle sets (64-bit values) is at least ``similar``, counted exactly.

Fingerprints miss pairs with a replaced, appended or missing passage, so a second path covers the rest. Bands of three
min-hashes propose each band's most popular document to its others, which settles large groups without pairs of all. Then an
exact search: of sets in one common order, rare shingles first, two that are similar share one of the first
``n - ceil(similar n) + 1``. Documents meet by those; pairs linked already go, so do those whose sizes and places rule it
out, and those whose sketches of 128 bits differ by five standard errors more than similar sets' do (about three similar pairs
in ten million, for which alone, and for equal hashes, the search is not complete); the others are compared in full.
A pair that shares one of its first four shingles is proposed once, by that. Where many texts of one family meet, some central ones are
compared with the others first, in two rounds; what they link needs no comparison with the whole family, and the last round has the rest.

Null and empty texts have no word and the fingerprint zero, which links like any other (without a word, texts are
similar to each other only). Texts of any length are read whole, one at a time. Ties cannot occur: a component's id is
its smallest doc_id, its representative that row, of rows that share the id the one with the smallest text hash.
Repeated rows get equal results; of rows equal in id and text one is kept. Rows that share an id, or have none, are
documents of their own, told apart by their text; a component of rows without id has a null id and keeps one of them.
An empty table gives an empty result. Columns of the caller never clash: only id and text are read, and
``keep_representatives`` returns the caller's columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import connected_components, cut, guarded, shuffle_width, small_batches, trim

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 15
LEAF = 32
FANOUT = 8
FRONTIER = 500_000


def shingle_fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n < width:
        spans, line, ends = 1, b" ".join(words), None
    else:
        spans, line = n - width + 1, b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    del words
    if ends is None:
        return xxhash.xxh64_intdigest(line, seed)
    starts = np.concatenate(([0], ends[:-1]))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, spans, BLOCK):
        cutoff = min(spans, at + BLOCK)
        a, b = starts[at:cutoff].tolist(), (ends[at + width - 1 : cutoff + width - 1] - 1).tolist()
        hashes = np.array([digest(line[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > spans, bitorder="little").view(np.uint64)[0])


SIGNATURE_WORDS = 8
#: Odd multipliers that draw further hash words from a digest's two.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def signature(text: str | None, width: int = 5) -> bytes:
    """A 512-bit SimHash of the word shingles, to estimate similarity."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return bytes(8 * SIGNATURE_WORDS)
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = np.zeros(64 * SIGNATURE_WORDS, np.int64)
    for at in range(0, len(shingles), BLOCK // 8):
        some = shingles[at : at + BLOCK // 8]
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, some)), np.uint64).reshape(-1, 2, 1)
        lanes = lanes * MIX
        lanes = (lanes ^ lanes >> np.uint64(29)) * MIX[::-1]
        lanes = (lanes ^ lanes >> np.uint64(32)).reshape(len(some), SIGNATURE_WORDS)
        ones += np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles)).tobytes()


def content_fingerprints(text: str | None, letters: int = 5) -> tuple[int, int]:
    """Two independent 64-bit SimHashes of the words of at least ``letters`` bytes; of all words where there are under eight such."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    chosen = [w for w in words if len(w) >= letters]
    if len(chosen) < 8:
        chosen = words
    if not chosen:
        return 0, 0
    ones = np.zeros(128, np.int64)
    for at in range(0, len(chosen), BLOCK):
        raw = b"".join(map(xxhash.xxh3_128_digest, chosen[at : at + BLOCK]))
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    first, second = np.packbits(ones * 2 > len(chosen)).view(np.uint64).tolist()
    return first, second


def signature_limit(similar: float, bits: int = 64 * SIGNATURE_WORDS) -> int:
    """Differing signature bits up to which a pair may have the asked Jaccard similarity, with two standard errors."""
    share = np.arccos(2 * similar / (1 + similar)) / np.pi
    return int(bits * share + 2 * np.sqrt(bits * share * (1 - share)))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "_fp", width: int = 3) -> DataFrame:
    """Add the signed 64-bit fingerprint of ``text``."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = np.fromiter((shingle_fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return docs.withColumn(out, fingerprint.asNondeterministic()(F.col(text)))


# ---- the index inside one bucket ----


def build_tree(sorted_fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the top: (mask of newly shared bits, their pattern, first child) of each node; the last level is the fingerprints."""
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    level_and, level_or, widths = [sorted_fps], [sorted_fps], []
    step = LEAF
    while len(level_and[-1]) > 1:
        at = np.arange(0, len(level_and[-1]), step)
        level_and.append(np.bitwise_and.reduceat(level_and[-1], at))
        level_or.append(np.bitwise_or.reduceat(level_or[-1], at))
        widths.append(step)
        step = FANOUT
    levels, above = [], np.zeros(1, np.uint64)
    parent_width = 1
    for depth in range(len(level_and) - 1, -1, -1):
        low, high = level_and[depth], level_or[depth]
        shared = ~(low ^ high) & every
        parents = np.repeat(above, parent_width)[: len(low)] if depth < len(level_and) - 1 else np.zeros(len(low), np.uint64)
        levels.append((shared & ~parents, low, np.arange(len(low)) * (widths[depth - 1] if depth else 1)))
        above, parent_width = shared, widths[depth - 1] if depth else 1
    return levels


def tree_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of Gray-sorted fingerprints at most ``radius`` bits apart, some queries at a time."""
    levels = build_tree(fps)
    widths = [LEAF if d == len(levels) - 2 else FANOUT for d in range(len(levels) - 1)]
    block = max(1, min(1024, FRONTIER // len(fps)))  # bounds what a level can hold if nothing is pruned
    for at in range(0, len(fps), block):
        query = np.arange(at, min(len(fps), at + block))
        q, node, acc = query, np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        for depth, (mask, pattern, first) in enumerate(levels):
            acc = acc + np.bitwise_count((fps[q] ^ pattern[node]) & mask[node])
            keep = acc <= radius
            q, node, acc = q[keep], node[keep], acc[keep]
            if depth < len(levels) - 1:
                fan, below = widths[depth], len(levels[depth + 1][0])
                child = first[node][:, None] + np.arange(fan)
                real = child < below
                count = real.sum(1)
                q, acc, node = np.repeat(q, count), np.repeat(acc, count), child[real]
                # pairs are found once, from the smaller index: nodes wholly before the query are of no use
                if depth == len(levels) - 2:
                    later = node > q
                    q, acc, node = q[later], acc[later], node[later]
        yield q, node


def fold(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (the smallest index known to be reachable) after some more pairs; the pairs themselves need not be kept."""
    left, right = label[left], label[right]
    while True:
        open_pairs = left != right
        if not open_pairs.any():
            return label
        left, right = left[open_pairs], right[open_pairs]
        new = label.copy()
        np.minimum.at(new, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new
        left, right = label[left], label[right]


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int, sig_limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and Gray rank to links (a, b) that connect what each bucket's pairs connect.

    Without signatures a node is its fingerprint; with them, its signature.
    """

    def near(sigs: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if sigs is None or not len(i):
            return np.ones(len(i), bool)
        return np.bitwise_count(sigs[i] ^ sigs[j]).sum(1, dtype=np.int64) <= sig_limit

    def links(mask: np.ndarray, bits: np.ndarray, fps: np.ndarray, sigs: np.ndarray | None) -> pa.RecordBatch:
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
        start = np.concatenate(([0], edge))
        length = np.diff(np.concatenate((start, [len(fps)])))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(length <= LEAF, length)
        group = np.repeat(np.arange(len(start)), length)
        for gap in range(1, min(LEAF, len(fps))):  # a bucket of one leaf is scanned, together with all other such buckets
            at = np.flatnonzero(small[:-gap] & (group[:-gap] == group[gap:]))
            if not len(at):
                break
            at = at[np.bitwise_count(fps[at] ^ fps[at + gap]) <= radius]
            at = at[near(sigs, at, at + gap)]
            a.append(at + gap)
            b.append(at)
        for g in np.flatnonzero(length > LEAF):
            own = fps[start[g] : start[g] + length[g]]
            label = np.arange(len(own))
            for left, right in tree_pairs(own, radius):
                apart = label[left] != label[right]  # what is connected already needs no comparison
                left, right = left[apart], right[apart]
                fine = near(sigs, left + start[g], right + start[g])
                label = fold(label, left[fine], right[fine])
            tied = np.flatnonzero(label != np.arange(len(own)))
            a.append(tied + start[g])
            b.append(label[tied] + start[g])
        ends = [np.concatenate(x) for x in (a, b)]
        if sigs is None:
            return pa.record_batch({n: fps[x].view(np.int64) for n, x in zip("ab", ends, strict=True)})
        return pa.record_batch({n: node_bytes(sigs[x]) for n, x in zip("ab", ends, strict=True)})

    held: list[np.ndarray] = [np.zeros(0, np.uint64)] * 3
    held_sigs = np.zeros((0, SIGNATURE_WORDS), np.uint64)
    for batch in batches:
        new = [np.asarray(batch.column(k)).view(np.uint64) for k in ("mask", "bits", "fp")]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        if sig_limit is not None:
            held_sigs = np.concatenate((held_sigs, np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, SIGNATURE_WORDS)))
        ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(ends):
            done = ends[-1] + 1
            yield links(*(x[:done] for x in held), held_sigs[:done] if sig_limit is not None else None)
            held, held_sigs = [x[done:] for x in held], held_sigs[done:]
    if len(held[2]):
        yield links(*held, held_sigs if sig_limit is not None else None)
    trim()


def node_bytes(sigs: np.ndarray) -> pa.Array:
    """Signatures as binary values."""
    offsets = np.arange(len(sigs) + 1, dtype=np.int32) * (8 * SIGNATURE_WORDS)
    return pa.Array.from_buffers(pa.binary(), len(sigs), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(sigs).tobytes())])


# ---- the distributed search ----


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_bits(mask: int, parts: int) -> list[int]:
    """The mask widened by each of ``parts`` runs of its free bits, from the top."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(parts) if cuts[i] < cuts[i + 1]]


#: Buckets are dealt again while their kinds are no more than this.
MASKS = 4096


def near_links(fps: DataFrame, radius: int = 2, bucket_limit: int = 8192, sig_limit: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` over distinct ``fp`` (and ``sig``) that connect all within ``radius`` bits (and the signature's limit)."""
    spark = fps.sparkSession
    masks, dealt = [0], []
    kept = ["fp"] if sig_limit is None else ["fp", "sig"]
    work = fps.select(*kept, F.lit(0).cast("long").alias("mask"))
    while True:
        pairs = [(m, c) for m in masks for c in split_bits(m, radius + 1)]
        masks = sorted({c for _, c in pairs})
        children = spark.createDataFrame([(_signed(m), _signed(c)) for m, c in pairs], "mask long, child long")
        work = work.join(F.broadcast(children), "mask").select(*kept, F.col("child").alias("mask"))  # at most MASKS rows
        work = work.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        free = 64 - min(m.bit_count() for m in masks)
        if 1 << free <= bucket_limit or len(masks) * (radius + 1) > MASKS:
            dealt.append(work)
            break
        hot = cut(work.groupBy("mask", "bits").count().where(F.col("count") > bucket_limit).select("mask", "bits"))
        if hot.isEmpty():
            dealt.append(work)
            break
        dealt.append(work.join(hot, ["mask", "bits"], "left_anti"))
        work = cut(work.join(hot, ["mask", "bits"], "left_semi"))
    rows = dealt[0]
    for more in dealt[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("rank", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    for shift in (1, 2, 4, 8, 16, 32):  # the position in Gray order is the running parity from the top
        rows = rows.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", shift)))
    rows = rows.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))
    rows = rows.repartition(shuffle_width(spark), "mask", "bits").sortWithinPartitions("mask", "bits", "rank")
    kind = "long" if sig_limit is None else "binary"
    return rows.select("mask", "bits", *kept).mapInArrow(lambda batches: bucket_links(batches, radius, sig_limit), f"a {kind}, b {kind}")


# ---- the exact path: five-word shingle sets ----

#: Odd multipliers by the place of a word in its shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: To learn which shingles are common: documents read (one in THIN of them, if that is more), the count from which one is, how many are kept.
SAMPLE, THIN, COMMON, COMMON_KEPT = 20_000, 32, 4, 200_000
SLOT_BITS, DROP_BITS = 22, 24


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit values of the word shingles; a shorter text is one shingle, a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    spans, wide = max(1, len(words) - width + 1), min(width, len(words))
    mixed = np.full(spans, wide, np.uint64)
    for k in range(wide):
        mixed = (mixed ^ hashes[k : k + spans]) * PLACES[k]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


#: Min-hashes of a shingle set: so many, from odd multipliers and masks drawn once; bands of ROWS of the first BANDS * ROWS.
HASHES, BANDS, ROWS = 128, 8, 3
SKETCH = [f"sk{k}" for k in range(HASHES // 64)]
_draw = np.random.default_rng(5).integers(0, 1 << 63, (2, HASHES), np.uint64)
FACTORS, FLIPS = _draw[0] << np.uint64(1) | np.uint64(1), _draw[1]
#: Rows of the search; ``pack`` holds the shingle's place and the number of shingles.
COLUMNS = ["v", "node", "root", "pack", "early", "next", *SKETCH]
#: Central rows that a bucket with many pairs compares with its others, by round (in the last, all), and partners below which none is central.
HUBS, FEW = [8, 8, None], 8
#: Differing bits of two sketches, at most, of a pair that is ``similar``: the mean and this many standard errors.
ERRORS = 5


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        out = np.minimum(out, ((shingles[at : at + 2048, None] ^ FLIPS) * FACTORS).min(0))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of each min-hash, in two words; bits differ with half the probability that the sets differ there."""
    return np.packbits((hashes >> np.uint64(23) & np.uint64(1)).astype(np.uint8)).view(np.uint64)


def sketch_limit(similar: float) -> int:
    share = (1 - similar) / 2
    return int(HASHES * share + ERRORS * np.sqrt(HASHES * share * (1 - share)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys that similar sets share often: each of a few min-hashes."""
    few = hashes[: BANDS * ROWS].reshape(BANDS, ROWS)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        mixed = (mixed ^ few[:, k]) * PLACES[k]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def node_of(shingles: np.ndarray) -> int:
    """The signed 64-bit value that stands for a shingle set."""
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes()))


def rare_first(shingles: np.ndarray, common: np.ndarray, similar: float) -> np.ndarray:
    """As many shingles, in one order for all sets, that two sets at least ``similar`` share one of them.

    The order is by value with the ``common`` ones (ascending in ``common``'s own order) at the end.
    """
    n = len(shingles)
    take = n - int(np.ceil(similar * n - 1e-9)) + 1
    place = np.searchsorted(common["value"], shingles)
    place[place == len(common)] = 0
    hot = common["value"][place] == shingles if len(common) else np.zeros(n, bool)
    if n - int(hot.sum()) >= take:
        return shingles[~hot][:take]
    return np.concatenate((shingles[~hot], shingles[hot][np.argsort(common["order"][place[hot]], kind="stable")]))[:take]


def common_shingles(texts: DataFrame, documents: int) -> np.ndarray:
    """The shingles common in a sample, sorted by value, with their place from rare to common. Only speed hangs on the choice."""
    some = texts.where(F.pmod(F.xxhash64("_text"), F.lit(min(THIN, max(1, documents // SAMPLE)))) == 0)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch({"v": pa.array(shingle_set(t.as_py()).view(np.int64))})

    counts = some.mapInArrow(values, "v long").groupBy("v").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.col("count").desc(), "v").limit(COMMON_KEPT).toArrow()
    out = np.zeros(found.num_rows, [("value", np.uint64), ("order", np.int64)])
    out["value"] = found.column("v").to_numpy().view(np.uint64)
    out["order"] = np.arange(found.num_rows, 0, -1)
    return np.sort(out, order="value")


def bucket_pairs(batches: Iterator[pa.RecordBatch], similar: float, hubs: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (v, node, root, place and n in one, the first four v, two sketch words) sorted by v to pairs of one v in different roots whose sizes, places and sketches allow the similarity.

    A pair is a row without v, its nodes in ``node`` and ``root``. A bucket with more than ``hubs`` such pairs a row gives only those of the
    ``hubs`` rows whose sketches are nearest to their partners', and gives its rows back for a later round, which knows more links; without
    ``hubs`` it gives all.
    """
    limit = sketch_limit(similar)

    def allowed(v: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root, pack = rows[1:3]
        early = [x for two in rows[3:5] for x in (two >> 32 & 0xFFFFFFFF, two & 0xFFFFFFFF)]
        place, n = pack >> 32, pack & 0xFFFFFFFF
        words = rows[5:].view(np.uint64)  # bits of a negative number would be those of its absolute value
        room = 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1)
        size = n[i] + n[j]
        ok = (root[i] != root[j]) & (room * (1 + similar) >= similar * size - 1e-6)
        # what comes before the first shingle that two sets share is in one of them only, which leaves little room
        ok &= (place[i] + place[j]) * (1 + similar) <= (1 - similar) * size + 1e-6
        at = np.flatnonzero(ok)
        i, j = i[at], j[at]
        # a pair that shares one of its first four shingles is proposed by the first such alone
        here, ok, decided = v[i] & 0xFFFFFFFF, np.ones(len(i), bool), np.zeros(len(i), bool)
        for mine in early:
            shared = ~decided & np.logical_or.reduce([mine[i] == theirs[j] for theirs in early])
            ok[shared] = (here == mine[i])[shared]
            decided |= shared
        at, i, j = at[ok], i[ok], j[ok]
        apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)
        return at[apart <= limit], apart[apart <= limit]

    def pairs(v: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(v[1:] != v[:-1]) + 1
        start = np.concatenate(([0], edge))
        length = np.diff(np.concatenate((start, [len(v)])))
        reach = np.repeat(start + length, length)  # the end of each row's bucket
        bucket = np.repeat(np.arange(len(start)), length)
        most = int(length.max())
        many, met, near = np.zeros(len(start), bool), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        left, right, held = [], [], 0
        at = np.arange(len(v))
        for gap in range(1, most):
            at = at[at + gap < reach[at]]
            if not len(at):
                break
            fine, apart = allowed(v, rows, at, at + gap)
            i, j = at[fine], at[fine] + gap
            if hubs is not None:
                for x in (i, j):  # each holds a row once
                    met[x] += 1
                    near[x] += limit + 1 - apart
                many = np.add.reduceat(met, start) > 2 * hubs * length
                i, j = i[~many[bucket[i]]], j[~many[bucket[i]]]
            left.append(i)
            right.append(j)
            held += len(i)
            if held > FRONTIER:
                yield made(rows, left, right, many[bucket])
                left, right, held = [], [], 0
        yield made(rows, left, right, many[bucket])
        for b in np.flatnonzero(many):
            own = start[b] + np.flatnonzero(met[start[b] : start[b] + length[b]])
            yield pa.record_batch([pa.array(v[own]), *map(pa.array, rows[:, own])], names=COLUMNS)
            for hub in own[np.argsort(-near[own] / (met[own] + FEW), kind="stable")[:hubs]]:
                i = np.full(len(own), hub)
                fine, _ = allowed(v, rows, i, own)
                yield made(rows, [i[fine]], [own[fine]])

    def made(rows: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], later: np.ndarray | None = None) -> pa.RecordBatch:
        i, j = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (left, right))
        if later is not None:  # what was held of a bucket before it proved to have many
            i, j = i[~later[i]], j[~later[i]]
        x, y = rows[0, i], rows[0, j]
        both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
        return pa.record_batch([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), *[pa.nulls(len(both), pa.int64())] * (len(COLUMNS) - 3)], names=COLUMNS)

    held_v, held = np.zeros(0, np.int64), np.zeros((len(COLUMNS) - 1, 0), np.int64)
    for batch in batches:
        held_v = np.concatenate((held_v, np.asarray(batch.column("v"))))
        held = np.concatenate((held, np.stack([np.asarray(batch.column(k)) for k in COLUMNS[1:]])), axis=1)
        ends = np.flatnonzero(held_v[1:] != held_v[:-1])
        if len(ends):
            done = ends[-1] + 1
            yield from pairs(held_v[:done], held[:, :done])
            held_v, held = held_v[done:], held[:, done:]
    if len(held_v):
        yield from pairs(held_v, held)
    trim()


def shingle_rows(nodes: DataFrame) -> DataFrame:
    """A row of ``COLUMNS`` for each rare shingle of each node (``node``, ``n``, ``vs``, ``sk``), each node its own root."""
    # the first four shingles, 32 bits of each; a shorter list names its first again
    part = lambda k: F.coalesce(F.get("vs", F.lit(k)), F.col("vs")[0]).bitwiseAND(F.lit(0xFFFFFFFF))
    two = lambda k: F.shiftleft(part(k), 32).bitwiseOR(part(k + 1))
    rows = nodes.select("node", "n", "sk", two(0).alias("early"), two(2).alias("next"), F.posexplode("vs").alias("place", "v"))
    pack = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("n"))
    return rows.select("v", "node", F.col("node").alias("root"), pack.alias("pack"), "early", "next", *[F.col("sk")[k].alias(c) for k, c in enumerate(SKETCH)])


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the root of each node by now."""
    rows = rows.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("node") == F.col("_node"), "left")
    return rows.select(*[F.coalesce("_root", "node").alias("root") if c == "root" else F.col(c) for c in COLUMNS])


def shared_pairs(rows: DataFrame, similar: float, hubs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a``, ``b`` of nodes that may be ``similar`` and have no root in common yet, and the rows whose pairs are left to a later round."""
    rows = rows.repartition(shuffle_width(rows.sparkSession), "v").sortWithinPartitions("v")
    made = cut(rows.mapInArrow(lambda batches: bucket_pairs(batches, similar, hubs), ", ".join(f"{c} long" for c in COLUMNS)))
    return made.where("v is null").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), made.where("v is not null")


def searched(texts: DataFrame, keys: DataFrame, nodes: DataFrame, sure: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """All links and the roots they make: those known and those of the exact search.

    Where a bucket has many pairs, its rows meet some central ones first: what gets linked by them needs no comparison with all others of the
    same family. A round's pairs are in proportion to its rows at most, but in the last, which has all pairs that are left.
    """
    roots = connected_components(sure, "a", "b")
    rows = shingle_rows(nodes)
    for hubs in HUBS:
        pairs, rows = shared_pairs(with_roots(rows, roots), similar, hubs)
        more = verified(texts, keys, cut(pairs), similar)
        if not more.isEmpty():
            sure = sure.union(more)
            roots = cut(connected_components(sure, "a", "b"))
        if rows.isEmpty():
            break
    return sure, roots


def band_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of each band's most popular node, that with the fullest bands, and each other node of the band.

    Of texts copied from one with edits of their own, that one is alike to all, and the others are less so to each other.
    """
    rows = nodes.select(F.explode("bands").alias("band"), "node")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("band", "_band")
    rows = cut(rows.join(sizes, F.col("band") == F.col("_band")).select("band", "node", "size"))
    popular = rows.groupBy(F.col("node").alias("_node")).agg(F.sum("size").alias("weight"))
    heads = rows.join(popular, F.col("node") == F.col("_node")).groupBy(F.col("band").alias("_band")).agg(F.max(F.struct("weight", "node"))["node"].alias("head"))
    return rows.join(heads, F.col("band") == F.col("_band")).where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))


def slot_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A table of at most 2**(bits - 6) rows ``word``, ``held``: the 64-bit words of a bitmap of the keys' first bits."""
    slot = F.shiftrightunsigned(key, 64 - bits)
    return keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {64 - bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))


def verified(texts: DataFrame, keys: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least ``similar``.

    ``texts`` are (``_text``, ``_th``), a text and its hash; ``keys`` give the hash ``th`` of one text of each node.
    """
    # texts of no pair are not read into sets, up to those that share a slot with one that is
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = slot_words(nodes.join(keys, F.col("node") == F.col("self")), "th", SLOT_BITS).toArrow()
    wanted = np.zeros(1 << SLOT_BITS - 6, np.uint64)
    wanted[asked.column("word").to_numpy()] = asked.column("held").to_numpy().view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(sent.value.view(np.uint8), bitorder="little").astype(bool), set()
        for batch in batches:
            slots = batch.column("_th").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - SLOT_BITS)
            texts_here, found, values = batch.column("_text"), [], []
            for k in np.flatnonzero(bits[slots.astype(np.int64)]).tolist():
                shingles = shingle_set(texts_here[k].as_py())
                node = node_of(shingles)
                if node not in seen:
                    seen.add(node)
                    found.append(node)
                    values.append(shingles.tobytes())
            yield pa.record_batch({"node": pa.array(found, pa.int64()), "values": pa.array(values, pa.binary())})
        trim()

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            one, two = (np.frombuffer(z.as_buffer(), np.uint64) for z in (p, q))
            both = len(np.intersect1d(one, two, assume_unique=True))
            out.append(both >= similar * (len(one) + len(two) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    # dealt by node once, which both joins read
    known = texts.mapInArrow(sets, "node long, values binary").dropDuplicates(["node"])
    first, second = known.toDF("_a", "_x"), known.toDF("_b", "_y")
    held = pairs.join(first, F.col("a") == F.col("_a")).join(second, F.col("b") == F.col("_b"))
    return cut(held.where(alike.asNondeterministic()(F.col("_x"), F.col("_y"))).select("a", "b"))


def text_hash(text: str) -> Column:
    """A null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _similar_nodes(docs: DataFrame, id_col: str, text: str, similar: float, radius: int, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``_id``, ``th``, ``self``: text hash and node of each document) and the roots of linked nodes."""

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).alias("_text"), text_hash(text).alias("_th"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, docs.count()))  # at most COMMON_KEPT

    @F.arrow_udf("fps array<long>, sig binary, self long, n long, vs array<long>, sk array<long>, bands array<long>")
    def prints(texts: pa.Array) -> pa.Array:
        pairs, sketches, keys = (np.zeros((len(texts), k), np.uint64) for k in (2, len(SKETCH), BANDS))
        signatures, nodes, sizes, values = [], [], [], []
        for i, t in enumerate(texts):
            value = t.as_py()
            pairs[i] = content_fingerprints(value)
            signatures.append(signature(value))
            shingles = shingle_set(value)
            nodes.append(node_of(shingles))
            sizes.append(len(shingles))
            values.append(rare_first(shingles, common.value, similar).view(np.int64))
            hashes = min_hashes(shingles)
            sketches[i], keys[i] = sketch(hashes), bands(hashes)
        trim()
        fps, sk, banded = (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in (pairs, sketches, keys))
        columns = [fps, pa.array(signatures, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64())), sk, banded]
        return pa.StructArray.from_arrays(columns, ["fps", "sig", "self", "n", "vs", "sk", "bands"])

    signed = docs.select(F.col(id_col).alias("_id"), text_hash(text).alias("th"), prints.asNondeterministic()(F.col(text)).alias("_x"))
    signed = cut(signed.select("_id", "th", "_x.*"))
    keys = cut(signed.groupBy("self").agg(F.min("th").alias("th")))
    asked = signed.groupBy("sig", "fps").agg(F.count(F.lit(1))).select(F.explode("fps").alias("fp"), "sig")
    links = near_links(asked, radius, bucket_limit, signature_limit(similar)).where("a <> b").distinct()
    # signatures only propose: their nodes are compared, and so are nodes of one signature
    heads = cut(signed.groupBy("sig").agg(F.min("self").alias("head")))
    named = links.join(heads.toDF("a", "_x"), "a").join(heads.toDF("b", "_y"), "b").select(F.col("_x").alias("a"), F.col("_y").alias("b"))
    twins = signed.select("sig", "self").distinct().join(heads, "sig").where("self <> head").select(F.col("head").alias("a"), F.col("self").alias("b"))
    nodes = signed.where("n > 0").withColumnRenamed("self", "node")
    banded = nodes.select("node", "bands").dropDuplicates(["node"])
    sure = verified(texts, keys, cut(named.union(twins).union(band_pairs(banded)).distinct()), similar)
    # what the fingerprints do not propose: pairs that share a shingle of those that cannot all differ
    nodes = nodes.select("node", "n", "vs", "sk").dropDuplicates(["node"])
    _, roots = searched(texts, keys, nodes, sure, similar)
    return signed.select("_id", "th", "self"), cut(roots)


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", similar: float = 0.8, radius: int = 7, bucket_limit: int = 8192) -> DataFrame:
    """One row per document: id and ``component_id`` (smallest id reachable) over pairs at least ``similar`` in five-word shingles."""
    signed, roots = _similar_nodes(docs, id_col, text, similar, radius, bucket_limit)
    groups = signed.groupBy("self").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return _labelled(signed.select("_id", "self"), cut(groups), roots, id_col).drop("self")


def _labelled(signed: DataFrame, groups: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Component ids of rows (``_id``, ``self``) from groups of equal nodes and the roots of linked ones."""
    tied = groups.join(roots, F.col("self") == F.col("node"), "left").select("self", "least", "n", F.coalesce("root", "self").alias("root"))
    whole = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    # single documents need no look-up; what is left is joined by node, and a hot one is split by the adaptive join
    label = tied.join(whole, "root").where("n > 1 or component_id is distinct from least")
    label = label.select(F.col("self").alias("_node"), "component_id")
    out = signed.join(label, F.col("self") == F.col("_node"), "left")
    known = F.when(F.col("_node").isNotNull(), F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), "self", known.alias("component_id"))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, bucket_limit: int = 8192
) -> DataFrame:
    """One row per document: id, ``fp`` (signed fingerprint), ``component_id`` (smallest id reachable)."""
    small_batches(docs.sparkSession)
    signed = cut(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", "fp", width).select("_id", "fp"))
    fps = cut(signed.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(near_links(fps.select("fp"), radius, bucket_limit), "a", "b")
    groups = fps.withColumnRenamed("fp", "self")
    return _labelled(signed.withColumnRenamed("fp", "self"), groups, roots, id_col).withColumnRenamed("self", "fp")


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", similar: float = 0.8, radius: int = 7, bucket_limit: int = 8192) -> DataFrame:
    """One row of each component of similar documents: that with the smallest id (null last), then the smallest text hash.

    Rows are told apart by id and text: rows that share an id, or have none, but differ in text are different documents.
    """
    signed, roots = _similar_nodes(docs, id_col, text, similar, radius, bucket_limit)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "th")).alias("first")
    per_node = signed.groupBy("self").agg(first)
    per_root = per_node.join(roots, F.col("self") == F.col("node"), "left").groupBy(F.coalesce("root", "self").alias("root")).agg(F.min("first").alias("first"))
    chosen = per_root.select(F.col("first.id").alias("_found"), F.col("first.th").alias("_hash"))
    # rows equal in id and text are one document
    rows = signed.groupBy(F.col("_id").alias("_ri"), F.col("th").alias("_rh")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    chosen = cut(chosen.join(rows, F.col("_found").eqNullSafe(F.col("_ri")) & (F.col("_hash") == F.col("_rh")), "left").select("_found", "_hash", F.coalesce("_rows", F.lit(1)).alias("_rows")))
    own, names = guarded(docs)
    own = own.withColumn("_own_hash", text_hash(names[text])).withColumn("_slot", F.xxhash64(names[id_col], "_own_hash"))
    same = F.col(names[id_col]).eqNullSafe(F.col("_found")) & (F.col("_own_hash") == F.col("_hash"))
    # texts that share no slot with one that goes stay as they are; the others are looked up, and of equal rows one is kept
    gone = signed.select("_id", "th").join(chosen.where("_rows = 1"), F.col("_id").eqNullSafe(F.col("_found")) & (F.col("th") == F.col("_hash")), "left_anti")
    words = slot_words(gone.select(F.xxhash64("_id", "th").alias("slot")), "slot", DROP_BITS)
    own = own.join(F.broadcast(words), F.shiftrightunsigned("_slot", 64 - DROP_BITS + 6) == F.col("word"), "left")  # at most 2**(DROP_BITS - 6) rows
    bit = F.expr(f"shiftright(held, cast(shiftrightunsigned(_slot, {64 - DROP_BITS}) & 63 as int)) & 1") == 1
    doubtful = F.col("held").isNotNull() & bit
    once = own.where(~doubtful)
    looked = own.where(doubtful)
    # inner joins (a row is chosen once): a semi-join would be moved in front of the look-up of the slots
    single = looked.join(chosen.where("_rows = 1"), same).select(*own.columns)
    repeated = looked.join(chosen.where("_rows > 1"), same).select(*own.columns).dropDuplicates([names[id_col], "_own_hash"])
    return once.unionByName(single).unionByName(repeated).select(*names.values()).toDF(*docs.columns)
