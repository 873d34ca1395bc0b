"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised (blanks become the space mark, one is put in front) and cut wherever two neighbouring
characters stand together in no piece, so no piece crosses a cut. The distinct words between cuts give the
lattice: their substrings up to the longest piece are exploded, joined to the piece table by equality (a
sort-merge join of hashes, in columns), and the edges found are grouped by word. Spark's higher-order
``aggregate`` folds each word's edges into the boundaries of its best segmentation; a pass over the same
stream then puts the pieces of each document's words together. A task folds a word once; its dictionary is
dropped and begun anew at ``dictionary_limit`` words, which bounds memory. All of this is one narrow
stage: nothing is shuffled, and a lost task is simply rerun.

The fold: the models at hand are of the BPE kind, whose scores are merge ranks, and the path with the greatest
sum of scores is not what their library returns. So edges are folded by rank, then start, then
length: an edge whose two ends are boundaries with exactly one boundary between them removes that one. Pieces
that share one score (runs of blanks) have no rank among themselves: of them the longest from the left is
taken whole. For a consistent model this is the library's encoding; the tests compare the two. Words of
more than 60 characters hold their boundaries in several 60-bit blocks. Characters without a piece become
byte pieces.

Null and empty texts have no pieces; texts are not cut or dropped for their length; each row stands alone, so ties and
repeated rows need no rule; an empty table gives an empty result; the caller's columns stay and ``out``
replaces one of that name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import trim

MARK = "▁"
BITS = 60
FULL = (1 << BITS) - 1
#: Base of the substring hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
DOC, WORD, RESET = 0, 1, 2


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Hasher:
    """Hashes of substrings of one long text."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        if len(Hasher.powers) <= len(codes):
            size = max(1 << 16, 2 * len(codes))
            factors = np.full((2, size + 1), [[BASE], [INVERSE]], np.uint64)
            factors[:, 0] = 1
            Hasher.powers, Hasher.inverses = np.cumprod(factors, axis=1, dtype=np.uint64)
        terms = (codes.astype(np.uint64) + np.uint64(1)) * Hasher.powers[: len(codes)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * Hasher.inverses[start] + (end - start).astype(np.uint64)
        return h ^ h >> np.uint64(29)


class Joined:
    """The piece table sorted by hash, for equality joins; a hit counts only if the characters are equal too."""

    def __init__(self, pieces: list[str], values: list[int]):
        self.flat = code_points("".join(pieces))
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        keys = Hasher(self.flat).spans(starts, ends)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(values, np.int64)[order]
        self.starts, self.sizes = starts[order], (ends - starts)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")

    def find(self, keys: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The value of each substring of ``codes``, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        size = np.broadcast_to(size, start.shape)
        hits = np.flatnonzero((self.keys[at] == keys) & (self.sizes[at] == size))
        found = np.full(len(keys), -1, np.int64)
        length = size[hits]
        if len(hits):
            ends = np.cumsum(length)
            place = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
            same = self.flat[np.repeat(self.starts[at[hits]], length) + place] == codes[np.repeat(start[hits], length) + place]
            hits = hits[np.logical_and.reduceat(same, ends - length)]
        found[hits] = self.values[at[hits]]
        return found


def model_kind(model: bytes) -> int:
    """The kind of a serialised model: 1 unigram, 2 BPE, 3 word, 4 char (field 3 of field 2; 1 if it is not given)."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (model[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if model[at - 1] < 128:
                return value, at

    at, end, inside = 0, len(model), False
    while at < end:
        tag, at = number(at)
        field, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = number(at)
            if inside and field == 3:
                return value
        elif wire == 2:
            size, at = number(at)
            if field == 2 and not inside:
                inside, end = True, at + size
            else:
                at += size
        else:
            at += 8 if wire == 1 else 4
    return 1


def possible(start: np.ndarray, length: np.ndarray, rank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges without those that end inside a certain pair.

    A pair of characters that outranks every edge with an end between the two is merged in any case: no
    merge that could take one of them comes first. Then an edge with an end there can never be applied.
    """
    none = np.iinfo(rank.dtype).max
    ending, starting = np.full(size + 1, none), np.full(size + 1, none)
    np.minimum.at(ending, start + length, rank)
    np.minimum.at(starting, start, rank)
    between = start + 1
    certain = (length == 2) & (rank < ending[between]) & (rank < starting[between])
    taken = np.zeros(size + 1, bool)
    taken[between[certain]] = True
    keep = ~(taken[start] | taken[start + length])
    return start[keep], length[keep], rank[keep]


class PieceTable:
    """Pieces of a model that may appear in texts, with id and merge rank."""

    def __init__(self, model: bytes):
        if model_kind(model) != 2:
            raise ValueError("the fold by rank encodes with BPE models only; this model is of another kind")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.byte_of: dict[int, int] = {}
        scores = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.names.append(piece)
            if sp.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                scores.append((-sp.get_score(i), piece))
        self.bytes = {b: i for i, b in self.byte_of.items()}
        self.spelling: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.unknown, self.hidden = sp.unk_id(), {i for i in range(sp.get_piece_size()) if sp.is_control(i)}
        place = {s: k for k, s in enumerate(sorted({s for s, _ in scores}))}
        shared = {s for s, n in Counter(s for s, _ in scores).items() if n > 1}
        long = [(p, place[s], s in shared) for s, p in scores if len(p) > 1]
        self.longest = max(len(p) for p, _, _ in long)
        #: rank * 2, and one more for a piece that shares its score
        self.merges = {p: 2 * r + t for p, r, t in long}
        found = {p[:k]: -2 for p, _, _ in long for k in range(2, len(p))} | self.merges  # -2: what only begins a piece
        self.edges_of = Joined(list(found), list(found.values()))
        self.id_of = Joined(list(self.ids), list(self.ids.values()))
        letters = sorted(set("".join(p for p, _, _ in long)))
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p, _, _ in long:
            c = self.letter[code_points(p)]
            self.together[c[:-1], c[1:]] = True

    def split(self, text: str) -> list[str]:
        """The words of a text."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        c = self.letter[code_points(text)]
        cuts = [0, *(np.flatnonzero(~self.together[c[:-1], c[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges of all words in fold order: word, start and end in it, and whether the piece is tied."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = code_points("".join(words))
        hashes, ends = Hasher(codes), np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(len(codes))
        starts, lengths, ranks = [], [], []
        at = np.arange(len(codes))
        for n in range(2, self.longest + 1):
            at = at[room[at] >= n]
            if not len(at):
                break
            value = self.edges_of.find(hashes.spans(at, at + n), codes, at, n)
            at, value = at[value != -1], value[value != -1]
            hit = value >= 0
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), n))
            ranks.append(value[hit])
        if not starts:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty.astype(bool)
        start, length, rank = map(np.concatenate, (starts, lengths, ranks))
        for _ in range(2):
            start, length, rank = possible(start, length, rank, len(codes))
        word = np.repeat(np.arange(len(words)), sizes)[start]
        tied = (rank & 1).astype(bool)
        order = np.lexsort((np.where(tied, -length, length), start, rank, word))
        word, start, length, tied = word[order], start[order], length[order], tied[order]
        start = start - (ends - sizes)[word]
        return word, start, start + length, tied

    def spell(self, words: list[str], bounds: list[np.ndarray] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per word, from (word, position) boundary pairs, each word's 0 and end included."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = code_points("".join(words))
        offset = np.cumsum(sizes) - sizes
        word, place = bounds
        place = place + offset[word]
        same = word[1:] == word[:-1]
        begin, end, owner = place[:-1][same], place[1:][same], word[:-1][same]
        ids = self.id_of.find(Hasher(codes).spans(begin, end), codes, begin, end - begin) if len(begin) else np.zeros(0, np.int64)
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            text = "".join(words)
            out, counts = [], np.ones(len(ids), np.int64)
            for k in missing.tolist():
                part = text[begin[k] : end[k]]
                made = [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                counts[k] = len(made)
                out.append(made)
            spread = np.repeat(ids, counts)
            where = np.cumsum(counts) - counts
            for k, made in zip(missing.tolist(), out, strict=True):
                spread[where[k] : where[k] + len(made)] = made
            ids, owner = spread, np.repeat(owner, counts)
        return ids.astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def spelled_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that pieces spell, end to end, and their number per piece; control pieces spell nothing."""
        if self.spelling is None:
            raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.hidden else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(self.names)]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            self.spelling = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes
        flat, starts, sizes = self.spelling
        length = sizes[ids]
        stop = np.cumsum(length)
        return flat[np.repeat(starts[ids] - (stop - length), length) + np.arange(int(length.sum()))], length

    def decode(self, ids: np.ndarray) -> str:
        spelled, _ = self.spelled_bytes(ids)
        return spelled.tobytes().decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def piece_table(model: bytes) -> PieceTable:
    return PieceTable(model)


NARROW = "array<struct<e:bigint,i:bigint>>"
WIDE = "array<struct<b:int,e:bigint,i:bigint,e2:bigint,i2:bigint,t:boolean>>"


def lists_of(counts: np.ndarray, items: pa.Array, empty: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    mask = pa.array(empty) if empty is not None else None
    return pa.ListArray.from_arrays(pa.array(offsets), items, mask=mask)


def edge_columns(table: PieceTable, words: list[str]) -> tuple[pa.Array, pa.Array]:
    """Edges of words as bit masks: of words within one block, and of longer words and those with tied pieces."""
    word, start, end, tied = table.lattice(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    broad = sizes >= BITS
    broad[word[tied]] = True
    narrow = ~broad[word]
    one = np.uint64(1)
    s, e = start[narrow].astype(np.uint64), end[narrow].astype(np.uint64)
    ends, inner = one << s | one << e, (one << e) - (np.uint64(2) << s)
    items = pa.StructArray.from_arrays([pa.array(ends.view(np.int64)), pa.array(inner.view(np.int64))], ["e", "i"])
    first = lists_of(np.bincount(word[narrow], minlength=len(words)), items, broad)
    rows = []
    for a, b, t in zip(start[~narrow].tolist(), end[~narrow].tolist(), tied[~narrow].tolist(), strict=True):
        k = a // BITS
        ends_w = 1 << a - k * BITS | 1 << b - k * BITS
        inner_w = (1 << b - k * BITS) - (2 << a - k * BITS)
        rows.append((k, ends_w & FULL, inner_w & FULL, ends_w >> BITS, inner_w >> BITS, t))
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.bool_()]
    cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    second = lists_of(np.bincount(word[~narrow], minlength=len(words)), pa.StructArray.from_arrays(cols, ["b", "e", "i", "e2", "i2", "t"]), ~broad)
    return first, second


def lattice_stream(batches: Iterator[pa.RecordBatch], table: PieceTable, text: str, schema: pa.Schema, group_chars: int, dictionary_limit: int) -> Iterator[pa.RecordBatch]:
    """New words with their edges, then the documents that use them with the numbers of their words."""
    plain = [c for c in schema.names if not c.startswith("_sp_")]
    number: dict[str, int] = defaultdict(count().__next__)

    def rows(kind: int, n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        given = given | {"_sp_kind": pa.array(np.full(n, kind, np.int8))}
        return pa.RecordBatch.from_arrays([given[c].cast(schema.field(c).type) if c in given else pa.nulls(n, schema.field(c).type) for c in schema.names], schema=schema)

    def emit(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal number
        if len(number) > dictionary_limit:
            number = defaultdict(count().__next__)
            yield rows(RESET, 1, {})
        known = len(number)
        lists = []
        for t in docs.column(text):
            words = table.split(t.as_py() or "")
            lists.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        fresh = list(islice(number, known, None))
        for at in range(0, len(fresh), 8192):
            words = fresh[at : at + 8192]
            narrow, wide = edge_columns(table, words)
            sizes = pa.array([len(w) for w in words], pa.int32())
            yield rows(WORD, len(words), {"_sp_word": pa.array(words), "_sp_size": sizes, "_sp_narrow": narrow, "_sp_wide": wide})
        # numbers travel as bytes, which the JVM copies whole
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) * 4))).astype(np.int32)
        used = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate(lists).tobytes())])
        sums = pa.array([checksum((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in docs.column(text)], pa.binary())
        yield rows(DOC, docs.num_rows, {c: docs.column(c) for c in plain} | {"_sp_used": used, "_sp_sum": sums})

    for batch in batches:
        sizes = np.cumsum([len(x.as_py() or "") for x in batch.column(text)]) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + group_chars, "right")))
            yield from emit(batch.slice(at, end - at))
            at = end
        trim()
    number.clear()
    piece_table.cache_clear()  # the worker goes on to other stages
    trim()


def boundaries(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word, position) pairs from the folded bit masks."""
    one = part.column("_sp_one")
    masks = np.asarray(one.fill_null(0)).astype(np.int64)
    word, place = np.nonzero(masks[:, None] >> np.arange(BITS + 1) & 1)
    if one.null_count:
        extra_w, extra_p = [], []
        for row in np.flatnonzero(np.asarray(one.is_null())).tolist():
            blocks = np.array(part.column("_sp_many")[row].as_py(), np.int64)
            at = np.flatnonzero((blocks[:, None] >> np.arange(BITS) & 1).ravel())
            extra_w.append(np.full(len(at), row))
            extra_p.append(at)
        word, place = np.concatenate([word, *extra_w]), np.concatenate([place, *extra_p])
        order = np.lexsort((place, word))
        word, place = word[order], place[order]
    return word, place


def checksum(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 values held as bytes, end to end, and their number per row."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view(np.int32).astype(np.int64), np.diff(bounds) // 4


def restored(table: PieceTable, ids: np.ndarray, bound: np.ndarray, sums: pa.Array) -> pa.Array:
    """Whether the ids of each document decode to the text of its checksum."""
    spelled, length = table.spelled_bytes(ids)
    ends = np.concatenate(([0], np.cumsum(length)))[bound]
    whole = spelled.tobytes()
    same = [checksum(whole[a + (whole[a : a + 1] == b" ") : b]) == s for s, a, b in zip(sums.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.array(same, pa.bool_())


def assemble_stream(batches: Iterator[pa.RecordBatch], table: PieceTable, out_schema: pa.Schema, plain: list[str], out: str, check: str | None) -> Iterator[pa.RecordBatch]:
    """Word rows fill the task's dictionary of pieces; document rows are put together from it."""
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for batch in batches:
        kinds = np.asarray(batch.column("_sp_kind"))
        cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if at == end:
                continue
            part = batch.slice(at, end - at)
            if kinds[at] == RESET:
                flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            elif kinds[at] == WORD:
                ids, counts = table.spell(part.column("_sp_word").to_pylist(), boundaries(part))
                flat.append(ids)
                sizes.append(counts)
            else:
                if len(flat) > 1:
                    flat, sizes = [np.concatenate(flat)], [np.concatenate(sizes)]
                starts = np.cumsum(sizes[0]) - sizes[0]
                for some in range(0, part.num_rows, 512):
                    rows = part.slice(some, 512)
                    index, count = numbers_of(rows.column("_sp_used"))
                    length = sizes[0][index]
                    stop = np.cumsum(length)
                    where = np.repeat(starts[index] - (stop - length), length) + np.arange(int(length.sum()))
                    bound = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(count)))]
                    ids = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(flat[0][where]))
                    made = {c: rows.column(c) for c in plain} | {out: ids}
                    if check:
                        made[check] = restored(table, flat[0][where], bound, rows.column("_sp_sum"))
                    yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in out_schema], schema=out_schema)
    piece_table.cache_clear()
    trim()


def fold_sql() -> tuple[str, str]:
    """The fold of a word's edges: over one block, and over several."""
    one = "aggregate(_sp_narrow, shiftleft(1L, _sp_size + 1) - 1, (s, m) -> if((s & m.e) = m.e and bit_count(s & m.i) = 1, s & ~m.i, s))"
    start = f"transform(sequence(0, _sp_size div {BITS}), k -> if((k + 1) * {BITS} <= _sp_size + 1, {FULL}L, shiftleft(1L, _sp_size + 1 - k * {BITS}) - 1))"
    hit = (
        "(s[m.b] & m.e) = m.e and (m.e2 = 0 or (s[m.b + 1] & m.e2) = m.e2) "
        "and (bit_count(s[m.b] & m.i) + if(m.i2 = 0, 0, bit_count(s[m.b + 1] & m.i2)) = 1 "
        "or m.t and (s[m.b] & m.i) = m.i and (m.i2 = 0 or (s[m.b + 1] & m.i2) = m.i2))"
    )
    step = "transform(s, (x, k) -> if(k = m.b, x & ~m.i, if(k = m.b + 1, x & ~m.i2, x)))"
    many = f"aggregate(_sp_wide, {start}, (s, m) -> if({hit}, {step}, s))"
    return one, many


def encode(
    df: DataFrame, model_path: str, *, text: str = "text", out: str = "ids", check: str | None = None, keep_text: bool = True, group_chars: int = 1_000_000, dictionary_limit: int = 400_000
) -> DataFrame:
    """Add the piece ids of ``text`` and, as ``check``, whether they decode to it; without ``keep_text`` the text goes.

    The model file is read once, here; its size is fixed, so it may be broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.drop(out, *([check] if check else []))
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    plain, body = list(names.values()), names[text]
    source = df.toDF(*plain)
    fields = [T.StructField(f.name, f.dataType, True) for f in source.schema.fields]
    own = {"_sp_kind": T.ByteType(), "_sp_word": T.StringType(), "_sp_size": T.IntegerType(), "_sp_narrow": T._parse_datatype_string(NARROW), "_sp_wide": T._parse_datatype_string(WIDE), "_sp_used": T.BinaryType(), "_sp_sum": T.BinaryType()}
    passed = [f for f in fields if keep_text or f.name != body]
    lattice = T.StructType([*passed, *[T.StructField(k, t) for k, t in own.items()]])
    kept = [c for c in df.columns if keep_text or c != text]
    added = [T.StructField("_sp_ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("_sp_same", T.BooleanType())] if check else [])
    result = T.StructType([*passed, *added])
    in_schema, out_schema = to_arrow_schema(lattice), to_arrow_schema(result)
    stream = source.mapInArrow(lambda b: lattice_stream(b, piece_table(model.value), body, in_schema, group_chars, dictionary_limit), lattice)
    one, many = fold_sql()
    plain = [f.name for f in passed]
    folded = stream.selectExpr(*plain, "_sp_kind", "_sp_word", "_sp_used", "_sp_sum", f"{one} as _sp_one", f"{many} as _sp_many")
    same = "_sp_same" if check else None
    whole = folded.mapInArrow(lambda b: assemble_stream(b, piece_table(model.value), out_schema, plain, "_sp_ids", same), result)
    return whole.toDF(*kept, out, *([check] if check else []))


def relational_pieces(words: DataFrame, model_path: str, *, word: str = "word") -> DataFrame:
    """``word`` and ``pieces`` (array of piece strings) of each distinct word, by Spark operators alone.

    The words, as ``PieceTable.split`` cuts them, are exploded into substrings up to the longest piece, joined to the
    piece table by equality (its size is that of the model, so it is broadcast), and the edges are grouped by word and
    folded by ``aggregate`` in order of rank. Characters in no edge stay single. This is the form that ``encode`` takes
    column by column inside a task; as a join it has to send every occurrence of a word to its pieces and back.
    """
    with open(model_path, "rb") as f:
        table = piece_table(f.read())
    spark = words.sparkSession
    edges = spark.createDataFrame([(p, r // 2, bool(r & 1)) for p, r in table.merges.items()], "piece string, rank int, tied boolean")
    distinct = words.select(F.col(word).alias("word")).where("word <> ''").distinct()
    size = F.length("word")
    starts = F.explode(F.sequence(F.lit(1), size)).alias("at")
    long = distinct.where(size > 1).select("word", starts)
    room = F.least(F.lit(table.longest), F.length("word") - F.col("at") + 1)
    spans = long.where(room >= 2).select("word", "at", F.explode(F.sequence(F.lit(2), room)).alias("n"))
    found = spans.select("word", "at", "n", F.substring("word", F.col("at"), F.col("n")).alias("piece")).join(F.broadcast(edges), "piece")
    order = F.struct("rank", "at", F.when(F.col("tied"), -F.col("n")).otherwise(F.col("n")).alias("length"), "tied", "n")
    listed = found.groupBy("word").agg(F.sort_array(F.collect_list(order)).alias("edges"))
    listed = distinct.join(listed, "word", "left")
    # the state is the list of starts of the parts; an edge applies if both ends are boundaries and one is between
    folded = F.expr("""
        aggregate(coalesce(edges, array()), sequence(1, length(word) + 1), (s, m) ->
          if(array_contains(s, m.at) and array_contains(s, m.at + m.n)
             and (size(filter(s, x -> x > m.at and x < m.at + m.n)) = 1 or m.tied and size(filter(s, x -> x > m.at and x < m.at + m.n)) = m.n - 1),
             filter(s, x -> x <= m.at or x >= m.at + m.n), s))""")
    cuts = listed.select("word", folded.alias("s"))
    return cuts.select("word", F.expr("transform(slice(s, 1, size(s) - 1), (x, k) -> substring(word, x, s[k + 1] - x))").alias("pieces"))


def decode(df: DataFrame, model_path: str, *, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text that the piece ids spell; null ids give null."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def spelled(lists: pa.Array) -> pa.Array:
        table = piece_table(model.value)
        return pa.array([table.decode(np.asarray(x.values)) if x.is_valid else None for x in lists], pa.string())

    return df.withColumn(out, spelled.asNondeterministic()(F.col(ids)))
