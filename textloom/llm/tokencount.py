"""Token counts of a byte-level BPE by rank-synchronous array merging.

Texts are split at special strings (one token each) and into pre-tokens; the distinct pre-tokens of a batch
are held together as one ragged numpy array of symbols. In each round every sequence finds the lowest rank
among its adjacent pairs and merges that pair wherever it stands in it, left to right, all sequences at
once; when no sequence has a mergeable pair, its surviving symbols are its tokens. Counts of pre-tokens are
remembered in a bounded cache of each worker. Whole texts are counted, without truncation.

A null text is empty: 0 bytes, 0 tokens. Each row stands alone, so ties and repeated rows need no rule;
an empty table gives an empty result; the caller's columns stay, ``out`` replaces one of that name.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level BPE files that have ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_LIMIT = 400_000
CACHE_WORD = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class ByteBpe:
    """Merge ranks of a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE")
        vocab = model["vocab"]
        self.prefix_space = bool(pre.get("add_prefix_space"))
        self.start = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[self.order], self.order, made[self.order]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a large number where there is none) and merged symbol of each pair."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[at] == want
        return np.where(hit, self.rank[at], 1 << 40), self.made[at]

    def count_sequences(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.zeros(len(pieces), np.int64)
        symbols = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        while len(symbols) > 1:
            inside = owner[1:] == owner[:-1]
            rank, made = self.ranks(symbols[:-1], symbols[1:])
            rank = np.where(inside, rank, 1 << 40)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(np.concatenate((rank, [1 << 40])), starts)
            live = low < 1 << 40
            length = np.diff(np.concatenate((starts, [len(symbols)])))
            if not live.all():  # sequences without a mergeable pair are done
                counts[owner[starts[~live]]] = length[~live]
                keep = np.repeat(live, length)
                if not keep.any():
                    return counts
                rank, made = np.concatenate((rank, [1 << 40]))[keep], np.concatenate((made, [0]))[keep]
                symbols, owner, low, length = symbols[keep], owner[keep], low[live], length[live]
            else:
                rank, made = np.concatenate((rank, [1 << 40])), np.concatenate((made, [0]))
            hit = rank == np.repeat(low, length)
            at = np.flatnonzero(hit)
            # of overlapping hits, which only a pair of equal symbols has, every second goes, from the left
            run = np.concatenate(([True], np.diff(at) > 1))
            first = np.repeat(at[run], np.diff(np.concatenate((np.flatnonzero(run), [len(at)]))))
            at = at[(at - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if len(symbols):
            counts[owner] = 1
        return counts

    def count_texts(self, texts: list[str]) -> np.ndarray:
        known, rows, new = self.cache, [], {}
        totals = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                totals[i] += len(parts) - 1
            for part in parts:
                if not part:
                    continue
                if self.prefix_space and not part[0].isspace():
                    part = " " + part
                found = self.words.findall(part)
                try:
                    totals[i] += sum(map(known.__getitem__, found))
                except KeyError:
                    for w in found:
                        if w not in known:
                            new.setdefault(w, len(new))
                    rows.append((i, found))
        if rows:
            pieces = list(new)
            fresh = dict(zip(pieces, self.count_sequences([p.encode("utf-8", "surrogatepass") for p in pieces]).tolist(), strict=True))
            for i, found in rows:
                totals[i] += sum(known[w] if w in known else fresh[w] for w in found)
            if len(known) > CACHE_LIMIT:
                known.clear()
            known.update((w, n) for w, n in fresh.items() if len(w) <= CACHE_WORD)
        return totals


@lru_cache(maxsize=2)
def parsed(spec: str) -> ByteBpe:
    return ByteBpe(json.loads(spec))


def with_token_counts(df: DataFrame, tokenizer_path: str, *, text: str = "text", out: str = "n_tokens", group_chars: int = 2_000_000) -> DataFrame:
    """Add the number of tokens of ``text``. The vocabulary file is read once, here, and sent to the workers (its size is fixed)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        bpe, counts, held, size = parsed(spec.value), [], [], 0
        for value in texts:
            t = value.as_py() or ""
            held.append(t)
            size += len(t)
            if size > group_chars:
                counts.append(bpe.count_texts(held))
                held, size = [], 0
        counts.append(bpe.count_texts(held))
        return pa.array(np.concatenate(counts))

    return df.withColumn(out, tokens.asNondeterministic()(F.col(text)))
