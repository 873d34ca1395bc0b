"""Scalar functions over words, word sequences and log probabilities (all built-in expressions)."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.schema import BOS, EOS, UNK

BLANKS = "[ \\t\\r\\n]+"
LN10 = math.log(10.0)
LOG_SCALE = 10000.5


def words_of(line: Column) -> Column:
    """The words of a line."""
    return F.array_remove(F.split(line, BLANKS), "")


def lower_words(words: Column) -> Column:
    return F.transform(words, F.lower)


def reverse_words(words: Column) -> Column:
    return F.reverse(words)


def with_boundaries(words: Column, start: bool = True, end: bool = True) -> Column:
    """Sentence boundaries, added only where the sentence does not have them."""
    if start:
        words = F.when(F.coalesce(F.try_element_at(words, F.lit(1)) == BOS, F.lit(False)), words).otherwise(F.concat(F.array(F.lit(BOS)), words))
    if end:
        words = F.when(F.coalesce(F.try_element_at(words, F.lit(-1)) == EOS, F.lit(False)), words).otherwise(F.concat(words, F.array(F.lit(EOS))))
    return words


def split_multiwords(words: Column, separator: str = "_") -> Column:
    return F.flatten(F.transform(words, lambda w: F.filter(F.split(w, separator), lambda p: p != "")))


def without(words: Column, noise: Iterable[str]) -> Column:
    """The words that are no noise, in order."""
    drop = list(noise)
    return F.filter(words, lambda w: ~w.isin(drop)) if drop else words


def map_unknown(words: Column, vocabulary: Iterable[str]) -> Column:
    """Words outside a small closed vocabulary become the unknown word (large vocabularies: ``operators.counts.map_oov``)."""
    known = list(vocabulary)
    return F.transform(words, lambda w: F.when(w.isin(known), w).otherwise(F.lit(UNK)))


def factors_of(token: Column) -> Column:
    """``Tag-value`` factors of a token, separated by colons; a bare word is the factor W."""
    return F.when(F.locate("-", token) == 0, F.create_map(F.lit("W"), token)).otherwise(F.str_to_map(token, F.lit(":"), F.lit("-")))


def tagged_word(token: Column) -> Column:
    """``word/tag`` to a struct, both nullable."""
    word, tag = F.regexp_extract(token, "^(.*?)(?:/([^/]*))?$", 1), F.regexp_extract(token, "^.*/([^/]*)$", 1)
    return F.struct(F.when(word != "", word).alias("word"), F.when(tag != "", tag).alias("tag"))


# ---- probabilities, base-10 logarithms ----


def to_log(p: Column) -> Column:
    return F.when(p > 0, F.log10(p)).otherwise(F.lit(float("-inf")))


def to_prob(logp: Column) -> Column:
    return F.pow(F.lit(10.0), logp)


def log_add(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b)."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log10(1 + F.pow(F.lit(10.0), low - high)))


def log_sub(a: Column, b: Column) -> Column:
    """log10(10**a - 10**b); minus infinity where nothing is left."""
    return F.when(b == float("-inf"), a).when(a <= b, F.lit(float("-inf"))).otherwise(a + F.log10(1 - F.pow(F.lit(10.0), b - a)))


def weighted_log(weight: Column, logp: Column) -> Column:
    """weight * logp, with 0 times minus infinity being 0."""
    return F.when(weight == 0, F.lit(0.0)).otherwise(weight * logp)


def to_intlog(logp: Column) -> Column:
    return F.rint(logp * LN10 * LOG_SCALE)


def to_bytelog(logp: Column) -> Column:
    return F.greatest(F.rint(logp * LN10 * LOG_SCALE / 1024), F.lit(-255.0))


def from_bytelog(value: Column) -> Column:
    return value * 1024 / LOG_SCALE / LN10


# ---- n-gram strings ----


def gram(ctx: Column, w: Column) -> Column:
    """The n-gram of a context and a word."""
    return F.when(ctx == "", w).otherwise(F.concat(ctx, F.lit(" "), w))


def shorter(ctx: Column) -> Column:
    """A context without its oldest word."""
    return F.when(F.locate(" ", ctx) == 0, F.lit("")).otherwise(F.substring(ctx, F.locate(" ", ctx) + 1, F.length(ctx)))


def last_word(ctx: Column) -> Column:
    return F.substring_index(ctx, " ", -1)


def but_last(ctx: Column) -> Column:
    return F.when(F.locate(" ", ctx) == 0, F.lit("")).otherwise(F.substring(ctx, F.lit(1), F.length(ctx) - F.length(last_word(ctx)) - 1))


def first_word(ctx: Column) -> Column:
    return F.substring_index(ctx, " ", 1)


def suffix(ctx: Column, n: int) -> Column:
    """The last ``n`` words of a context (all of it if it is shorter)."""
    return F.lit("") if n <= 0 else F.substring_index(ctx, " ", -n)
