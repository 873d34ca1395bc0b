"""Constants and canonical schemas.

counts   ord int, ctx string, w string, cnt long | double     (ctx: words joined by a blank, '' for unigrams)
probs    ord int, ctx string, w string, logp double           (base-10 logarithm; zero is -Infinity)
bows     len int, ctx string, bow double
events   (keys ...), pos int, ctx string, w string
hyps     utt, rank int, words array<string>, ascore double, lscore double, nwords int
"""

from __future__ import annotations

BOS, EOS, UNK, PAUSE = "<s>", "</s>", "<unk>", "-pau-"
NON_EVENTS = (BOS, PAUSE)
#: Fixed values that decide results.
EPSILON = 3e-6
ARPA_ZERO = -99.0
META = "__META__"
GT_MIN = {1: 1, 2: 1}
GT_MAX = {1: 1}
GT_MIN_HIGH, GT_MAX_HIGH = 2, 7


def gt_min(order: int) -> int:
    """Default minimum count of an order."""
    return GT_MIN.get(order, GT_MIN_HIGH)


def gt_max(order: int) -> int:
    """Default highest discounted count of an order."""
    return GT_MAX.get(order, GT_MAX_HIGH)
