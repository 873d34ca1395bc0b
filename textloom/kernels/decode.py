"""Hidden-variable decoding over one sentence: disambiguation, hidden events, segmentation, class, disfluency and HMM models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from textloom.kernels.lm import TableModel
from textloom.kernels.trellis import ZERO, Trellis, add, total

#: Fixed value: what stands for a zero probability in a search.
PSEUDO_ZERO = -100.0
NO_EVENT = "*noevent*"


def log10(p: float) -> float:
    return math.log10(p) if p > 0 else ZERO


def disambiguate(words: Sequence[str], candidates: dict[str, Sequence[tuple[str, float]]], model: TableModel, *, lm_weight: float = 1.0, map_weight: float = 1.0, scale: bool = False, n: int = 1, posteriors: bool = False):
    """Best hidden words (or posteriors per position) given each word's candidates and probabilities; unmapped words stand for themselves."""
    columns = [candidates.get(w) or [(w, 1.0)] for w in words] + [[("</s>", 1.0)]]

    def step(t: int, state: tuple[str, tuple[str, ...]]):
        _, ctx = state
        for tag, p in columns[t]:
            local, uni = log10(p), model.log_prob(tag)
            if scale and uni > ZERO:
                local -= uni
            trans = model.log_prob(tag, ctx)
            if trans == ZERO and uni == ZERO:
                trans = PSEUDO_ZERO
            grown = (*ctx, tag)
            used = model.used(grown) or grown[-1:]
            yield (tag, used), lm_weight * trans + map_weight * local

    trellis = Trellis({("<s>", ("<s>",)): 0.0}, len(columns), step)
    if posteriors:
        out = []
        for column in trellis.posteriors()[1:-1]:
            sums: dict[str, float] = {}
            for (tag, _), p in column.items():
                sums[tag] = sums.get(tag, 0.0) + p
            out.append(sums)
        return out
    return [(v, [tag for tag, _ in path[1:-1]]) for v, path in trellis.viterbi(n)]


def hidden_events(words: Sequence[str], events: Sequence[str], model: TableModel, *, lm_weight: float = 1.0, local: Sequence[dict[str, float]] | None = None, map_weight: float = 1.0, unk: float = PSEUDO_ZERO, forced: bool = False, n: int = 1, posteriors: bool = False):
    """Best events (or ``*noevent*``) after each word; the first word is free."""
    choices = list(events) if forced else [NO_EVENT, *events]

    def step(t: int, state: tuple[str, tuple[str, ...]]):
        _, ctx = state
        w = words[t]
        cost = 0.0 if t == 0 else model.log_prob(w, ctx)
        if cost == ZERO:
            cost = unk
        after = (*ctx, w)
        for e in choices:
            grown, p = after, cost
            if e != NO_EVENT:
                q = model.log_prob(e, after)
                if q == ZERO:
                    continue
                grown, p = (*after, e), cost + q
            near = log10(local[t].get(e, 0.0)) if local is not None else 0.0
            yield (e, grown[-(model.order - 1) :] if model.order > 1 else ()), lm_weight * p + (map_weight * near if near > ZERO else PSEUDO_ZERO)

    trellis = Trellis({("", ()): 0.0}, len(words), step)
    if posteriors:
        out = []
        for column in trellis.posteriors()[1:]:
            sums: dict[str, float] = {}
            for (e, _), p in column.items():
                sums[e] = sums.get(e, 0.0) + p
            out.append(sums)
        return out
    return [(v, [e for e, _ in path[1:]]) for v, path in trellis.viterbi(n)]


def event_counts(words: Sequence[str], events: Sequence[str], model: TableModel, order: int = 2) -> dict[tuple[str, ...], float]:
    """Expected n-gram counts of words and events."""
    post = hidden_events(words, events, model, posteriors=True)
    out: dict[tuple[str, ...], float] = {}
    for w, column in zip(words, post, strict=True):
        for e, p in column.items():
            if e != NO_EVENT and order > 1:
                out[(w, e)] = out.get((w, e), 0.0) + p
    return out


def segment(words: Sequence[str], model: TableModel, bias: float = 0.0, posteriors: bool = False):
    """Whether a sentence starts at each word: two states, best path or posteriors."""
    if not words:
        return []
    end = model.log_prob("</s>")

    def p(w: str, ctx: Sequence[str]) -> float:
        v = model.log_prob(w, ctx)
        return PSEUDO_ZERO if v == ZERO and model.log_prob(w) == ZERO else v

    first = words[0]
    joint = end + p(first, ["<s>"])
    plain = p(first, [])
    rest = log10(max(0.0, 10**plain - 10**joint))
    start = {True: joint + bias, False: rest}

    def step(t: int, state: bool):
        w, near = words[t + 1], words[max(0, t - 2) : t + 1]
        own = ["<s>", words[t]] if state else near
        begin = p(w, ["<s>"])
        yield False, p(w, own) + (bias if state else 0.0)
        stop = model.log_prob("</s>", own)
        yield True, stop + begin + (bias if state else 0.0)

    trellis = Trellis({k: v for k, v in start.items() if v > ZERO}, len(words) - 1, step)
    if posteriors:
        return [column.get(True, 0.0) for column in trellis.posteriors()]
    found = trellis.viterbi(1)
    return list(found[0][1]) if found else [False] * len(words)


def segment_nbest(lists: Sequence[Sequence[tuple[Sequence[str], float]]], model: TableModel, bias: float = 0.0) -> list[int]:
    """Best hypothesis of each successive list, with or without a sentence boundary between them."""

    def step(t: int, state: tuple[int, tuple[str, ...]]):
        _, ctx = state
        for k, (words, score) in enumerate(lists[t]):
            for cut in (True, False):
                history, value = (["<s>"], model.log_prob("</s>", ctx) + bias) if cut else (list(ctx), 0.0)
                if value == ZERO:
                    continue
                for w in words:
                    q = model.log_prob(w, history)
                    value += q if q > ZERO else PSEUDO_ZERO
                    history.append(w)
                yield (k, tuple(history[-(model.order - 1) :]) if model.order > 1 else ()), value + score

    found = Trellis({(-1, ("<s>",)): 0.0}, len(lists), step).viterbi(1)
    return [k for k, _ in found[0][1][1:]] if found else []


def class_probs(words: Sequence[str], model: TableModel, classes: dict[str, Sequence[tuple[str, float, tuple[str, ...]]]]) -> list[float]:
    """Log probability of each word (and the end) under a class model; ``classes`` maps a first word to (class, p, expansion)."""
    column: dict[tuple[tuple[str, ...], tuple[str, ...]], float] = {(("<s>",), ()): 0.0}
    out, last = [], 0.0
    for w in [*words, "</s>"]:
        new: dict[tuple[tuple[str, ...], tuple[str, ...]], float] = {}

        def reach(ctx: tuple[str, ...], rest: tuple[str, ...], v: float, new=new) -> None:
            key = (model.used(ctx), rest)
            new[key] = add(new.get(key, ZERO), v)

        for (ctx, rest), v in column.items():
            if rest:
                if rest[0] == w:
                    reach(ctx, rest[1:], v)
                continue
            q = model.log_prob(w, ctx)
            if q > ZERO:
                reach((*ctx, w), (), v + q)
            for name, p, expansion in classes.get(w, ()):
                q = model.log_prob(name, ctx)
                if q > ZERO and p > 0:
                    reach((*ctx, name), tuple(expansion[1:]), v + q + math.log10(p))
        whole = total(new.values())
        if whole == ZERO:
            out.append(ZERO)
            column = {(model.used((w,)), ()): last}
        else:
            out.append(whole - last)
            last, column = whole, new
    return out


def hidden_event_probs(words: Sequence[str], model: TableModel, events: dict[str, dict]) -> list[float]:
    """Log probability of each word summed over hidden events before it.

    Event properties: ``delete`` k context words, ``repeat`` the last k words, ``insert`` a word in the context, ``omit`` the event from it.
    """
    column: dict[tuple[tuple[str, ...], int], float] = {(("<s>",), 0): 0.0}
    out, last = [], 0.0
    for w in [*words, "</s>"]:
        new: dict[tuple[tuple[str, ...], int], float] = {}
        for (ctx, pending), v in column.items():
            if pending:
                if w != "<unk>" and len(ctx) >= pending and ctx[-pending] == w:
                    key = ((*ctx, w)[-4:], pending if pending > 1 else 0)
                    new[key] = add(new.get(key, ZERO), v)
                continue
            for e in [None, *events]:
                props = events.get(e, {}) if e else {}
                pe = 0.0 if e is None else model.log_prob(e, ctx)
                if pe == ZERO:
                    continue
                history = list(ctx)
                if k := props.get("repeat"):
                    if w != "<unk>" and len(history) >= k and history[-k] == w:
                        key = (tuple(history + [w])[-4:], k if k > 1 else 0)
                        new[key] = add(new.get(key, ZERO), v + pe)
                    continue
                for _ in range(props.get("delete", 0)):
                    if history and history[-1] != "<s>":
                        history.pop()
                if e and not props.get("omit"):
                    history.append(props.get("insert", e))
                q = model.log_prob(w, history)
                if q > ZERO:
                    key = (model.used((*history, w)) or (w,), 0)
                    new[key] = add(new.get(key, ZERO), v + pe + q)
        whole = total(new.values())
        if whole == ZERO:
            out.append(ZERO)
            column = {((w,), 0): last}
        else:
            out.append(whole - last)
            last, column = whole, new
    return out


#: The disfluency model's events as hidden-event properties.
DISFLUENCIES = {"<DEL1>": {"delete": 1, "omit": True}, "<DEL2>": {"delete": 2, "omit": True}, "<REP1>": {"repeat": 1}, "<REP2>": {"repeat": 2}, "<SDEL>": {"delete": 99, "omit": True, "insert": "<s>"}}


def disfluency_probs(words: Sequence[str], model: TableModel) -> list[float]:
    """Word probabilities summed over deletions, repetitions and restarts."""
    return hidden_event_probs(words, model, DISFLUENCIES)


def hmm_probs(words: Sequence[str], states: dict[str, TableModel], moves: dict[str, dict[str, float]], start: str) -> list[float]:
    """Forward probabilities of an HMM whose states emit words by their own n-gram model."""
    column, out, last = {start: 0.0}, [], 0.0
    history: list[str] = ["<s>"]
    for w in [*words, "</s>"]:
        new: dict[str, float] = {}
        for s, v in column.items():
            for t, p in moves.get(s, {}).items():
                q = states[t].log_prob(w, history) if t in states else ZERO
                if q > ZERO and p > 0:
                    new[t] = add(new.get(t, ZERO), v + math.log10(p) + q)
        whole = total(new.values())
        out.append(whole - last if whole > ZERO else ZERO)
        if whole > ZERO:
            last, column = whole, new
        history.append(w)
    return out


def adaptive_mixture(words: Sequence[str], models: Sequence[TableModel], priors: Sequence[float], decay: float = 0.9, rounds: int = 2) -> list[float]:
    """Word probabilities of a mixture whose weights follow a decayed history."""
    history: list[str] = ["<s>"]
    seen: list[list[float]] = []
    weights, out = list(priors), []
    for w in [*words, "</s>"]:
        probs = [10 ** m.log_prob(w, history) if m.log_prob(w, history) > ZERO else 0.0 for m in models]
        out.append(log10(sum(a * b for a, b in zip(weights, probs, strict=True))))
        seen.append(probs)
        for _ in range(rounds):
            sums, amount = list(priors), 1.0
            for age, column in enumerate(reversed(seen[-200:])):
                mixed = sum(a * b for a, b in zip(weights, column, strict=True))
                if mixed > 0:
                    f = decay**age
                    amount += f
                    sums = [s + f * a * b / mixed for s, a, b in zip(sums, weights, column, strict=True)]
            weights = [s / amount for s in sums]
        history.append(w)
    return out
