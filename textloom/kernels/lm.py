"""A back-off model in memory, for kernels that need probabilities state by state."""

from __future__ import annotations

from collections.abc import Sequence

ZERO = float("-inf")


class TableModel:
    """Probabilities keyed by words, weights keyed by contexts (tuples, oldest word first)."""

    def __init__(self, order: int, probs: dict[tuple[str, ...], float], bows: dict[tuple[str, ...], float]):
        self.order, self.probs, self.bows = order, probs, bows

    @classmethod
    def from_rows(cls, order: int, probs: Sequence[tuple[str, str, float]], bows: Sequence[tuple[str, float]]) -> TableModel:
        key = lambda ctx: tuple(ctx.split(" ")) if ctx else ()
        return cls(order, {(*key(c), w): p for c, w, p in probs}, {key(c): b for c, b in bows})

    def used(self, context: Sequence[str]) -> tuple[str, ...]:
        """The longest part of a context that the model tells apart."""
        ctx = tuple(context)[-(self.order - 1) :] if self.order > 1 else ()
        while ctx and ctx not in self.bows:
            ctx = ctx[1:]
        return ctx

    def log_prob(self, word: str, context: Sequence[str] = ()) -> float:
        ctx = tuple(context)[-(self.order - 1) :] if self.order > 1 else ()
        weight = 0.0
        while True:
            p = self.probs.get((*ctx, word))
            if p is not None:
                return p + weight
            if not ctx:
                return ZERO
            weight += self.bows.get(ctx, 0.0)
            ctx = ctx[1:]

    def sentence(self, words: Sequence[str], start: str = "<s>", end: str = "</s>") -> float:
        """Log probability of the words that have one."""
        out, history = 0.0, [start]
        for w in [*words, end]:
            p = self.log_prob(w, history)
            out += p if p > ZERO else 0.0
            history.append(w)
        return out
