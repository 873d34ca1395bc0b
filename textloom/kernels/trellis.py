"""Dynamic programming over states per position, in base-10 log space: forward, Viterbi with n-best, backward."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Hashable, Iterable

ZERO = float("-inf")


def add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == ZERO else a + math.log10(1 + 10 ** (b - a))


def total(values: Iterable[float]) -> float:
    out = ZERO
    for v in values:
        out = add(out, v)
    return out


Step = Callable[[int, Hashable], Iterable[tuple[Hashable, float]]]


class Trellis:
    """Columns of reachable states; ``step(t, state)`` yields the states at t + 1 with their log weights."""

    def __init__(self, start: dict[Hashable, float], length: int, step: Step, beam: float = 0.0):
        self.forward: list[dict[Hashable, float]] = [dict(start)]
        self.edges: list[dict[Hashable, list[tuple[Hashable, float]]]] = []
        for t in range(length):
            column: dict[Hashable, float] = {}
            edges: dict[Hashable, list[tuple[Hashable, float]]] = {}
            floor = max(self.forward[-1].values(), default=ZERO) - beam if beam else ZERO
            for state, value in self.forward[-1].items():
                if value == ZERO or value < floor:
                    continue
                for target, weight in step(t, state):
                    if weight == ZERO:
                        continue
                    column[target] = add(column.get(target, ZERO), value + weight)
                    edges.setdefault(target, []).append((state, weight))
            self.forward.append(column)
            self.edges.append(edges)

    def log_total(self, t: int = -1) -> float:
        return total(self.forward[t].values())

    def viterbi(self, n: int = 1) -> list[tuple[float, list[Hashable]]]:
        """The ``n`` best state sequences, best first; ties by the order in which states were reached."""
        best: list[dict[Hashable, list[tuple[float, Hashable | None, int]]]] = [{s: [(v, None, 0)] for s, v in self.forward[0].items()}]
        for edges in self.edges:
            column: dict[Hashable, list[tuple[float, Hashable | None, int]]] = {}
            for target, sources in edges.items():
                found = [(-(value + w), order, k, s) for order, (s, w) in enumerate(sources) for k, (value, _, _) in enumerate(best[-1].get(s, []))]
                column[target] = [(-v, s, k) for v, _, k, s in heapq.nsmallest(n, found, key=lambda x: x[:3])]
            best.append(column)
        ends = [(-v, order, k, s) for order, (s, items) in enumerate(best[-1].items()) for k, (v, _, _) in enumerate(items)]
        out = []
        for v, _, k, s in heapq.nsmallest(n, ends, key=lambda x: x[:3]):
            path, state, rank = [], s, k
            for t in range(len(best) - 1, -1, -1):
                path.append(state)
                _, state, rank = best[t][state][rank]
            out.append((-v, path[::-1]))
        return out

    def backward(self, final: dict[Hashable, float] | None = None) -> list[dict[Hashable, float]]:
        columns = [{s: (final.get(s, ZERO) if final is not None else 0.0) for s in self.forward[-1]}]
        for edges in reversed(self.edges):
            column: dict[Hashable, float] = {}
            for target, sources in edges.items():
                for s, w in sources:
                    column[s] = add(column.get(s, ZERO), w + columns[-1].get(target, ZERO))
            columns.append(column)
        return columns[::-1]

    def posteriors(self) -> list[dict[Hashable, float]]:
        """Posterior probability of each state in each column."""
        back, whole = self.backward(), self.log_total()
        out = []
        for f, b in zip(self.forward, back, strict=True):
            out.append({s: 10 ** (v + b.get(s, ZERO) - whole) if whole > ZERO else 0.0 for s, v in f.items()})
        return out
