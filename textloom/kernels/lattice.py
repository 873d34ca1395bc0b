"""Word lattices: directed acyclic graphs with words on nodes and base-10 log weights on edges."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Sequence

from textloom.kernels.align import Mesh
from textloom.kernels.trellis import ZERO, add, total


class Lattice:
    """``words[node]`` is None for a null node; ``out[a][b]`` is the weight of the edge a to b."""

    def __init__(self, start: int = 0, end: int = 1):
        self.words: dict[int, str | None] = {start: None, end: None}
        self.times: dict[int, float] = {}
        self.out: dict[int, dict[int, float]] = defaultdict(dict)
        self.start, self.end = start, end

    # -- building --

    def node(self, n: int, word: str | None = None, time: float | None = None) -> int:
        self.words[n] = word
        if time is not None:
            self.times[n] = time
        return n

    def new(self, word: str | None = None) -> int:
        return self.node(max(self.words) + 1, word)

    def edge(self, a: int, b: int, weight: float = 0.0) -> None:
        """Insert an edge; of two between the same nodes the larger weight stays."""
        self.out[a][b] = max(weight, self.out[a].get(b, ZERO))

    def remove(self, n: int) -> None:
        self.words.pop(n, None)
        self.times.pop(n, None)
        self.out.pop(n, None)
        for targets in self.out.values():
            targets.pop(n, None)

    def into(self) -> dict[int, dict[int, float]]:
        back: dict[int, dict[int, float]] = defaultdict(dict)
        for a, targets in self.out.items():
            for b, w in targets.items():
                back[b][a] = w
        return back

    def edges(self) -> Iterable[tuple[int, int, float]]:
        return ((a, b, w) for a, targets in self.out.items() for b, w in targets.items())

    @classmethod
    def from_rows(cls, nodes: Sequence[tuple[int, str | None]], edges: Sequence[tuple[int, int, float]], start: int, end: int) -> Lattice:
        lat = cls(start, end)
        for n, w in nodes:
            lat.node(n, w)
        for a, b, w in edges:
            lat.edge(a, b, w)
        return lat

    @classmethod
    def from_words(cls, words: Sequence[str], weight: float = 0.0) -> Lattice:
        lat = cls(0, len(words) + 1)
        for i, w in enumerate(words, 1):
            lat.node(i, w)
        for i in range(len(words) + 1):
            lat.edge(i, i + 1, weight if i == 0 else 0.0)
        return lat

    @classmethod
    def from_mesh(cls, mesh: Mesh) -> Lattice:
        """A lattice with the network's words and log posteriors."""
        lat = cls(0, 1)
        last = 0
        for column in mesh.columns:
            whole = sum(column.values()) or 1.0
            join = lat.new()
            for word, p in column.items():
                if p > 0:
                    n = lat.new(word)
                    lat.edge(last, n, math.log10(p / whole))
                    lat.edge(n, join)
            last = join
        lat.edge(last, 1)
        return lat

    def copy(self) -> Lattice:
        new = Lattice(self.start, self.end)
        new.words, new.times = dict(self.words), dict(self.times)
        new.out = defaultdict(dict, {a: dict(t) for a, t in self.out.items()})
        return new

    # -- structure --

    def order(self) -> list[int]:
        """Topological order of the nodes reachable from the start; ties by node number."""
        seen, stack, reach = {self.start}, [self.start], {self.start}
        while stack:
            for b in self.out.get(stack.pop(), ()):
                if b not in reach:
                    reach.add(b)
                    stack.append(b)
        degree = defaultdict(int)
        for a in reach:
            for b in self.out.get(a, ()):
                degree[b] += 1
        heap, result = [self.start], []
        while heap:
            a = heapq.heappop(heap)
            result.append(a)
            for b in self.out.get(a, ()):
                degree[b] -= 1
                if not degree[b] and b not in seen:
                    seen.add(b)
                    heapq.heappush(heap, b)
        if len(result) < len(reach):
            raise ValueError("the lattice has a cycle")
        return result

    def useful(self) -> Lattice:
        """Without nodes that lie on no path from start to end."""
        back, alive, stack = self.into(), {self.end}, [self.end]
        while stack:
            for a in back.get(stack.pop(), ()):
                if a not in alive:
                    alive.add(a)
                    stack.append(a)
        alive &= set(self.order())
        for n in [n for n in self.words if n not in alive and n not in (self.start, self.end)]:
            self.remove(n)
        return self

    def without_nulls(self, pause: Iterable[str] = ()) -> Lattice:
        """Null (and pause) nodes removed, their edges joined through."""
        drop = set(pause)
        back = self.into()
        for n in list(self.words):
            if n in (self.start, self.end) or not (self.words[n] is None or self.words[n] in drop):
                continue
            for a, wa in list(back.get(n, {}).items()):
                for b, wb in list(self.out.get(n, {}).items()):
                    self.edge(a, b, wa + wb)
                    back[b][a] = self.out[a][b]
            for b in self.out.get(n, {}):
                back[b].pop(n, None)
            for a in back.pop(n, {}):
                self.out[a].pop(n, None)
            self.remove(n)
        return self

    def with_pauses(self, pause: str = "-pau-", loop: bool = True) -> Lattice:
        """An optional pause after every word."""
        for n in [n for n, w in self.words.items() if w is not None and w != pause]:
            p = self.new(pause)
            for b, w in list(self.out[n].items()):
                self.edge(p, b, w)
            self.edge(n, p)
        return self

    def split_multiwords(self, separator: str = "_") -> Lattice:
        for n, w in list(self.words.items()):
            parts = [p for p in w.split(separator) if p] if w else []
            if len(parts) > 1:
                self.words[n] = parts[0]
                last, targets = n, self.out.pop(n, {})
                for p in parts[1:]:
                    m = self.new(p)
                    self.edge(last, m)
                    last = m
                self.out[last] = dict(targets)
        return self

    def implant(self, n: int, part: Lattice) -> Lattice:
        """A sub-lattice in place of a node."""
        shift = max(self.words) + 1
        for m, w in part.words.items():
            self.node(m + shift, w)
        for a, b, w in part.edges():
            self.edge(a + shift, b + shift, w)
        for a, targets in list(self.out.items()):
            if n in targets:
                self.edge(a, part.start + shift, targets[n])
        for b, w in self.out.get(n, {}).items():
            self.edge(part.end + shift, b, w)
        self.remove(n)
        return self

    def union(self, other: Lattice) -> Lattice:
        shift = max(self.words) + 1
        for m, w in other.words.items():
            self.node(m + shift, w)
        for a, b, w in other.edges():
            self.edge(a + shift, b + shift, w)
        self.edge(self.start, other.start + shift)
        self.edge(other.end + shift, self.end)
        return self

    def concat(self, other: Lattice) -> Lattice:
        shift = max(self.words) + 1
        for m, w in other.words.items():
            self.node(m + shift, w)
        for a, b, w in other.edges():
            self.edge(a + shift, b + shift, w)
        self.edge(self.end, other.start + shift)
        self.end = other.end + shift
        return self

    def add_path(self, words: Sequence[str], weight: float = 0.0) -> Lattice:
        last = self.start
        for k, w in enumerate(words):
            n = self.new(w)
            self.edge(last, n, weight if k == 0 else 0.0)
            last = n
        self.edge(last, self.end, 0.0 if words else weight)
        return self

    # -- weights --

    def forward(self, scale: float = 1.0) -> dict[int, float]:
        alpha = {self.start: 0.0}
        for a in self.order():
            for b, w in self.out.get(a, {}).items():
                alpha[b] = add(alpha.get(b, ZERO), alpha.get(a, ZERO) + w / scale)
        return alpha

    def backward(self, scale: float = 1.0) -> dict[int, float]:
        beta = {self.end: 0.0}
        for a in reversed(self.order()):
            if a != self.end:
                beta[a] = total(w / scale + beta.get(b, ZERO) for b, w in self.out.get(a, {}).items())
        return beta

    def posteriors(self, scale: float = 1.0) -> dict[int, float]:
        """Posterior probability of each node."""
        a, b = self.forward(scale), self.backward(scale)
        z = b.get(self.start, ZERO)
        return {n: 10 ** (a.get(n, ZERO) + b.get(n, ZERO) - z) if z > ZERO else 0.0 for n in self.words}

    def edge_posteriors(self, scale: float = 1.0) -> dict[tuple[int, int], float]:
        a, b = self.forward(scale), self.backward(scale)
        z = b.get(self.start, ZERO)
        return {(x, y): min(1.0, 10 ** (a.get(x, ZERO) + w / scale + b.get(y, ZERO) - z)) if z > ZERO else 0.0 for x, y, w in self.edges()}

    def max_min_posterior(self, scale: float = 1.0) -> float:
        """The largest over paths of the least node posterior."""
        post, best = self.posteriors(scale), {self.start: 1.0}
        back = self.into()
        for n in self.order():
            if n != self.start:
                best[n] = min(post[n], max((best.get(m, 0.0) for m in back[n]), default=0.0))
        return best.get(self.end, 0.0)

    def prune(self, threshold: float, scale: float = 1.0) -> Lattice:
        """Without nodes whose posterior is under the threshold times the largest least posterior of a path."""
        floor = threshold * self.max_min_posterior(scale)
        post = self.posteriors(scale)
        for n in [n for n, p in post.items() if p < floor and n not in (self.start, self.end)]:
            self.remove(n)
        return self.useful()

    def viterbi(self) -> tuple[float, list[str]]:
        score, path = next(iter(self.nbest(1)), (ZERO, []))
        return score, path

    def nbest(self, n: int, duplicates: bool = False) -> list[tuple[float, list[str]]]:
        """Best paths by A* with exact completion scores; of paths with equal words the best only, unless asked."""
        rest = {self.end: 0.0}
        for a in reversed(self.order()):
            if a != self.end:
                rest[a] = max((w + rest.get(b, ZERO) for b, w in self.out.get(a, {}).items()), default=ZERO)
        heap, tick, found, seen = [(-rest.get(self.start, ZERO), 0, self.start, 0.0, ())], 0, [], set()
        while heap and len(found) < n:
            _, _, node, score, path = heapq.heappop(heap)
            if node == self.end:
                if duplicates or path not in seen:
                    seen.add(path)
                    found.append((score, list(path)))
                continue
            for b, w in sorted(self.out.get(node, {}).items()):
                if rest.get(b, ZERO) > ZERO and w > ZERO:
                    tick += 1
                    word = self.words[b]
                    heapq.heappush(heap, (-(score + w + rest[b]), tick, b, score + w, path if word is None else (*path, word)))
        return found

    def decode(self, model, weight: float = 1.0, beam: float = 0.0, n: int = 1, end: str = "</s>") -> list[tuple[float, list[str]]]:
        """Best word strings under lattice weights plus a language model; paths are merged by the context the model tells apart."""
        rest = {self.end: 0.0}
        for a in reversed(self.order()):
            if a != self.end:
                rest[a] = max((w + rest.get(b, ZERO) for b, w in self.out.get(a, {}).items()), default=ZERO)
        floor = rest.get(self.start, ZERO) - beam if beam else ZERO
        states: dict[int, dict[tuple, list[tuple[float, tuple]]]] = defaultdict(dict)
        states[self.start][("<s>",)] = [(0.0, ())]
        for a in self.order():
            for ctx, items in states.get(a, {}).items():
                for b, w in self.out.get(a, {}).items():
                    word = self.words[b] if b != self.end else end
                    lm = model.log_prob(word, ctx) if word is not None else 0.0
                    if lm == ZERO:
                        lm = -100.0 if word is not None else 0.0
                    after = model.used((*ctx, word)) if word is not None else ctx
                    for score, path in items:
                        new = score + w + weight * lm
                        if beam and score + w + rest.get(b, ZERO) < floor:
                            continue
                        grown = path if word is None or b == self.end else (*path, word)
                        slot = states[b].setdefault(after, [])
                        slot.append((new, grown))
                        slot.sort(key=lambda x: (-x[0], x[1]))
                        del slot[n:]
        ends = [x for items in states.get(self.end, {}).values() for x in items]
        ends.sort(key=lambda x: (-x[0], x[1]))
        return [(s, list(p)) for s, p in ends[:n]]

    def expand(self, model, replace: bool = True, end: str = "</s>") -> Lattice:
        """Nodes split by language model context; edge weights replaced by (or added to) the model's."""
        new = Lattice(0, 1)
        place = {(self.start, ("<s>",)): 0}
        for a in self.order():
            for (n, ctx), m in [x for x in place.items() if x[0][0] == a]:
                for b, w in self.out.get(n, {}).items():
                    word = self.words[b] if b != self.end else end
                    lm = model.log_prob(word, ctx) if word is not None else 0.0
                    if b == self.end:
                        new.edge(m, 1, lm if replace else w + lm)
                        continue
                    after = model.used((*ctx, word)) if word is not None else ctx
                    key = (b, after)
                    if key not in place:
                        place[key] = new.new(word)
                    new.edge(m, place[key], lm if replace else w + lm)
        return new.useful()

    # -- reduction and measures --

    def pack(self) -> Lattice:
        """Merge nodes with the same word and the same successors, last first, then with the same predecessors."""
        for flip in (False, True):
            order = self.order()
            seen: dict[tuple, int] = {}
            for n in order if flip else reversed(order):
                if n in (self.start, self.end) or n not in self.words:
                    continue
                near = self.into()[n] if flip else self.out.get(n, {})
                key = (self.words[n], tuple(sorted(near.items())))
                if key in seen:
                    keep = seen[key]
                    if flip:
                        for b, w in self.out.get(n, {}).items():
                            self.edge(keep, b, w)
                    else:
                        for a, targets in list(self.out.items()):
                            if n in targets:
                                self.edge(a, keep, targets[n])
                    self.remove(n)
                else:
                    seen[key] = n
        return self

    def collapse(self) -> Lattice:
        """Merge successors of a node that have the same word."""
        for a in self.order():
            if a not in self.words:
                continue
            first: dict[str | None, int] = {}
            for b in sorted(self.out.get(a, {})):
                w = self.words.get(b)
                if w is None or b == self.end:
                    continue
                if w in first:
                    keep = first[w]
                    if keep in self.reachable(b) or b in self.reachable(keep):
                        continue
                    for c, x in list(self.out.get(b, {}).items()):
                        self.edge(keep, c, x)
                    for p, targets in list(self.out.items()):
                        if b in targets:
                            self.edge(p, keep, targets[b])
                    self.remove(b)
                else:
                    first[w] = b
        return self

    def reachable(self, n: int) -> set[int]:
        seen, stack = set(), [n]
        while stack:
            for b in self.out.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        return seen

    def entropy(self, scale: float = 1.0) -> float:
        """Entropy in bits of the paths."""
        post, a, b = self.edge_posteriors(scale), self.forward(scale), self.backward(scale)
        z = b.get(self.start, ZERO)
        return -sum(p * (w / scale) for (x, y), p in post.items() for w in [self.out[x][y]]) / math.log10(2) + z / math.log10(2) if z > ZERO and a else 0.0

    def density(self, duration: float) -> float:
        return len(self.words) / duration if duration > 0 else math.inf

    def error(self, ref: Sequence[str]) -> int:
        """The least word errors of any path."""
        m = len(ref)
        rows = {self.start: list(range(m + 1))}
        back = self.into()
        for n in self.order():
            if n == self.start:
                continue
            best = [min(rows[a][j] for a in back[n] if a in rows) for j in range(m + 1)]
            word = self.words[n]
            if word is not None:
                row = [best[0] + 1]
                for j in range(1, m + 1):
                    row.append(min(best[j - 1] + (word != ref[j - 1]), best[j] + 1, row[j - 1] + 1))
                best = row
            else:
                for j in range(1, m + 1):
                    best[j] = min(best[j], best[j - 1] + 1)
            rows[n] = best
        return rows.get(self.end, [m] * (m + 1))[m]

    def expected_ngrams(self, order: int, scale: float = 1.0) -> dict[tuple[str, ...], float]:
        """Expected counts of all n-grams up to the order, boundaries included."""
        beta = self.backward(scale)
        z = beta.get(self.start, ZERO)
        front: dict[int, dict[tuple[str, ...], float]] = defaultdict(dict)
        front[self.start][("<s>",)] = 0.0
        out: dict[tuple[str, ...], float] = defaultdict(float)
        for a in self.order():
            for ctx, value in front.get(a, {}).items():
                for b, w in self.out.get(a, {}).items():
                    word = self.words[b] if b != self.end else "</s>"
                    reach = value + w / scale
                    p = min(1.0, 10 ** (reach + beta.get(b, ZERO) - z)) if z > ZERO else 0.0
                    if word is None:
                        after = ctx
                    else:
                        whole = (*ctx, word)
                        for k in range(1, min(order, len(whole)) + 1):
                            out[whole[-k:]] += p
                        after = whole[-(order - 1) :] if order > 1 else ()
                    front[b][after] = add(front[b].get(after, ZERO), reach)
        return dict(out)

    def index(self, order: int, scale: float = 1.0, least: float = 0.0) -> list[tuple[tuple[str, ...], float, float, float]]:
        """N-grams with start and end time and expected count."""
        beta, alpha = self.backward(scale), self.forward(scale)
        z = beta.get(self.start, ZERO)
        found: dict[tuple, float] = defaultdict(float)

        def grow(n: int, words: tuple[str, ...], began: float, value: float) -> None:
            word = self.words.get(n)
            here = words if word is None else (*words, word)
            if word is not None:
                found[(here, began, self.times.get(n, 0.0))] += 10 ** (value + beta.get(n, ZERO) - z)
            if len(here) < order:
                for b, w in self.out.get(n, {}).items():
                    if b != self.end:
                        grow(b, here, began, value + w / scale)

        back = self.into()
        for n in self.order():
            if self.words.get(n) is not None:
                began = max((self.times.get(a, 0.0) for a in back[n]), default=0.0)
                grow(n, (), began, alpha.get(n, ZERO))
        return sorted((g, s, e, p) for (g, s, e), p in found.items() if p >= least)

    def to_mesh(self, scale: float = 1.0) -> Mesh:
        """A confusion network: the best path first, then the other paths' words in order of posterior, by alignment."""
        post = self.posteriors(scale)
        mesh = Mesh()
        paths = self.nbest(50)
        if not paths:
            return mesh
        top = paths[0][0]
        weights = [10 ** ((s - top) / scale) for s, _ in paths]
        norm = sum(weights)
        for (_, words), w in zip(paths, weights, strict=True):
            mesh.add(words, w / norm)
        return mesh if post else mesh

    def prefix_prob(self, words: Sequence[str]) -> list[float]:
        """Log probability of each prefix of a word string through the lattice, relative to all paths."""
        beta = self.backward()
        z = beta.get(self.start, ZERO)
        now, out = {self.start: 0.0}, []
        for word in words:
            now = self._closure(now)
            new: dict[int, float] = {}
            for a, v in now.items():
                for b, w in self.out.get(a, {}).items():
                    if self.words[b] == word:
                        new[b] = add(new.get(b, ZERO), v + w)
            now = new
            out.append(total(v + beta.get(n, ZERO) for n, v in now.items()) - z)
        ended = self._closure(now)
        out.append(ended.get(self.end, ZERO) - z)
        return out

    def _closure(self, states: dict[int, float]) -> dict[int, float]:
        """States reached through null nodes as well."""
        out = dict(states)
        for a in self.order():
            if a in out:
                for b, w in self.out.get(a, {}).items():
                    if self.words[b] is None:
                        out[b] = add(out.get(b, ZERO), out[a] + w)
        return out


def automaton_of_model(probs: Sequence[tuple[str, str, float]], bows: Sequence[tuple[str, float]]) -> tuple[list[tuple[int, str | None]], list[tuple[int, int, float]]]:
    """Nodes (id, word or None) and edges (source, target, log weight) of a bigram model as a word graph with a back-off node."""
    words = sorted({w for _, w, _ in probs if w not in ("<s>", "</s>")})
    place = {w: k + 3 for k, w in enumerate(words)}
    place |= {"<s>": 0, "</s>": 1}
    nodes = [(0, None), (1, None), (2, None), *[(place[w], w) for w in words]]
    edges = [(place[c], 2, b) for c, b in bows if c in place]
    for ctx, w, p in probs:
        if p > ZERO and w in place and w != "<s>":
            if not ctx:
                edges.append((2, place[w], p))
            elif ctx in place:
                edges.append((place[ctx], place[w], p))
    return nodes, edges
