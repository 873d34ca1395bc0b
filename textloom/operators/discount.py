"""Discounting methods.

A method gives, for an n-gram with count c in a context with total T and q types, the factor by which
its relative frequency is discounted (0 leaves it out), and the weight of the lower order if the model is
interpolated. Parameters come from counts of counts: a handful of numbers per order.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.counts import counts_of_counts
from textloom.schema import BOS, EPSILON, META, gt_max, gt_min


@dataclass
class Method:
    """Columns ``cnt``, ``total``, ``types``, ``types2``, ``types3`` and the vocabulary size ``v`` are at hand."""

    interpolate: bool = False
    min_count: float = 1

    def omitted(self) -> Column:
        return F.col("cnt") < self.min_count if self.min_count > 1 else F.lit(False)

    def factor(self, v: int) -> Column:
        return F.when(self.omitted(), F.lit(0.0)).otherwise(self.inner(v))

    def inner(self, v: int) -> Column:
        raise NotImplementedError

    def lower_weight(self, v: int) -> Column:
        return F.lit(0.0)


@dataclass
class GoodTuring(Method):
    max_count: int = 7
    factors: dict[int, float] = field(default_factory=dict)

    def inner(self, v: int) -> Column:
        out = F.lit(1.0)
        for c, d in sorted(self.factors.items(), reverse=True):
            out = F.when(F.col("cnt") == c, F.lit(float(d))).otherwise(out)
        return out


@dataclass
class Absolute(Method):
    delta: float = 0.5

    def inner(self, v: int) -> Column:
        d = min(max(self.delta, 0.0), 1.0)
        return F.when(F.col("cnt") <= 0, F.lit(1.0)).when(F.col("cnt") <= d, F.lit(0.0)).otherwise((F.col("cnt") - F.lit(d)) / F.col("cnt"))

    def lower_weight(self, v: int) -> Column:
        return F.lit(min(max(self.delta, 0.0), 1.0)) * F.col("types") / F.col("total")


@dataclass
class Natural(Method):
    def inner(self, v: int) -> Column:
        n, q = F.col("total").cast("double"), F.col("types").cast("double")
        return F.when(q == v, F.lit(1.0)).otherwise((n * (n + 1) + q * (1 - q)) / (n * (n + 1) + 2 * q))


@dataclass
class Additive(Method):
    delta: float = 1.0

    def inner(self, v: int) -> Column:
        return (1 + F.lit(self.delta) / F.col("cnt")) / (1 + F.lit(v * self.delta) / F.col("total"))


@dataclass
class WittenBell(Method):
    def inner(self, v: int) -> Column:
        return F.col("total") / (F.col("total") + F.col("types"))

    def lower_weight(self, v: int) -> Column:
        return F.col("types") / (F.col("total") + F.col("types"))


@dataclass
class KneserNey(Absolute):
    """One constant, from modified counts."""


@dataclass
class ModifiedKneserNey(Method):
    d1: float = 0.0
    d2: float = 0.0
    d3: float = 0.0

    def inner(self, v: int) -> Column:
        c = F.col("cnt")
        d = F.when(c == 1, F.lit(self.d1)).when(c == 2, F.lit(self.d2)).otherwise(F.lit(self.d3))
        return F.when(c <= 0, F.lit(1.0)).otherwise((c - d) / c)

    def lower_weight(self, v: int) -> Column:
        one, two, more = F.col("types") - F.col("types2"), F.col("types2") - F.col("types3"), F.col("types3")
        return (one * self.d1 + two * self.d2 + more * self.d3) / F.col("total")


def good_turing_factors(n: dict[int, int], max_count: int) -> dict[int, float]:
    """Factors for counts 1..max_count; out-of-range factors are 1."""
    while max_count > 0 and not n.get(max_count + 1):
        max_count -= 1
    if max_count <= 0 or not n.get(1):
        return {}
    common = (max_count + 1) * n[max_count + 1] / n[1]
    out = {}
    for k in range(1, max_count + 1):
        if not n.get(k):
            out[k] = 1.0
            continue
        r = (k + 1) * n.get(k + 1, 0) / (k * n[k])
        d = (r - common) / (1 - common) if common != 1 else math.inf
        out[k] = 1.0 if not math.isfinite(d) or d <= EPSILON or r > 1 else d
    return out


def kn_constant(n: dict[int, int]) -> float:
    if not n.get(1) or not n.get(2):
        raise ValueError("counts of one and two are needed")
    return n[1] / (n[1] + 2 * n[2])


def modified_kn_constants(n: dict[int, int]) -> tuple[float, float, float]:
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        raise ValueError("counts of one to four are needed")
    y = n[1] / (n[1] + 2 * n[2])
    d = 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]
    if min(d) < 0:
        raise ValueError("a discount is negative")
    return d


def fill_missing(n: dict[int, int | None], top: int) -> dict[int, float]:
    """Extrapolate counts of counts that are missing: log n(k) - log n(k+1) = a / k, with a averaged where it is known."""
    known = [k for k in range(1, top) if n.get(k) and n.get(k + 1)]
    if not known:
        raise ValueError("no two neighbouring counts of counts")
    a = sum(k * (math.log(n[k]) - math.log(n[k + 1])) for k in known) / len(known)
    out: dict[int, float] = {k: float(v) for k, v in n.items() if v}
    for k in range(top - 1, 0, -1):
        if k not in out and k + 1 in out:
            out[k] = math.exp(math.log(out[k + 1]) + a / k)
    for k in range(1, top):
        if k + 1 not in out and k in out:
            out[k + 1] = math.exp(math.log(out[k]) - a / k)
    return out


def count_table(counts: DataFrame, order: int, top: int, meta_adds_count: bool = True) -> dict[int, int]:
    """n(k) of one order for k up to ``top``, start symbol left out; meta words add their count (or one each)."""
    rows = counts.where((F.col("ord") == order) & (F.col("w") != BOS))
    plain = counts_of_counts(rows.where(~F.col("w").startswith(META)), top).collect()
    out = {int(r["k"]): int(r["n"]) for r in plain}
    meta = rows.where(F.col("w").startswith(META)).select(F.expr(f"try_cast(substring(w, {len(META) + 1}) as int)").alias("k"), "cnt").where("k is not null")
    for r in meta.where(F.col("k") <= top).groupBy("k").agg(F.sum("cnt").alias("a"), F.count(F.lit(1)).alias("b")).collect():
        out[r["k"]] = out.get(r["k"], 0) + int(r["a"] if meta_adds_count else r["b"])
    return out


def fit(method: str, counts: DataFrame, order: int, *, interpolate: bool = False, min_count: float | None = None, max_count: int | None = None, delta: float = 0.5) -> Method:
    """The method of an order with parameters estimated from the counts (already modified for Kneser-Ney)."""
    low = gt_min(order) if min_count is None else min_count
    if method == "gt":
        top = gt_max(order) if max_count is None else max_count
        return GoodTuring(False, low, top, good_turing_factors(count_table(counts, order, top + 1), top))
    if method == "kn":
        return KneserNey(interpolate, low, kn_constant(count_table(counts, order, 2, False)))
    if method == "mkn":
        return ModifiedKneserNey(interpolate, low, *modified_kn_constants(count_table(counts, order, 4, False)))
    simple = {"abs": lambda: Absolute(interpolate, low, delta), "wb": lambda: WittenBell(interpolate, low), "natural": lambda: Natural(False, low), "add": lambda: Additive(False, low, delta)}
    return simple[method]()


def save_parameters(method: Method) -> str:
    return json.dumps({"method": type(method).__name__, **{k: v for k, v in vars(method).items()}})


def load_parameters(text: str) -> Method:
    spec = json.loads(text)
    kind = {c.__name__: c for c in (GoodTuring, Absolute, Natural, Additive, WittenBell, KneserNey, ModifiedKneserNey)}[spec.pop("method")]
    if "factors" in spec:
        spec["factors"] = {int(k): v for k, v in spec["factors"].items()}
    return kind(**spec)


# ---- parameter files ----


def write_parameters(method: Method) -> str:
    """The parameters of a Good-Turing or Kneser-Ney method as lines of a discount file."""
    count = lambda x: str(int(x)) if float(x).is_integer() else repr(float(x))
    lines = [f"mincount {count(method.min_count)}"]
    if isinstance(method, GoodTuring):
        lines += [f"maxcount {method.max_count}"] + [f"discount {k} {method.factors.get(k, 1.0)!r}" for k in range(1, method.max_count + 1)]
    elif isinstance(method, ModifiedKneserNey):
        lines += [f"discount1 {method.d1!r}", f"discount2 {method.d2!r}", f"discount3+ {method.d3!r}"]
    elif isinstance(method, KneserNey):
        lines += [f"discount1 {method.delta!r}"]
    else:
        raise ValueError(f"{type(method).__name__} has no parameter file")
    return "\n".join(lines) + "\n"


def read_parameters(text: str, kind: str, interpolate: bool = False) -> Method:
    """The method (``gt``, ``kn``, ``mkn``) of a discount file; what it does not name keeps its default."""
    values: dict[str, float] = {}
    factors: dict[int, float] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        name, *rest = line.split()
        if name == "discount" and kind == "gt" and len(rest) == 2:
            factors[int(rest[0])] = float(rest[1])
        elif name in {"gt": ("mincount", "maxcount"), "kn": ("mincount", "discount1"), "mkn": ("mincount", "discount1", "discount2", "discount3+")}[kind] and len(rest) == 1:
            values[name] = float(rest[0])
        else:
            raise ValueError(f"unrecognized parameter: {line}")
    low = values.get("mincount", 1)
    if kind == "gt":
        top = int(values.get("maxcount", max(factors, default=0)))
        return GoodTuring(False, low, top, {k: factors.get(k, 0.0) for k in range(1, top + 1)} | {k: d for k, d in factors.items() if k > top})
    if kind == "kn":
        return KneserNey(interpolate, low, values.get("discount1", 0.0))
    return ModifiedKneserNey(interpolate, low, values.get("discount1", 0.0), values.get("discount2", 0.0), values.get("discount3+", 0.0))
