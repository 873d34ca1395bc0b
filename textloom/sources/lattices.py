"""Lattice and confusion-network files: parsers and writers of single files, and readers of folders of them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.kernels.align import Mesh
from textloom.kernels.lattice import Lattice

NULL_WORDS = {"!NULL", "NULL"}
#: Field names of time-aligned lattices and their long forms.
LONG_NAMES = {"START": "S", "END": "E", "WORD": "W", "var": "v", "div": "d", "states": "s", "acoustic": "a", "ngram": "n", "language": "l", "NODES": "N", "LINKS": "L"}
FIELD = re.compile(r"""([A-Za-z][A-Za-z0-9]*)=("(?:[^"\\]|\\.)*"|\S+)""")


def fields_of(line: str) -> dict[str, str]:
    return {LONG_NAMES.get(k, k): v[1:-1] if v.startswith('"') else v for k, v in FIELD.findall(line)}


def parse_slf(text: str, scales: dict[str, float] | None = None, penalty: float = 0.0) -> Lattice:
    """A lattice of nodes I= and links J=; scores are combined with scales, natural logs by default become base 10."""
    header: dict[str, str] = {}
    nodes: dict[int, dict[str, str]] = {}
    links: list[dict[str, str]] = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        f = fields_of(line)
        if "I" in f:
            nodes[int(f["I"])] = f
        elif "J" in f:
            links.append(f)
        else:
            header |= f
    base = float(header.get("base", math.e))
    unit = math.log10(base) if base > 0 and base != 1 else 1.0
    weights = {"a": float(header.get("acscale", 1.0)), "l": float(header.get("lmscale", 1.0)), "n": float(header.get("ngscale", 0.0)), "r": float(header.get("prscale", 0.0)), "ds": float(header.get("duscale", 0.0))}
    weights |= {f"x{k}": float(header.get(f"x{k}scale", 0.0)) for k in range(1, 10)} | (scales or {})
    penalty = penalty or float(header.get("wdpenalty", 0.0))
    start = int(header.get("start", header.get("initial", min(nodes, default=0))))
    end = int(header.get("end", header.get("final", max(nodes, default=1))))
    lat = Lattice(start, end)
    for n, f in nodes.items():
        word = f.get("W")
        lat.node(n, None if word is None or word in NULL_WORDS or n in (start, end) else word, float(f["t"]) if "t" in f else None)
    extra = max(nodes, default=1) + 1
    for f in links:
        a, b, word = int(f["S"]), int(f["E"]), f.get("W")
        real = word is not None and word not in NULL_WORDS
        score = sum(float(f[k]) * unit * w for k, w in weights.items() if k in f) + (penalty if real or nodes.get(b, {}).get("W") else 0.0)
        if real:
            m = lat.node(extra, word, lat.times.get(b))
            extra += 1
            lat.edge(a, m, score)
            lat.edge(m, b, 0.0)
        else:
            lat.edge(a, b, score)
    return lat


def format_slf(lat: Lattice) -> str:
    order = {n: k for k, n in enumerate(lat.order())}
    out = ["VERSION=1.1", "base=10", f"N={len(order)} L={sum(1 for a, b, _ in lat.edges() if a in order and b in order)}", f"start={order[lat.start]} end={order[lat.end]}"]
    for n, k in order.items():
        time = f" t={lat.times[n]:g}" if n in lat.times else ""
        out.append(f"I={k}{time} W={lat.words[n] if lat.words[n] is not None else '!NULL'}")
    rows = sorted((order[a], order[b], w) for a, b, w in lat.edges() if a in order and b in order)
    return "\n".join([*out, *(f"J={j} S={a} E={b} a={w:.9g}" for j, (a, b, w) in enumerate(rows))]) + "\n"


def parse_pfsg(text: str, scale: float = 10000.5) -> Lattice:
    """A finite-state grammar: names, nodes, one initial and final node, transitions with integer logs; grammars named by a node are implanted."""
    grammars: dict[str, Lattice] = {}
    first, name, words, ends, edges = None, None, [], (0, 1), []
    tokens = text.split()

    def finish() -> None:
        if name is not None:
            lat = Lattice(*ends)
            for k, w in enumerate(words):
                lat.node(k, None if w == "NULL" else w)
            for a, b, w in edges:
                lat.edge(a, b, w / scale / math.log(10))
            grammars[name] = lat

    at = 0
    while at < len(tokens):
        key = tokens[at]
        if key == "name":
            finish()
            name, words, edges = tokens[at + 1], [], []
            first = first or name
            at += 2
        elif key == "nodes":
            n = int(tokens[at + 1])
            words = tokens[at + 2 : at + 2 + n]
            at += 2 + n
        elif key == "initial":
            ends = (int(tokens[at + 1]), ends[1])
            at += 2
        elif key == "final":
            ends = (ends[0], int(tokens[at + 1]))
            at += 2
        elif key == "transitions":
            n = int(tokens[at + 1])
            flat = tokens[at + 2 : at + 2 + 3 * n]
            edges = [(int(flat[k]), int(flat[k + 1]), float(flat[k + 2])) for k in range(0, 3 * n, 3)]
            at += 2 + 3 * n
        else:
            at += 1
    finish()
    main = grammars.get(first, Lattice())
    for _ in range(100):
        inner = [n for n, w in main.words.items() if w in grammars and w != first]
        if not inner:
            break
        for n in inner:
            main.implant(n, grammars[main.words[n]].copy())
    return main


def format_pfsg(lat: Lattice, name: str = "lattice", scale: float = 10000.5) -> str:
    order = {n: k for k, n in enumerate(lat.order())}
    words = " ".join(lat.words[n] if lat.words[n] is not None else "NULL" for n in order)
    rows = sorted((order[a], order[b], w) for a, b, w in lat.edges() if a in order and b in order)
    body = "\n".join(f"{a} {b} {round(w * scale * math.log(10))}" for a, b, w in rows)
    return f"name {name}\nnodes {len(order)} {words}\ninitial {order[lat.start]}\nfinal {order[lat.end]}\ntransitions {len(rows)}\n{body}\n"


def parse_mesh(text: str) -> Mesh:
    """``numaligns``, ``posterior`` and ``align k word post ...`` lines."""
    columns: dict[int, dict[str | None, float]] = {}
    total = 1.0
    for line in text.splitlines():
        f = line.split()
        if not f:
            continue
        if f[0] == "posterior":
            total = float(f[1])
        elif f[0] == "align":
            columns[int(f[1])] = {None if w == "*DELETE*" else w: float(p) for w, p in zip(f[2::2], f[3::2], strict=True)}
    return Mesh([columns[k] for k in sorted(columns)], total)


def format_mesh(mesh: Mesh) -> str:
    out = [f"numaligns {len(mesh.columns)}", f"posterior {mesh.total:g}"]
    for k, column in enumerate(mesh.columns):
        items = sorted(column.items(), key=lambda x: (-x[1], x[0] or ""))
        out.append(f"align {k} " + " ".join(f"{w if w is not None else '*DELETE*'} {p:.9g}" for w, p in items))
    return "\n".join(out) + "\n"


def read_files(spark: SparkSession, path: str, parse: Callable[[str], Lattice] = parse_slf) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every lattice file of a folder; a lattice's id is its file name."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.gz)?$", 1).alias("lat"), F.col("value").alias("text"))

    def nodes(batches):
        for batch in batches:
            yield pd.DataFrame([(x, n, w) for x, t in zip(batch["lat"], batch["text"], strict=True) for n, w in _numbered(parse(t))[0]], columns=["lat", "node", "word"])

    def edges(batches):
        for batch in batches:
            yield pd.DataFrame([(x, *e) for x, t in zip(batch["lat"], batch["text"], strict=True) for e in _numbered(parse(t))[1]], columns=["lat", "src", "dst", "weight"])

    return files.mapInPandas(nodes, "lat string, node int, word string"), files.mapInPandas(edges, "lat string, src int, dst int, weight double")


def _numbered(lat: Lattice) -> tuple[list[tuple[int, str | None]], list[tuple[int, int, float]]]:
    """Nodes and edges with the start as 0 and the end as 1."""
    place = {lat.start: 0, lat.end: 1}
    for n in sorted(lat.words):
        place.setdefault(n, len(place))
    return [(place[n], w) for n, w in lat.words.items()], [(place[a], place[b], w) for a, b, w in lat.edges()]
