"""Chat formatting by schema fingerprints; DataFrame and SQL functions only.

The nested field paths of a table are hashed to fingerprints that select a declarative mapping from that
layout (turn rows, message lists, prompt and completion, instruction and output, ...) to canonical turns:
one row per conversation and turn with a role and a text. A layout is present if the table's paths, cut down
to those the layout speaks of, have the layout's fingerprint; of several the first in ``LAYOUTS`` is taken, which
goes from the most to the least particular. So extra columns, whatever their names, neither hide a layout nor
reach the output. JSON records of mixed layouts are fingerprinted row by row; a record of no known layout is
kept as one turn of role ``unknown`` that holds the record.

The template writes a turn as ``<turn>role`` line feed ``text</turn>`` line feed. Inside roles and texts a
backslash becomes ``\\s`` and the ``<`` of a control string becomes ``\\l`` (in roles a line feed becomes
``\\n``), so no text can contain a marker and unescaping gives back every text exactly. The output is the
formatted string and the loss mask: the spans of the learned texts in it, each as the place of its turn, the start
in that turn (both from 1) and the length, in code points, so that reading them takes time in proportion to the string.

Null roles and texts are empty, also those of parts such as an input; a null conversation id is an id of its own;
rows are ordered by turn (null first), ties by role, then text; repeated rows are turns of their own; an empty table
gives an empty result; texts of any length stay whole. A conversation's output is one string, so its rows meet in
one task in the end: each text travels there once, and is escaped there.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<turn>", "</turn>"


@dataclass(frozen=True)
class Layout:
    """``rows``: (id, order, role, text) columns. ``items``: (list, role field, text field). ``fields``: (role, column) in order."""

    name: str
    rows: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.items:
            return sorted([self.items[0], *(f"{self.items[0]}[].{f}" for f in self.items[1:])])
        return sorted(c for _, c in self.fields)


#: From the most to the least particular: a table that has several layouts is read by the first.
LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("instruction, input and output", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system, prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction and output", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
)
#: Speaker names of list layouts and the roles they stand for.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def digest(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {digest(layout.paths()): layout for layout in LAYOUTS}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths: ``a``, ``a.b`` of structs, ``a[].b`` of lists of structs."""
    out: list[str] = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            name = f"{prefix}.{f.name}" if prefix else f.name
            out += [name, *field_paths(f.dataType, name)]
    elif isinstance(schema, T.ArrayType):
        out += field_paths(schema.elementType, f"{prefix}[]")
    return out


def fingerprint(schema: T.StructType) -> str | None:
    """The fingerprint of the layout that the table has, or nothing."""
    have = field_paths(schema)
    for layout in LAYOUTS:
        found = digest([p for p in have if p in layout.paths()])
        if MAPPINGS.get(found) is layout:
            return found
    return None


def canonical_turns(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` of a table whose fingerprint is known."""
    layout = MAPPINGS.get(fingerprint(df.schema))
    if layout is None:
        raise ValueError(f"no mapping for the fields {field_paths(df.schema)}")
    if layout.rows:
        conv, turn, role, text = (F.col(f"`{c}`") for c in layout.rows)
        return df.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    key = F.col(f"`{id_col}`") if id_col else F.monotonically_increasing_id()
    if layout.items:
        name, role, text = layout.items
        flat = df.select(key.alias("conv"), F.posexplode(F.col(f"`{name}`")).alias("turn", "_item"))
        said = F.col("_item").getField(role)
        named = F.coalesce(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])[said], said) if name == "conversations" else said
        return flat.select("conv", "turn", named.alias("role"), F.col("_item").getField(text).alias("text"))
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"`{c}`").cast("string").alias("text")) for r, c in layout.fields])
    flat = df.select(key.alias("conv"), F.posexplode(turns).alias("turn", "_item"))
    return flat.select("conv", "turn", "_item.role", "_item.text")


def record_paths(record: Column) -> Column:
    """The field paths of one JSON record: its fields, and the fields of the first item of its lists."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    values = F.from_json(record, "map<string,string>")
    nested = F.flatten(
        F.transform(
            F.filter(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))), lambda e: e["value"].startswith("[")),
            lambda e: F.transform(
                F.coalesce(F.json_object_keys(F.get_json_object(e["value"], "$[0]")), F.array().cast("array<string>")),
                lambda k: F.concat(e["key"], F.lit("[]."), k),
            ),
        )
    )
    return F.concat(top, nested)


def record_fingerprint(paths: Column, layout: Layout) -> Column:
    """The fingerprint of a record's paths, of those that the layout speaks of."""
    mine = F.array(*[F.lit(p) for p in layout.paths()])
    return F.sha2(F.array_join(F.sort_array(F.array_intersect(paths, mine)), "\n"), 256)


def _turn_reader(role: str, text: str, speakers: Column | None):
    """Reads a list item as a canonical turn."""

    def read(item: Column) -> Column:
        said = item[role] if speakers is None else F.coalesce(speakers[item[role]], item[role])
        return F.struct(said.alias("role"), item[text].alias("text"))

    return read


def canonical_records(df: DataFrame, record: str, id_col: str) -> DataFrame:
    """Turns of JSON records of mixed layouts; a record of no known layout is one turn of role ``unknown``."""
    marked = df.select(F.col(id_col).alias("conv"), F.col(record).alias("_j")).withColumn("_paths", record_paths(F.col("_j")))
    turns = F.array(F.struct(F.lit("unknown").alias("role"), F.col("_j").alias("text")))
    for layout in reversed(LAYOUTS):
        if layout.items:
            name, role, text = layout.items
            items = F.from_json(F.get_json_object("_j", f"$.{name}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            speakers = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
            made = F.transform(items, _turn_reader(role, text, speakers if name == "conversations" else None))
        elif layout.fields:
            made = F.array(*[F.struct(F.lit(r).alias("role"), F.get_json_object("_j", f"$.{c}").alias("text")) for r, c in layout.fields])
        else:
            continue
        turns = F.when(record_fingerprint(F.col("_paths"), layout) == digest(layout.paths()), made).otherwise(turns)
    flat = marked.select("conv", F.posexplode(turns).alias("turn", "_item"))
    return flat.select("conv", "turn", "_item.role", "_item.text")


# ---- template ----


def escape(text: Column) -> Column:
    safe = F.replace(text, F.lit("\\"), F.lit("\\s"))
    safe = F.replace(safe, F.lit(OPEN), F.lit("\\l" + OPEN[1:]))
    return F.replace(safe, F.lit(CLOSE), F.lit("\\l" + CLOSE[1:]))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_turns(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv``, ``formatted`` and the loss mask ``spans`` (array of start and length) of canonical turns."""
    rows = turns.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # one exchange by conversation serves the order and the string
    rows = rows.withColumn("n", F.row_number().over(order))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv", "n", head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*learned).alias("loss"))
    span = F.when(F.col("loss"), F.struct(F.col("n").alias("turn"), (F.length("head") + 1).alias("start"), F.length("body").alias("length")))
    rows = rows.select("conv", F.struct("n", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("part"), span.alias("span")).alias("t"))
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("_t"))
    spans = F.filter(F.transform("_t", lambda t: t["span"]), lambda x: x.isNotNull())
    return listed.select("conv", F.array_join(F.transform("_t", lambda t: t["part"]), "").alias("formatted"), spans.alias("spans"))


def turn_strings(text: Column) -> Column:
    """The turns of a formatted string as they stand in it, each without its end mark."""
    parts = F.split(text, CLOSE + "\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(text: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    bare = F.transform(turn_strings(text), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(
        bare,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def loss_text(turns: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, of the ``turn_strings`` of a formatted string."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(turns, s["turn"] - 1), s["start"], s["length"]))), "")
