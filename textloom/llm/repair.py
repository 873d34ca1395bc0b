"""Conversation structure repair by a dynamic programme over the turns that are retained.

A conversation's role initials shall read ``(s?(ua)+)?``. Turns are kept (0), reroled to user or assistant (2) or
deleted (3), empty user or assistant turns are inserted (2 each); a blank turn and a duplicate have to go, and a
truncated turn that stays costs 1. Of all cheapest lists of edits the one whose initials (D, I, K, R, in order) come first wins.

The programme runs from the end and decides for retained turns only: between two of them everything is deleted, priced
by prefix sums of the deletions, so all that a turn needs of the turns behind it is one running minimum for each role
(and the end). The roles of two neighbours tell what is inserted between them. Equal costs need no lists to compare: in
the first place where two lists differ, a later next turn has D, then more insertions have I, then K comes before R.

Any number of tasks may share a conversation: rows are range-partitioned by conversation and place, and only numbers
meet. For a conversation cut by the partitioning each part first tells its running minima as functions of those behind it
(a small min-plus matrix), these are combined for the few parts, and then each part decides by itself. Texts stay out
of all this; a row carries a digest. Only a digest over a whole conversation's text (``digests``) reads its turns in one
task, in order, one after another, since a hash has no parts.

Defined results. Rows of a conversation are ordered by turn (nulls first), role, and text (its first 64 characters,
then its SHA-256). Null conversation, turn, role and text: a null conversation is a conversation, a null turn comes
first, null role and text count as one space. A role without initial (empty) can't be kept. Rows equal in conversation,
turn, role and text travel as one with their number; all but the first are duplicates. A conversation with no rows has no
edits. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, shuffle_width

KEEP, REROLE, DELETE, INSERT, SHORT = 0, 2, 3, 2, 1
#: What may follow a turn: nothing (also: the start before all turns), or a retained turn of this role.
END, SYSTEM, USER, ASSISTANT = range(4)
INITIALS, WORDS = ("", "s", "u", "a"), ("", "system", "user", "assistant")
#: More than any cost, and the place of the end, behind that of any row.
FAR, LAST = 1 << 60, 1 << 62
#: Roles inserted between what stands before (the start, or a role) and what follows it (the end, or a role); None: not possible.
BETWEEN = [["", "", "", "u"], ["ua", None, "", "u"], ["a", None, "a", ""], ["", None, "", "u"]]
PLACE = ["turn", "role", "start", "digest"]


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (``conv``, ``turn``, ``role``, ``text``) with a fault in about a quarter of them, by a checksum of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _start(text: Column) -> Column:
    return F.substring(text, 1, 64)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def faults(rows: DataFrame) -> DataFrame:
    """One row for all equal ones: place (``turn``, ``role``, ``start``, ``digest``), their number ``n``, whether they are ``blank``, ``truncated``, ``seen`` earlier.

    Neither step has a hot key: equal rows are combined before they are sent, and first places join on what no two rows share.
    """
    text = F.coalesce("text", F.lit(" "))
    shown = F.rtrim(F.translate(text, "\t\n\x0b\f\r", "     "))
    end = F.substring(shown, -1, 1)
    facts = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), _start(text).alias("start"), _digest(text).alias("digest"), (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("truncated"))
    one = cut(facts.groupBy("conv", *PLACE).agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")))
    # the place of a text in its conversation is that of its turn, nulls first
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    first = one.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place)["turn"].alias("t"), F.lit(True).alias("leads"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    return one.join(first, same, "left").select("conv", *PLACE, "n", "blank", "truncated", F.col("leads").isNull().alias("seen"))


def ordered(found: DataFrame) -> DataFrame:
    """Rows in order, dealt to slices by conversation and place; a long conversation has several slices."""
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("start"), F.col("digest")]
    dealt = found.repartitionByRange(shuffle_width(found.sparkSession), *keys).sortWithinPartitions(*keys)
    return cut(dealt.withColumn("slice", F.spark_partition_id()))


# ---- the programme for one part of one conversation ----

#: Least cost of what follows if it begins with a role (or is the end), where that turn stands, whether it is reroled, and which choice this is.
Way = tuple[int, int, int, int]
NOTHING: list[Way] = [(0, LAST, 0, -1), (FAR, LAST, 0, -1), (FAR, LAST, 0, -1), (FAR, LAST, 0, -1)]


def picks(least: list[Way], gone: int) -> list[tuple[int, int, int]]:
    """For the start and each role before: cost, role and choice of the best that may follow a gap that begins where ``gone`` is deleted."""
    out = []
    for before in BETWEEN:
        found = None
        for role, put in enumerate(before):
            cost, late, changed, choice = least[role]
            if put is None or cost >= FAR:
                continue
            rank = (cost + INSERT * len(put) - gone, -late, -len(put), changed)
            if found is None or rank < found[0]:
                found = rank, role, choice
        out.append((found[0][0], found[1], found[2]) if found else (FAR, END, -1))
    return out


def decide(rows: dict[str, list], base: int, behind: list[Way]) -> tuple[list[Way], list[list[tuple[int, int, int]]]]:
    """The running minima before a part, given those behind it, and for each row what follows if it is retained.

    ``base`` is the place of the part's first row. The first entry of what follows belongs to the gap before the part. Choices are
    row numbers of the part, or -1 for what lies behind it.
    """
    times, total = rows["n"], DELETE * sum(rows["n"])
    least = [(min(w[0] + total, FAR), w[1], w[2], -1) for w in behind]
    follow, gone = [], total
    for k in range(len(times) - 1, -1, -1):
        next_up = picks(least, gone)
        follow.append(next_up)
        gone -= DELETE * times[k]
        if rows["blank"][k] or rows["seen"][k]:
            continue
        initial, extra = rows["role"][k][:1], DELETE * (times[k] - 1) + SHORT * rows["truncated"][k] + gone
        for role in (SYSTEM, USER, ASSISTANT):
            kept = initial == INITIALS[role]
            if role == SYSTEM and not kept:
                continue
            cost = next_up[role][0] + extra + (KEEP if kept else REROLE)
            if cost < least[role][0]:
                least[role] = (cost, base + k, int(not kept), k)
    follow.append(picks(least, 0))
    return least, follow[::-1]


def walk(rows: dict[str, list], follow: list, before: int) -> tuple[list[str], list[str], list[str], int]:
    """Action, inserted roles and final role of each row of a part, and the role that stands before what lies behind it."""
    size = len(rows["n"])
    action, lead, final = [DELETE_SIGN] * size, [""] * size, [""] * size
    _, role, k = follow[0][before]
    while k >= 0:
        kept = rows["role"][k][:1] == INITIALS[role]
        action[k], lead[k], final[k] = "K" if kept else "R", BETWEEN[before][role], rows["role"][k] if kept else WORDS[role]
        before = role
        _, role, k = follow[k + 1][before]
    return action, lead, final, before


DELETE_SIGN = "D"
ROWS = ["conv", "slice", *PLACE, "n", "blank", "truncated", "seen"]
EDITS = [*ROWS, "place", "action", "lead", "final", "tail"]


def parts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """The rows of one conversation in one slice at a time; narrow rows, at most those of the slice."""
    key, rows = None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in names}
        keys = list(zip(columns["slice"], columns["conv"], strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if rows is None or keys[at] != key:
                if rows is not None:
                    yield rows
                key, rows = keys[at], {n: [] for n in names}
            for n in names:
                rows[n] += columns[n][at:end]
            at = end
    if rows is not None:
        yield rows


def tell_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part, what its running minima are if only one thing may lie behind it: 4 times 4 (cost, place or -1, reroled)."""
    for rows in parts(batches, ["chain", "base", *ROWS]):
        ways = []
        for x in range(4):
            behind = [(0 if y == x else FAR, LAST, 0, -1) for y in range(4)]
            ways += [v for w in decide(rows, rows["base"][0], behind)[0] for v in (w[0], w[1] if w[3] >= 0 else -1, w[2])]
        yield told_batch(rows, ways)


def tell_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part and each role before it, the last role retained in it (or that before)."""
    for rows in parts(batches, ["chain", "base", "behind", *ROWS]):
        follow = decide(rows, rows["base"][0], ways_of(rows["behind"][0]))[1]
        yield told_batch(rows, [walk(rows, follow, before)[3] for before in range(4)])


def told_batch(rows: dict[str, list], told: list[int]) -> pa.RecordBatch:
    whose = {n: pa.array([rows[n][0]], pa.int32()) for n in ("chain", "slice")}
    return pa.RecordBatch.from_pydict({**whose, "told": pa.array([told], pa.list_(pa.int64()))})


def ways_of(numbers: list[int] | None) -> list[Way]:
    """Running minima from (cost, place, reroled) of each; without them, the end."""
    if numbers is None:
        return NOTHING
    return [(numbers[3 * x], numbers[3 * x + 1], numbers[3 * x + 2], -1) for x in range(4)]


def through(told: list[int], behind: list[Way]) -> list[Way]:
    """Running minima before a part from those behind it: the min-plus product of its matrix, ties to the later turn."""
    out = []
    for role in range(4):
        found = []
        for x in range(4):
            cost, late, changed = told[12 * x + 3 * role : 12 * x + 3 * role + 3]
            cost += behind[x][0]
            if cost < FAR:
                found.append((cost, -behind[x][1], behind[x][2]) if late < 0 else (cost, -late, changed))
        best = min(found, default=(FAR, -LAST, 0))
        out.append((best[0], -best[1], best[2], -1))
    return out


def tell_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The decision of each row."""
    held: list[dict[str, list]] = []
    kinds: dict[str, pa.DataType] = {}

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds.update({f.name: f.type for f in batch.schema})
            yield batch

    def flush() -> pa.RecordBatch:
        told = {"place": pa.int64(), "action": pa.string(), "lead": pa.string(), "final": pa.string(), "tail": pa.string()}
        return pa.RecordBatch.from_pydict({n: pa.array([v for rows in held for v in rows[n]], told.get(n) or kinds[n]) for n in EDITS})

    for rows in parts(typed(batches), ["base", "behind", "before", "closes", *ROWS]):
        base, size = rows["base"][0], len(rows["n"])
        follow = decide(rows, base, ways_of(rows["behind"][0]))[1]
        rows["action"], rows["lead"], rows["final"], state = walk(rows, follow, rows["before"][0])
        rows["tail"] = [""] * (size - 1) + [BETWEEN[state][END] if rows["closes"][0] else ""]
        rows["place"] = [base + k for k in range(size)]
        held.append(rows)
        if sum(len(r["n"]) for r in held) >= 5000:
            yield flush()
            held = []
    if held:
        yield flush()


# ---- over the slices ----


def edits(rows: DataFrame) -> DataFrame:
    """The decision of each distinct row of ``rows`` (``conv``, ``turn``, ``role``, ``text``).

    ``action`` K, R or D (of the first of ``n`` equal rows, the others are D), ``lead``: initials of roles inserted before it,
    ``final``: its role afterwards, ``tail``: initials inserted after the conversation's last row, ``place``: its order.
    """
    spark = rows.sparkSession
    dealt = ordered(faults(rows))
    kind = dealt.schema["conv"].dataType.simpleString()
    spans = dealt.groupBy("conv").agg(F.min("slice").alias("low"), F.max("slice").alias("high")).where("low < high")
    chains = [r["conv"] for r in spans.select("conv").collect()]  # at most one for each border of two slices
    base, parts_of = F.shiftleft(F.col("slice").cast("long"), 32).alias("base"), {}
    info = []
    if chains:
        named = F.broadcast(spark.createDataFrame(list(enumerate(chains)), f"chain int, c {kind}"))
        broken = dealt.join(named, F.col("conv").eqNullSafe(F.col("c"))).select("*", base)
        minima = {(r["chain"], r["slice"]): r["told"] for r in broken.mapInArrow(tell_minima, "chain int, slice int, told array<long>").collect()}
        for chain, slice_ in sorted(minima):
            parts_of.setdefault(chain, []).append(slice_)
        behind = {}
        for chain, slices in parts_of.items():
            ways = NOTHING
            for slice_ in reversed(slices):
                behind[chain, slice_] = [v for w in ways for v in w[:3]]
                ways = through(minima[chain, slice_], ways)
        held = F.broadcast(spark.createDataFrame([(*k, v) for k, v in behind.items()], "chain int, slice int, behind array<long>"))
        states = {(r["chain"], r["slice"]): r["told"] for r in broken.join(held, ["chain", "slice"]).mapInArrow(tell_states, "chain int, slice int, told array<long>").collect()}
        for chain, slices in parts_of.items():
            state = END
            for slice_ in slices:
                info.append((chains[chain], slice_, behind[chain, slice_], state, slice_ == slices[-1]))
                state = states[chain, slice_][state]
    known = spark.createDataFrame(info, f"c {kind}, s int, behind array<long>, before int, closes boolean")
    whole = dealt.join(F.broadcast(known), F.col("conv").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")), "left")
    whole = whole.select(*ROWS, base, "behind", F.coalesce("before", F.lit(END)).alias("before"), F.coalesce("closes", F.lit(True)).alias("closes"))
    made = {f.name: f.dataType.simpleString() for f in dealt.schema} | dict.fromkeys(["action", "lead", "final", "tail"], "string") | {"place": "bigint"}
    return whole.mapInArrow(tell_edits, ", ".join(f"{n} {made[n]}" for n in EDITS))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv``, ``place`` and ``step`` (their order), ``role``, ``text``; inserted turns are empty."""
    text = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    text = text.withColumn("digest", _digest(F.col("text"))).dropDuplicates(["conv", "turn", "role", "digest"]).toDF("c", "t", "r", "text", "d")
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    stay = found.where("action <> 'D'").join(text, same).select("conv", "place", F.lit(1).alias("step"), F.col("final").alias("role"), "text")
    word = F.when(F.col("letter") == "u", WORDS[USER]).otherwise(WORDS[ASSISTANT])
    for column, after in (("lead", -2), ("tail", 2)):
        put = found.where(F.col(column) != "").select("conv", "place", F.posexplode(F.split(column, "")).alias("at", "letter"))
        stay = stay.unionByName(put.where("letter <> ''").select("conv", "place", (F.col("at") + after).alias("step"), word.alias("role"), F.lit("").alias("text")))
    return stay


# ---- one row for each conversation ----


def digests(rows: DataFrame, found: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conversation of ``every`` (``conv``): its faults, cost, edits as a string, and the SHA-256 of its repaired turns.

    Decisions and texts meet in one exchange, sorted, and stream by: a task holds one conversation's initials, not its texts.
    """
    conv = rows.schema["conv"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    shape = f"conv {conv}, turn {turn}, role string, start string, digest binary, kind int, n long, fault string, action string, lead string, final string, tail string, text string"
    blank = {f.split(" ")[0]: F.lit(None).cast(f.split(" ")[1]) for f in shape.split(", ")}
    fill = lambda df, **have: df.select(*[(have.get(n) if n in have else F.col(n) if n in df.columns else c).cast(c_type).alias(n) for (n, c), c_type in zip(blank.items(), [f.split(" ")[1] for f in shape.split(", ")], strict=True)])
    marks = fill(every.select("conv").distinct(), kind=F.lit(0))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("truncated"), "truncated")
    told = fill(found, kind=F.lit(1), fault=fault)
    own = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    texts = fill(own, kind=F.lit(2), start=_start(F.col("text")), digest=_digest(F.col("text")))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "start", "digest", "kind")]
    dealt = marks.union(told).union(texts).repartition(shuffle_width(rows.sparkSession), "conv").sortWithinPartitions(*order)
    return dealt.mapInArrow(tell_digests, f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Tally:
    """What is known of one conversation while its rows stream by."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost, self.audit, self.hash = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, [], hashlib.sha256()
        self.low = self.high = self.last = None
        self.turns, self.initial, self.said, self.tail, self.wanted = 0, None, False, "", None

    def say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.said else "") + role + ":" + text).encode())
        self.said = True

    def decision(self, r: dict) -> None:
        n, initial = r["n"], r["role"][:1]
        if r["turn"] is not None and r["turn"] != self.last:
            self.low, self.high, self.last, self.turns = r["turn"] if self.low is None else self.low, r["turn"], r["turn"], self.turns + 1
        self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        if r["fault"] == "blank":
            self.faults["blank"] += n
        else:
            self.faults["duplicate"] += n - 1
            if r["fault"]:
                self.faults[r["fault"]] += 1
        self.audit.append("I" * len(r["lead"]) + r["action"] + "D" * (n - 1))
        self.cost += INSERT * len(r["lead"] + r["tail"]) + DELETE * (n - 1)
        self.cost += DELETE if r["action"] == "D" else REROLE * (r["action"] == "R") + SHORT * (r["fault"] == "truncated")
        self.tail = r["tail"]
        self.wanted = None if r["action"] == "D" else (r["turn"], r["role"], r["digest"], r["lead"], r["final"])

    def text(self, r: dict) -> None:
        if self.wanted and self.wanted[:3] == (r["turn"], r["role"], r["digest"]):
            for letter in self.wanted[3]:
                self.say(WORDS[INITIALS.index(letter)], "")
            self.say(self.wanted[4], r["text"])
            self.wanted = None

    def row(self) -> tuple:
        for letter in self.tail:
            self.say(WORDS[INITIALS.index(letter)], "")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        audit = "".join(self.audit) + "I" * len(self.tail)
        return self.conv, gaps if gaps < 1 << 63 else None, *self.faults.values(), self.illegal, self.cost, audit, self.hash.hexdigest()


def tell_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    at, kind = None, None
    for batch in batches:
        kind, done = batch.schema.field("conv").type, []
        for r in batch.to_pylist():
            if at is None or r["conv"] != at.conv:
                if at is not None:
                    done.append(at.row())
                at = Tally(r["conv"])
            if r["kind"] == 1:
                at.decision(r)
            elif r["kind"] == 2:
                at.text(r)
        if done:
            yield _table(names, done, kind)
    if at is not None:
        yield _table(names, [at.row()], kind)


def _table(names: list[str], rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repair_digests(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hurt: bool = False) -> DataFrame:
    """``digests`` of a table of turns, damaged before if asked; one row for each conversation of the table."""
    rows = damage(df, conv, turn, role, text) if hurt else df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return digests(rows, edits(rows), df.select(F.col(conv).alias("conv"))).withColumnRenamed("conv", conv)
