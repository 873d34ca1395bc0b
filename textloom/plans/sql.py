"""SQL building blocks for the oracle: the same relations written for a plain SQL engine."""

from __future__ import annotations

import re

SENTENCES = r"""
lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
sent AS (SELECT * FROM (
  SELECT doc_id, lang, source, sent_id, list_filter(regexp_split_to_array(l[sent_id], '[ \t\r\n]+'), lambda x: x <> '') AS words
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS sent_id FROM lines)) WHERE len(words) > 0)"""

HELD_OUT = r"""
tlines AS (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark),
tsent AS (SELECT * FROM (
  SELECT item_id, sent_id, list_filter(regexp_split_to_array(l[sent_id], '[ \t\r\n]+'), lambda x: x <> '') AS words
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS sent_id FROM tlines)) WHERE len(words) > 0)"""


def padded(words: str = "words") -> str:
    """A sequence with boundaries where it has none."""
    return (
        f"list_concat(CASE WHEN {words}[1] = '<s>' THEN CAST([] AS VARCHAR[]) ELSE ['<s>'] END, "
        f"list_concat({words}, CASE WHEN {words}[len({words})] = '</s>' THEN CAST([] AS VARCHAR[]) ELSE ['</s>'] END))"
    )


def grams(name: str, source: str, order: int, keys: str = "", words: str | None = None, boundaries: bool = True) -> str:
    """CTE ``name``: (keys, ord, ctx, w), one row per n-gram occurrence."""
    seq = words or (padded() if boundaries else "words")
    pre = f"{keys}, " if keys else ""
    return f"""
{name}_p AS (SELECT {pre}{seq} AS ws FROM {source}),
{name}_j AS (SELECT {pre}ws, unnest(range(1, len(ws) + 1)) AS j FROM {name}_p),
{name}_n AS (SELECT {pre}ws, j, unnest(range(1, least({order}, j) + 1)) AS ord FROM {name}_j),
{name} AS (SELECT {pre}CAST(ord AS INTEGER) AS ord, array_to_string(list_slice(ws, j - ord + 1, j - 1), ' ') AS ctx, ws[j] AS w FROM {name}_n)"""


def counts(name: str, source: str, order: int, keys: str = "", **more) -> str:
    """CTE ``name``: counts of all orders."""
    pre = f"{keys}, " if keys else ""
    return grams(f"{name}_g", source, order, keys, **more) + f""",
{name} AS (SELECT {pre}ord, ctx, w, count(*) AS cnt FROM {name}_g GROUP BY ALL)"""


def train_counts(order: int) -> str:
    return f"{SENTENCES},{counts('c', 'sent', order)}"


def gram(ctx: str = "ctx", w: str = "w") -> str:
    return f"CASE WHEN {ctx} = '' THEN {w} ELSE {ctx} || ' ' || {w} END"


def shorter(ctx: str = "ctx") -> str:
    return f"CASE WHEN strpos({ctx}, ' ') = 0 THEN '' ELSE substr({ctx}, strpos({ctx}, ' ') + 1) END"


def first(text: str) -> str:
    return f"split_part({text}, ' ', 1)"


def last(text: str) -> str:
    return f"split_part({text}, ' ', -1)"


def but_last(text: str) -> str:
    return f"CASE WHEN strpos({text}, ' ') = 0 THEN '' ELSE substr({text}, 1, length({text}) - length({last(text)}) - 1) END"


def suffix(ctx: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({ctx}, ' '), -{n}, -1), ' ')"


def log(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN log10({p}) ELSE -1e300 END"


def unigrams(name: str, counts_cte: str, factor: str, extra: str = "") -> str:
    """CTE ``name`` (w, p) of a non-interpolated method; ``factor`` over cnt, total, types, v."""
    return f"""
{name}_c AS (SELECT w, cnt FROM {counts_cte} WHERE ord = 1 AND w <> '<s>'),
{name}_t AS (SELECT sum(cnt)::DOUBLE AS total, count(*)::DOUBLE AS types, count(*)::DOUBLE AS v FROM {name}_c),
{name}_r AS (SELECT w, ({factor}) * cnt / total {extra} AS p FROM {name}_c, {name}_t),
{name}_q AS (SELECT 1.0 - sum(p) AS rest, count(*) FILTER (WHERE p = 0) AS zeros, count(*) AS n FROM {name}_r),
{name} AS (SELECT w, CASE WHEN zeros > 0 THEN CASE WHEN p = 0 THEN greatest(rest, 0) / zeros ELSE p END ELSE p + greatest(rest, 0) / n END AS p FROM {name}_r, {name}_q)"""


def wb_bigram(name: str = "m", counts_cte: str = "c") -> str:
    """Witten-Bell bigram model: {name}_u (w, p), {name}_b (ctx, w, p), {name}_w (ctx, bow as a factor)."""
    return f"""{unigrams(f'{name}_u', counts_cte, 'total / (total + types)')},
{name}_k AS (SELECT ctx, w, cnt FROM {counts_cte} WHERE ord = 2 AND w <> '<s>' AND ctx <> '</s>'),
{name}_x AS (SELECT ctx, sum(cnt)::DOUBLE AS total, count(*)::DOUBLE AS types FROM {name}_k GROUP BY ctx),
{name}_r AS (SELECT k.ctx, k.w, x.total / (x.total + x.types) * k.cnt / x.total AS p, u.p AS lowp FROM {name}_k k JOIN {name}_x x USING (ctx) JOIN {name}_u u USING (w)),
{name}_z AS (SELECT ctx, sum(p) AS sp, 1 - sum(lowp) < 3e-6 AND 1 - sum(p) > 3e-6 AS spent, (1 - sum(p)) / (1 - sum(lowp)) AS bow FROM {name}_r GROUP BY ctx),
{name}_b AS (SELECT ctx, w, CASE WHEN spent THEN p / sp ELSE p END AS p, lowp FROM {name}_r JOIN {name}_z USING (ctx)),
{name}_w AS (SELECT ctx, CASE WHEN spent THEN 1.0 ELSE bow END AS bow FROM {name}_z)"""


def bigram_lookup(name: str, events: str, model: str, keys: str) -> str:
    """CTE ``name``: events (keys, ctx, w) with ``p`` and ``hit`` under a bigram model."""
    return f"""
{name} AS (SELECT {keys}, e.ctx, e.w, CASE WHEN b.p IS NOT NULL THEN b.p WHEN u.p IS NOT NULL THEN u.p * coalesce(x.bow, 1) ELSE 0 END AS p,
  CASE WHEN b.p IS NOT NULL THEN 2 WHEN u.p IS NOT NULL THEN 1 ELSE 0 END AS hit
  FROM {events} e LEFT JOIN {model}_b b ON e.ctx = b.ctx AND e.w = b.w LEFT JOIN {model}_u u ON e.w = u.w LEFT JOIN {model}_w x ON e.ctx = x.ctx)"""


def events(name: str, source: str, order: int, keys: str) -> str:
    """CTE ``name`` (keys, pos, ctx, w): scored positions."""
    return f"""
{name}_p AS (SELECT {keys}, {padded()} AS ws FROM {source}),
{name}_j AS (SELECT {keys}, ws, unnest(range(2, len(ws) + 1)) AS j FROM {name}_p),
{name} AS (SELECT {keys}, j - 1 AS pos, array_to_string(list_slice(ws, greatest(1, j - {order - 1}), j - 1), ' ') AS ctx, ws[j] AS w FROM {name}_j)"""


def materialised(sql: str) -> str:
    """Every common table computed once: a plain engine otherwise repeats it wherever it is named."""
    if "RECURSIVE" in sql:
        return sql
    return re.sub(r"((?:WITH|,)\s+)(\w+) AS \(\s*(SELECT)", r"\1\2 AS MATERIALIZED (\3", sql)
