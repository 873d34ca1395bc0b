"""SQL of operators 11 to 13 for a plain SQL engine, written from their definitions."""

from __future__ import annotations

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(h, p, v) AS (VALUES {listed}),
cut AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
found AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC NULLS LAST) AS k
  FROM parted LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM found WHERE k = 1"""


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, translate(text, {UPPER}) AS text FROM benchmark),
asked AS (SELECT item, item_id, unnest(regexp_extract_all(text, '{TERMS}')) AS t FROM items),
docs AS (SELECT row_number() OVER () AS doc, doc_id, translate(text, {UPPER}) AS text FROM documents),
said AS (SELECT doc, doc_id, unnest(regexp_extract_all(text, '{TERMS}')) AS t FROM docs),
sizes AS (SELECT doc, doc_id, count(*) AS n FROM said GROUP BY ALL),
totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
postings AS (SELECT doc, t, count(*) AS tf FROM said WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY t, nd),
gains AS (
  SELECT doc, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) AS gain
  FROM postings JOIN sizes USING (doc) JOIN weights USING (t), totals),
scored AS (SELECT item, item_id, doc, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gains USING (t) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scored WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 20"""


def repair_sql() -> str:
    """Row after row from the end of each conversation, with the least (cost, edits) for each role that may stand before."""
    between = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}
    word = {"u": "user", "a": "assistant"}
    turns = lambda inserted: "[" + ", ".join(f"'{word[x]}:'" for x in inserted) + "]::VARCHAR[]"
    name = {"": "v0", "s": "vs", "u": "vu", "a": "va"}
    far = "{'c': 1000000000::BIGINT, 'e': '~', 't': []::VARCHAR[]}"
    way = lambda c, e, t: f"{{'c': ({c})::BIGINT, 'e': {e}, 't': {t}}}"

    def best(before: str) -> str:
        v = name[before]
        found = [way(f"3 + {v}.c", f"'D' || {v}.e", f"{v}.t")]
        for (b, role), put in between.items():
            if b == before:
                v, head = name[role], f"{2 * len(put)} + short"
                kept = way(f"{head} + {v}.c", f"'{'I' * len(put)}K' || {v}.e", f"list_concat({turns(put)}, list_prepend(role || ':' || text, {v}.t))")
                changed = way(f"{head} + 2 + {v}.c", f"'{'I' * len(put)}R' || {v}.e", f"list_concat({turns(put)}, list_prepend('{word.get(role)}:' || text, {v}.t))")
                found.append(f"CASE WHEN must THEN {far} WHEN ini = '{role}' THEN {kept} ELSE {changed if role != 's' else far} END")
        return f"list_sort([{', '.join(found)}])[1] AS {name[before]}"

    ends = {"": "", "s": "ua", "u": "a", "a": ""}
    close = ", ".join(f"{way(2 * len(put), repr('I' * len(put)), turns(put))} AS {name[b]}" for b, put in ends.items())
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
marked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, t: CASE WHEN t >= 0 THEN xor(c, t) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT) % 20 AS kind FROM src),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM marked WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS j,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown, left(role, 1) AS ini FROM hurt),
judged AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'duplicate'
    WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY j) AS prev FROM placed),
rows AS (SELECT conv_id, j, role, text, ini, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS short FROM judged),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(j) AS n FROM judged GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS j, {close} FROM facts
  UNION ALL
  SELECT b.conv_id, r.j, {best('')}, {best('s')}, {best('u')}, {best('a')}
  FROM back b JOIN rows r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND r.j = b.j - 1),
every AS (SELECT DISTINCT conv_id AS conv FROM conversations)
SELECT conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v0.c, 0) AS cost, coalesce(v0.e, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN facts f ON conv IS NOT DISTINCT FROM f.conv_id LEFT JOIN back b ON conv IS NOT DISTINCT FROM b.conv_id AND b.j = 1"""
