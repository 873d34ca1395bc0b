"""Operators 11 to 13 against brute force, and the cases their docstrings define."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("textloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from textloom.llm import repair, search, urlfilter  # noqa: E402
from textloom.llm.queries import RULES  # noqa: E402

# ---- 11: URL filters ----


def url_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def url_verdict(url, rules, default="allow"):
    host, path = url_parts(url)
    fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or not h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(fit)
    return host, path, best[3], "block" if best[2] else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.www.example.com/en/", "http://badexample.com/en/", "http://x.net/es/", "http://net/fr",
    "http://x.net/fr/a/b", "http://x.net?/fr/", "http://x.net#/fr/", "http://x.net:80/es/", "http://a..com/", "http://.com/", "http://com./", "a://b://c.com/", "http://É.com/É", "http://x.com/en/en/",
    "http://" + "a." * 5000 + "com/" + "d/" * 5000, "http://x.org/" + "y" * 50000, "http://example.com/en/\nnew", "http://u@example.com/en/",
]
MORE_RULES = [*RULES, ("", "", "allow"), ("", "/y", "block"), ("b.com", "/aa", "allow"), ("a.b.com", "/", "block"), ("b.com", "/aab/c", "block"), ("b.com", "/aab/cc", "allow"), ("same.org", "/p", "allow"), ("same.org", "/p", "block")]
MORE_URLS = ["http://a.b.com/aab/cc", "http://a.b.com/aab/c", "http://b.com/aab", "http://a.b.com/a", "http://same.org/pq", "http://x.same.org/", "http://any.where/y/z"]


@pytest.mark.parametrize("rules", [RULES, MORE_RULES, [("com", "/", "block")], []])
def test_url_filter(spark, rules):
    urls = [*URLS, *MORE_URLS, "http://x.com/", "http://x.com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for c in ("rule", "host", "part", "copies", "top", "digest", "prefix"):
        df = df.withColumn(c, F.lit("mine"))
    out = urlfilter.judge_urls(df, urlfilter.rules_frame(spark, rules))
    assert out.columns == ["page_id", "url", "part", "copies", "top", "digest", "prefix", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: url_verdict(u, rules) for i, u in enumerate(urls)}
    assert {(r.part, r.digest) for r in out.collect()} == {("mine", "mine")}


def test_url_filter_repeats_and_empty_tables(spark):
    rows = [(1, "http://x.com/")] * 500 + [(None, None)] * 3 + [(2, "http://y.net/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    out = urlfilter.judge_urls(df, urlfilter.rules_frame(spark, RULES), default="block").groupBy("page_id", "verdict").count().collect()
    assert {tuple(r) for r in out} == {(1, "allow", 500), (None, "block", 3), (2, "block", 1)}
    assert urlfilter.judge_urls(df.limit(0), urlfilter.rules_frame(spark, RULES)).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge_urls(df, urlfilter.rules_frame(spark, [("a", "/", "maybe")]))


def test_url_filter_joined_rules_as_broadcast(spark, monkeypatch):
    rnd = random.Random(2)
    hosts = ["a.com", "b.a.com", "c.net", "com", "x.y.z.org"]
    rules = list({(rnd.choice(hosts), "/" + "/".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "/"]), rnd.choice(["allow", "block"])) for _ in range(80)})
    urls = [(i, f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}/" + "/".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6)))) for i in range(400)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    want = {i: url_verdict(u, rules) for i, u in urls}
    for limit in (100_000, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, urlfilter.rules_frame(spark, rules)).collect()}
        assert got == want


# ---- 12: conversation repair ----


def damaged(rows):
    out, blank = [], lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        k, r, x = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20, blank(r), blank(x)
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def repair_by_search(rows):
    """All lists of edits by memoised search, the least by (cost, initials)."""
    seen, faults = set(), []
    for _, _, r, x in rows:
        shown = x.strip(" \t\n\v\f\r")
        faults.append("blank" if not shown else "duplicate" if (r, x) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((r, x))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(None)
    def go(i, before, put):
        found = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        step = lambda cost, sign, more, rest: found.append((cost + rest[0], sign + rest[1], more + rest[2])) if rest else None
        if i < len(rows):
            step(3, "D", (), go(i + 1, before, 0))
            role, text = rows[i][2:]
            if faults[i] not in ("blank", "duplicate"):
                short = int(faults[i] == "truncated")
                if role[:1] and role[:1] in follow[before]:
                    step(short, "K", ((role, text),), go(i + 1, role[:1], 0))
                for word in ("user", "assistant"):
                    if word[0] in follow[before]:
                        step(short + 2, "R", ((word, text),), go(i + 1, word[0], 0))
        if put < 3:
            for word in ("user", "assistant"):
                if word[0] in follow[before]:
                    step(2, "I", ((word, ""),), go(i, word[0], put + 1))
        return min(found) if found else None

    cost, audit, turns = go(0, "", 0)
    told = {r[1] for r in rows if r[1] is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(told) - min(told) + 1 - len(told) if told else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), turns


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).digest()))


def random_turns(seed, n, convs, turns, hot=0.0):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"], ["a.", "b!", "c", "d", "e?", " ", "", None, "hello there. ", "x\n.", "é", "\t", "\xa0"]
    return [(0 if rnd.random() < hot else rnd.choice([None, *range(convs)]), rnd.choice([None, *range(turns)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("case", "width", "hurt"), [((1, 260, 50, 9), 3, True), ((2, 260, 50, 9), 3, False), ((3, 180, 3, 40), 7, False), ((4, 250, 8, 400, 0.8), 9, False)])
def test_repair(spark, case, width, hurt):
    rows = random_turns(*case)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)  # narrow slices cut the long conversations
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("slice", F.lit("mine")).withColumn("n", F.lit("mine"))
        got = {r[0]: tuple(r)[1:] for r in repair.repair_digests(df, hurt=hurt).collect()}
        after = damaged(rows) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert set(got) == {r[0] for r in rows}
        for c in got:
            assert got[c] == repair_by_search(in_order([r for r in after if r[0] == c]))[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repaired_turns(spark):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in random_turns(9, 120, 12, 12)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    found = repair.edits(df)
    got = {}
    for r in repair.repaired(df, found).orderBy("conv", "place", "step").collect():
        got.setdefault(r.conv, []).append((r.role, r.text))
    for c in {r[0] for r in rows}:
        assert got.get(c, []) == list(repair_by_search(in_order([r for r in rows if r[0] == c]))[1])


def test_repair_odd_tables(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert repair.repair_digests(spark.createDataFrame([], shape)).count() == 0
    rows = [(1, 0, "user", "long. " * 20000), (1, 1, "assistant", "fine."), (2, None, None, None), (3, -(2**63), "user", "a."), (3, 2**63 - 1, "assistant", "b.")] + [(4, 0, "user", "hi.")] * 300
    got = {r.conv_id: r for r in repair.repair_digests(spark.createDataFrame(rows, shape).repartition(4)).collect()}
    assert got[1].audit == "KK" and got[1].cost == 0
    assert got[1].repaired_sha256 == hashlib.sha256(("user:" + "long. " * 20000 + "\nassistant:fine.").encode()).hexdigest()
    assert (got[2].blank, got[2].audit, got[2].repaired_sha256) == (1, "D", hashlib.sha256(b"").hexdigest())
    assert got[3].gaps is None and got[3].audit == "KK"
    assert (got[4].duplicate, got[4].audit, got[4].illegal, got[4].cost) == (299, "K" + "D" * 299 + "I", 299, 3 * 299 + 2)


# ---- 13: ranked search ----

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def search_by_sorting(items, docs, k):
    said = [(i, Counter(words_of(t))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n, total = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in said:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words_of(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_docs", "postings", "block"), [(32_768, 2_000_000, 4096), (7, 50, 3)])
def test_search(spark, monkeypatch, shard_docs, postings, block):
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(search, "BLOCK_ITEMS", block)
    rnd = random.Random(4)
    pool = ["the", "The", "of", "é", "É", "a1", "漢字", "x_y", "rare", "café", "3.14", "\x7f", "{}", "ß", "zz"]
    docs = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))) for i in range(160)]
    docs += [(200 + i, docs[5][1]) for i in range(40)] + [docs[5]] * 3 + [(None, "rare rare"), (None, None), (900, None), (901, ""), (902, "rare " * 30000), (-3, "rare rare"), (903, "\x00 -")]
    items = [(0, "the rare É"), (1, None), (2, ""), (3, "nothing-matches qq"), (4, docs[5][1]), (4, "zz zz the"), (None, "café 14"), (6, "rare RARE rare")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("mine")).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("mine"))
    for k in (20, 3):
        got = sorted((tuple(r) for r in search.search(i, d, k).collect()), key=str)
        assert got == search_by_sorting(items, docs, k)


def test_search_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(i.limit(0), d).collect() == []
    assert search.search(i, d.limit(0)).collect() == []
    assert [tuple(r) for r in search.search(i, d).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 12 * 100)))]


def test_best_breaks_ties_by_id():
    import numpy as np

    score, ids = np.array([5, 7, 5, 5, 0, 5]), np.array([9, 1, 3, 4, 0, 2])
    known = np.array([True] * 5 + [False])
    assert sorted(ids[search.best(score, ids, known, 3)]) == [1, 3, 4]
    assert len(search.best(score, ids, known, 9)) == 5
