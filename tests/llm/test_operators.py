"""Each training-data operator against a brute-force version, and the cases its docstring defines."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

pytest.importorskip("textloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from textloom.llm import ann, chat, htmltext, langid, mixing, pieces, quality, sharding, simhash, tokencount  # noqa: E402
from textloom.llm.common import connected_components, running_totals, word_count  # noqa: E402
from textloom.llm.queries import tokenizer_file  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "x" * 30000, "word " * 8000, "same text here again", "same text here again", "é漢字 ﻿ <|endoftext|> ▁ \x00"]


def odd_docs(spark, extra=True):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, [None, "en", "de", "xx"][i % 4], [None, "s1", "s2"][i % 3]) for i, t in enumerate(ODD)]
    rows += [rows[7], (None, "no id here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        for c in ("fp", "a", "b", "ids", "q", "_ll", "slot", "shard", "size", "rank", "n_tokens", "li_lang", "_id", "_slot", "key", "mask"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def sample_docs(spark, n=300, seed=3):
    rnd = random.Random(seed)
    base = ["the of and to in is that it was for on are with as his they at be this from", "der die und in den von zu das mit sich des auf für ist im dem nicht ein", "de la que el en y a los se del las un por con no una su para es al", "le de la et les des en un du une que est pour qui dans a par plus"]
    langs = ["en", "de", "es", "fr"]
    rows = []
    for i in range(n):
        k = i % 4
        words = [rnd.choice(base[k].split()) if rnd.random() < 0.5 else "".join(rnd.choice("bcdfgaeioulmnrst") for _ in range(rnd.randint(3, 9))) for _ in range(rnd.randint(60, 200))]
        rows.append((i, " ".join(words), langs[k], f"s{i % 3 if i % 2 else 0}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows


# ---- helpers ----


def test_running_totals_split_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "b", rnd.randint(0, 20), i, rnd.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, i int, n long")
    got = {r["i"]: (r["_rank"], r["_total"]) for r in running_totals(df, ["g"], [F.col("o"), F.col("i")], "n").collect()}
    for g in (None, "hot", "b"):
        total = 0
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            total += r[3]
            assert got[r[2]] == (k, total)


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(150)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_word_count(spark):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ODD], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [len(WORD.findall(t or "")) for t in ODD]


# ---- 1 ----


def test_sharding_table_is_fair_and_stable():
    shards = [f"s{k}" for k in range(20)]
    full = sharding.fill_table(shards, 4099)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    less = sharding.fill_table(shards[:-1], 4099)
    kept = (full != 19) & (full == less)
    assert kept.sum() / (full != 19).sum() > 0.8
    for bad in (4100, 13):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, bad)


def test_sharding_rows(spark):
    out = sharding.assign_shards(odd_docs(spark), "doc_id", ["a", "b", "c"], 101)
    rows = out.collect()
    table = sharding.fill_table(["a", "b", "c"], 101)
    assert len(rows) == 11
    for r in rows:
        key = "\0null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, "abc"[table[slot]])
    assert sharding.assign_shards(odd_docs(spark).limit(0), "doc_id", ["a"], 101).count() == 0


# ---- 2 ----


def test_language_id(spark):
    docs, rows = sample_docs(spark)
    held = spark.createDataFrame([(1000 + i, r[1][len(r[1]) // 2 :], None, r[3]) for i, r in enumerate(rows)], docs.schema)
    got = {r["doc_id"]: r for r in langid.identify(held, training=docs, sample=100).collect()}
    right = sum(got[1000 + i]["li_lang"] == r[2] for i, r in enumerate(rows))
    assert right / len(rows) > 0.97
    assert all(r["li_kept"] for r in got.values())


def test_language_id_odd_rows(spark):
    out = langid.identify(odd_docs(spark), sample=10).collect()
    assert len(out) == 11
    for r in out:
        if not (r["text"] or "").strip():
            assert r["li_lang"] is None and not r["li_kept"]
    assert langid.identify(odd_docs(spark).limit(0)).count() == 0


def test_language_evidence_is_fused(spark):
    """A short ambiguous text follows its host and its declared language."""
    docs, _ = sample_docs(spark, 200)
    model = langid.fit(docs, id_col="doc_id", text="text", label="lang", languages=["de", "en", "es", "fr"], sample=50)
    rows = [(i, "der und die nicht ist das von", None, "http://host.example/x") for i in range(50)] + [(99, "zz", None, "http://host.example/y"), (100, "zz", "fr", "http://other.fr/z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {r["doc_id"]: r["li_lang"] for r in langid.identify(df, url="url", host=None, model=model).collect()}
    assert got[99] == "de" and got[100] == "fr"


# ---- 3 ----


def brute_chat(rows):
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        learned = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\s\\l<turn>x</turn>\n", "<turn>\\", "", None, "a\n\nb</turn>", "x" * 50000]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "as\\n</turn>\nx", None])]
    rows += [(3, 1, "user", "again"), (3, 1, "user", "again"), (None, None, "assistant", "lone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("conv", F.lit(2))
    out = chat.format_turns(chat.canonical_turns(df)).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("l", chat.loss_text(chat.turn_strings(F.col("formatted")), F.col("spans")))
    want = brute_chat(rows)
    got = {r["conv"]: (len(r["turns"]), hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"]).encode()).hexdigest(), len(r["l"]), hashlib.sha256(r["l"].encode()).hexdigest()) for r in out.collect()}
    assert got == want
    assert chat.format_turns(chat.canonical_turns(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    frames = {
        "messages": spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "i int, messages array<struct<role:string,content:string>>"),
        "conversations": spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "i int, conversations array<struct<from:string,value:string>>"),
        "prompt": spark.createDataFrame([(1, "hi", "yo")], "i int, prompt string, completion string"),
        "qa": spark.createDataFrame([(1, "hi", "yo")], "i int, question string, answer string"),
    }
    prints = set()
    for df in frames.values():
        prints.add(chat.fingerprint(df.schema))
        got = [(r["role"], r["text"]) for r in chat.canonical_turns(df, "i").orderBy("turn").collect()]
        assert got == [("user", "hi"), ("assistant", "yo")]
    assert len(prints) == 4
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "x int"))


def test_chat_records(spark):
    records = ['{"messages":[{"role":"user","content":"hi"}]}', '{"prompt":"p","response":"r","x":1}', '{"unknown":1}', None, '{"conversations":[{"from":"human","value":"v"}]}', "no json"]
    df = spark.createDataFrame(list(enumerate(records)), "i int, j string")
    got = sorted((r["conv"], r["turn"], r["role"], r["text"]) for r in chat.canonical_records(df, "j", "i").collect())
    unknown = [(2, 0, "unknown", '{"unknown":1}'), (3, 0, "unknown", None), (5, 0, "unknown", "no json")]
    assert got == sorted([(0, 0, "user", "hi"), (1, 0, "user", "p"), (1, 1, "assistant", "r"), (4, 0, "user", "v"), *unknown])


@pytest.mark.parametrize("extra", ["conv_id", "text", "turn", "role", "input", "other"])
def test_chat_layouts_bear_extra_columns(spark, extra):
    df = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "i int, messages array<struct<role:string,content:string>>").withColumn(extra, F.lit("x"))
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(df, "i").orderBy("turn").collect()] == [("user", "hi"), ("assistant", "yo")]


def test_chat_null_parts_are_empty_turns(spark):
    df = spark.createDataFrame([(1, "do", None, "done")], "i int, instruction string, input string, output string")
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(df, "i").orderBy("turn").collect()] == [("user", "do"), ("user", None), ("assistant", "done")]


# ---- 4 ----


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(5)
    bits = ["a", "e", " ", "  ", "\n", "\t", "ing", "é", "漢", "▁", "1", "(", "\r", "==", " " * 20, "😀", "th", "the", "<s>", "\x00", "er" * 40, "-" * 150]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 20))) for _ in range(600)] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("ids", F.lit("mine")).repartition(3)
    coded = pieces.encode(df, path, text="t", check="same", dictionary_limit=500, group_chars=5000)
    for r in pieces.decode(coded, path, out="back").collect():
        want = sp.encode(texts[r["i"]] or "")
        assert r["ids"] == want, texts[r["i"]]
        assert r["back"] == sp.decode(want)
        assert r["same"] == ((texts[r["i"]] or "") == r["back"])
    assert pieces.encode(df.limit(0), path, text="t").count() == 0


# ---- 5 ----


def brute_simhash(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, fps, strict=True), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in ["", None, "One", "one TWO", "One two three Four É five", "a\x0bb\x0cc d", *ODD[:4]]:
        assert simhash.shingle_fingerprint(t) == brute_simhash(t)


@pytest.mark.parametrize("limit", [8192, 40])
def test_near_links_lose_nothing(spark, limit):
    """Dense groups around shared fingerprints, with hot buckets dealt again."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, limit)
    roots = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    want = brute_components(signed, fps, 2)
    assert {f: roots.get(f, f) for f in signed} == want


def test_tree_pairs_match_brute_force():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 20, (700, 3)).astype(np.uint64)).sum(1).astype(np.uint64))
    found = [pair for left, right in simhash.tree_pairs(fps, 2) for pair in zip(left.tolist(), right.tolist(), strict=True)]
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert len(found) == len(want) and set(found) == want


def test_near_duplicates(spark):
    docs = odd_docs(spark)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    rows = [r for r in docs.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    want = brute_components([r["doc_id"] for r in rows], [brute_simhash(r["text"]) for r in rows], 2)
    for (i, _), c in got.items():
        if i is not None:
            assert c == want[i]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_representatives(spark):
    docs, rows = sample_docs(spark, 60)
    copies = [(1000 + i, r[1], r[2], r[3]) for i, r in enumerate(rows[:10])]
    edited = []
    for i, r in enumerate(rows[10:20]):
        words = r[1].split()
        words[len(words) // 2] = "changed"
        edited.append((2000 + i, " ".join(words), r[2], r[3]))
    every = spark.createDataFrame([*rows, *copies, *edited, rows[5], rows[5]], docs.schema)
    kept = simhash.keep_representatives(every)
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in rows]
    assert kept.columns == docs.columns
    odd = odd_docs(spark)
    assert simhash.keep_representatives(odd).columns == odd.columns
    assert simhash.keep_representatives(odd.limit(0)).count() == 0


# ---- 6 ----


def brute_nearest(rows, k=5):
    valid = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max((len(v) for _, v in valid), key=[len(v) for _, v in valid].count)
    valid = [(i, v / np.linalg.norm(v)) for i, v in valid if len(v) == dims]
    out = {}
    for q, v in valid:
        if q % 50 == 0:
            found = sorted((-round(float(v @ w), 9), i) for i, w in valid if i != q)[:k]
            out[q] = [i for _, i in found]
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_equals_brute_force(spark, clustered):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    if clustered:
        x = rng.normal(size=(20, 16))[rng.integers(0, 20, 700)] + 0.05 * x
    x[100:300] = x[50]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [1.0, None] + [1.0] * 14), (9004, [1.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("score", F.lit(2))
    got = {}
    for r in ann.nearest(df, query="id % 50 = 0", block=32, per_task=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_nearest(rows[:-1])
    near = ann.nearest(df, query="id % 50 = 0", block=32, complete=False).select("query_id", "vec_id").collect()
    hits = sum(v in got[q] for q, v in near)
    if clustered:
        assert hits / sum(map(len, got.values())) >= 0.9


def test_nearest_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], schema), query="id % 50 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]


def test_hilbert_keys_are_a_walk():
    """Every cell once, neighbours on the curve differ by one step."""
    cells = np.array(list(itertools.product(range(8), repeat=2)))
    order = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# ---- 7 ----


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rnd = random.Random(9)
    bits = ["a", "the", " ", "  ", "\n", "'s", "ing", "é", "漢", "123", "!!", "<|endoftext|>", "😀", "\t", "aaaa", " ", "\x00"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(500)] + [t for t in ODD if t is not None] + ["ab" * 5000, "a" * 3001]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string").withColumn("n_tokens", F.lit("mine"))
    got = {r["i"]: r["n_tokens"] for r in tokencount.with_token_counts(df, path).collect()}
    assert got.pop(-1) == 0
    assert [got[i] for i in range(len(texts))] == [len(e.ids) for e in tk.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.with_token_counts(df.limit(0), path).count() == 0


# ---- 8 ----


def test_mixing(spark):
    docs, rows = sample_docs(spark, 400)
    out = mixing.mix_sizes(docs).collect()
    sizes = {r[0]: len(WORD.findall(r[1])) for r in rows}
    assert {r["doc_id"]: r["size"] for r in out} == sizes
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= 0.02 * mine[0]["target"]
        assert mine[0]["target"] <= 2 * mine[0]["source_size"] and all(r["copies"] <= 2 for r in mine)
    total = sum({r["source"]: r["target"] for r in out}.values())
    assert abs(total - 1.5 * sum(sizes.values())) < 1e-6 * total
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_sizes(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}
    assert mixing.mix(docs).count() == sum(r["copies"] for r in out)


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    out = mixing.mix_sizes(docs).collect()
    assert len(out) == 11
    assert all(r["copies"] * r["size"] <= 2 * r["size"] for r in out)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_sizes(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_pareto_sampling_hits_inclusion(spark):
    """Over many seeds a document is taken as often as its source's ratio says."""
    docs, _ = sample_docs(spark, 80)
    slim = docs.select("doc_id", "source", "text").cache()
    got = [r["copies"] for k in range(6) for r in mixing.mix_sizes(slim, seed=f"s{k}", weights=(1.0,), share=0.5).collect()]
    assert 0.42 < sum(got) / len(got) < 0.58


# ---- 9 ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- c --><div class="ad">buy</div><header>head</header>
<article><h1>Title&amp;</h1><p><b>One<br><p>Two  two&nbsp;x</p><div class="cookie-notice">accept</div><form><p>f</p></form></article>
<aside>side</aside><div id="comments"><p>said</p></div><footer>&copy; foot</footer></body></html>"""


def test_page_text():
    marked, blocks = htmltext.page_blocks(PAGE)
    assert marked and blocks == ["Title&", "One", "Two two x"]
    marked, blocks = htmltext.page_blocks("<body><nav>m</nav><p>a <b>b</b>c</p>tail<script>x</script>")
    assert not marked and blocks == ["a bc", "tail"]
    assert htmltext.page_blocks(None) == (False, []) and htmltext.page_blocks("<") == (False, ["<"])
    assert htmltext.page_blocks('<p title="a>b">x</p>')[1] == ["x"]
    assert len(htmltext.page_blocks("<div>" * 20000 + "deep")[1]) == 1


def test_host_boilerplate(spark):
    """Without a marked article, long runs that other pages of the host share go, what is the page's own stays."""
    shared = "subscribe to our letter and get the news of the week in your mail box every day"
    own = [f"{k} page tells its very own story number {k} about thing {k * 7 + 100}" for k in range(6)]
    rows = [(k, "http://h.example/a", f"<p>{shared}</p><p>{t}</p><p>{shared}</p>") for k, t in enumerate(own)]
    rows += [(50, "http://other.example/a", f"<p>{shared}</p>"), (51, None, None), (52, None, ""), (53, "u", PAGE), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(1))
    out = [(r["page_id"], r["text"]) for r in htmltext.extract(df).collect()]
    assert len(out) == len(rows)
    got = dict(out)
    assert got[50] == shared and got[51] == "" and got[52] == "" and got[53] == "Title& One Two two x"
    for k in range(1, 6):
        assert got[k] == own[k]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_marked_articles_pass_the_host_suffix_array(spark):
    """Furniture inside the mark on nearly all pages of a host goes; what some pages quote, or few pages have, stays."""
    furniture = "subscribe to our letter and get the news of the week in your mail box every day"
    quoted = "this very passage was quoted word for word on several pages of the host by its many readers"
    own = [" ".join(f"w{k * 1000 + i}" for i in range(20)) for k in range(12)]
    rows, want = [], {}
    for k, t in enumerate(own):
        parts = [t, *([quoted] if k < 6 else []), *([furniture] if k != 7 else [])]
        rows.append((k, "http://h.example/a", f"<article>{''.join(f'<p>{p}</p>' for p in parts)}</article><p>beside</p>"))
        want[k] = " ".join(p for p in parts if p != furniture)
    for k in range(9):  # too few pages to tell
        rows.append((100 + k, "http://g.example/a", f"<main><p>{own[k]}</p><p>{furniture}</p></main>"))
        want[100 + k] = f"{own[k]} {furniture}"
    rows += [(200 + k, "http://c.example/a", f"<article>{furniture}</article>") for k in range(10)]  # copies stay whole
    want |= {200 + k: furniture for k in range(10)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()} == want


def covered_by_suffix_array(pages, run):
    """Tokens of each page inside a substring of ``run`` tokens or more that another page holds, from all suffixes in order."""
    suffixes = sorted((tuple(w[i:]), p, i) for p, w in enumerate(pages) for i in range(len(w)))
    gone = [bytearray(len(w)) for w in pages]
    for order in (suffixes, suffixes[::-1]):
        for k, (one, p, i) in enumerate(order):
            for two, q, _ in order[k + 1 :]:  # the nearest suffix of another page
                common = next((n for n, (x, y) in enumerate(zip(one, two, strict=False)) if x != y), min(len(one), len(two)))
                if common < run:
                    break
                if p != q:
                    gone[p][i : i + common] = b"\1" * common
                    break
    return gone


def test_host_suffix_array_equals_brute_force(spark):
    rnd = random.Random(12)
    hosts = {h: [[rnd.choice("abc") for _ in range(rnd.randint(0, 60))] for _ in range(9)] for h in ("h", "g")}
    for pages in hosts.values():  # a long passage on several pages, twice on one
        long = [rnd.choice("xyz") for _ in range(25)]
        for k in (1, 3, 3, 7):
            pages[k] += long + [rnd.choice("abc") for _ in range(10)]
    rows, want = [], {}
    for h, pages in hosts.items():
        for k, (w, gone) in enumerate(zip(pages, covered_by_suffix_array(pages, 5), strict=True)):
            kept = w if all(gone) else [x for x, g in zip(w, gone, strict=True) if not g]
            rows.append((len(rows), f"http://{h}.example/{k}", f"<p>{' '.join(w)}</p>"))
            want[rows[-1][0]] = " ".join(kept)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df, run=5, depth=8).collect()}
    assert got == want


def test_hostile_pages_are_read_in_one_go():
    import time

    began = time.time()
    for page in ["<a \"" * 100_000, "<a '\"" * 100_000 + ">", "<!x " * 100_000, "<a b=\"x>y</a>" * 20_000, "<" * 200_000]:
        htmltext.page_blocks(page)
    assert time.time() - began < 20
    assert htmltext.page_blocks('<p title="a>b">x</p><p title="open>y</p>')[1] == ["x", "y"]
    assert htmltext.page_blocks("<article><p>x</p><math><mi>y</mi></math><svg><text>z</text></svg></article>")[1] == ["x", "y", "z"]


# ---- 10 ----


def brute_quality(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts():
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["a", "b", "#c", "é\n", "\n", "d\x0b"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    for t in [*texts, *ODD[:4], *ODD[6:]]:
        raw = (t or "").encode()
        assert quality.base_counts(raw, raw.split()) == brute_quality(t)


def test_quality_verdicts(spark):
    docs, rows = sample_docs(spark, 200)
    junk = [(5000 + i, " ".join(f"{w}%%%***" for w in rows[i][1].split()), rows[i][2], "s") for i in range(8)]
    every = spark.createDataFrame([*rows, *junk], docs.schema)
    got = {r["doc_id"]: r["q_rules"]["kept"] for r in quality.with_quality(every, quality.references(every)).collect()}
    assert all(got[r[0]] for r in rows) and not any(got[j[0]] for j in junk)
    odd = odd_docs(spark)
    out = quality.with_quality(odd, quality.references(odd)).collect()
    assert len(out) == 11 and all(r["q_rules"]["base_failed"] for r in out if len(WORD.findall(r["text"] or "")) < 50)
    assert quality.with_quality(odd.limit(0), quality.references(odd.limit(0))).count() == 0


def test_divergence():
    p = np.array([[1.0, 0.0], [1.0, 1.0]])
    got = quality.distance(p, np.array([[0.0, 1.0], [1.0, 1.0]]))
    assert abs(got[0] - 1) < 1e-12 and got[1] == 0


def word_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_similar(texts, least=0.8):
    sets = [word_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return dict(enumerate(label))


def similar_labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}


def passages(seed, n, kind):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rnd.randint(150, 400))]
        size = len(words)
        if kind == "block":
            cut = rnd.randint(size // 20, size // 10)
            at = rnd.randint(0, size - cut)
            other = words[:at] + [word() for _ in range(cut)] + words[at + cut :]
        elif kind == "appended":
            other = words + [word() for _ in range(rnd.randint(size // 20, size // 5))]
        else:
            other = words[: size - rnd.randint(size // 20, size // 6)]
        texts += [" ".join(words), " ".join(other)]
    return texts


@pytest.mark.parametrize("kind", ["block", "appended", "missing"])
def test_similar_finds_passage_edits(spark, kind):
    texts = passages(3, 40, kind)
    want = brute_similar(texts)
    assert sum(k != v for k, v in want.items()) >= 35
    assert similar_labels(spark, texts) == want


def word_edits(seed, n, low, high):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
    texts = []
    while len(texts) < 2 * n:
        words = [word() for _ in range(rnd.randint(150, 400))]
        other = [w if rnd.random() > 0.035 else word() for w in words]
        one, two = word_shingles(" ".join(words)), word_shingles(" ".join(other))
        if low <= len(one & two) / len(one | two) < high:
            texts += [" ".join(words), " ".join(other)]
    return texts


def test_similar_leaves_what_is_below(spark):
    texts = word_edits(5, 40, 0.70, 0.79)
    assert similar_labels(spark, texts) == {k: k for k in range(len(texts))}
    lines = ["one two three four five six seven"] * 60
    rest = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(2)]
    repeated = ["\n".join([*lines, r]) for r in rest]  # repeated lines make texts alike, not their sets
    assert similar_labels(spark, repeated) == {0: 0, 1: 1}


def test_short_junk_is_judged_by_its_words(spark):
    rnd = random.Random(4)
    _, rows = sample_docs(spark, 200)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(4, 9)))
    clean = [(7000 + i, " ".join(r[1].split()[:60]), r[2], "s") for i, r in enumerate(rows[:20])]
    menus = [(8000 + i, " | ".join(word() for _ in range(45)), r[2], "s") for i, r in enumerate(rows[:8])]
    every = spark.createDataFrame([*rows, *clean, *menus], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["q_rules"] for r in quality.with_quality(every, quality.references(every)).collect()}
    assert all(50 <= got[m[0]]["n_words"] < 150 and not got[m[0]]["base_failed"] and got[m[0]]["class_distance"] <= 0.30 for m in menus)
    assert not any(got[m[0]]["kept"] for m in menus)
    assert all(got[c[0]]["kept"] or got[c[0]]["base_failed"] for c in clean)


def test_representatives_lose_no_text(spark):
    """Rows that share an id, or have none, are documents of their own if their texts differ."""
    _, rows = sample_docs(spark, 7)
    ids = [None, None, None, None, None, 1, 1]
    docs = spark.createDataFrame([(i, r[1], r[2], r[3]) for i, r in zip(ids, rows, strict=True)], "doc_id long, text string, lang string, source string")
    assert sorted(r["text"] for r in simhash.keep_representatives(docs).collect()) == sorted(r[1] for r in rows)
    twice = docs.unionByName(docs)
    assert sorted(r["text"] for r in simhash.keep_representatives(twice).collect()) == sorted(r[1] for r in rows)


def test_families_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts edited from one that is not there, mostly under 0.8 to each other: what is linked is found from pairs in proportion to the texts."""
    rnd = random.Random(1)
    base, texts = [f"w{rnd.randrange(10**6)}" for _ in range(300)], []
    for _ in range(400):
        words = list(base)
        for k in rnd.sample(range(300), 4):
            words[k] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    whole, asked = simhash.verified, []

    def counted(known, keys, pairs, similar):
        asked.append(pairs.count())
        return whole(known, keys, pairs, similar)

    monkeypatch.setattr(simhash, "verified", counted)
    got = similar_labels(spark, texts)
    sets = [frozenset(simhash.shingle_set(t).tolist()) for t in texts]
    root = list(range(400))
    for i in range(400):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                one, two = root[i], root[j]
                root = [min(one, two) if r in (one, two) else r for r in root]
    assert [got[k] for k in range(400)] == root
    assert max(asked[1:]) < 16 * 400 and sum(asked[1:]) < 32 * 400


def test_hot_fingerprints_make_no_pairs_of_all(spark):
    """Thousands of near copies give a star, not all their pairs."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(40, 2, replace=False)) for _ in range(3000)})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    assert links.distinct().count() <= 5 * len(fps) * 5
    roots = {r["root"] for r in connected_components(links, "a", "b").collect()}
    assert roots == {min(fps)}


def test_mixing_bears_repeated_rows(spark):
    text = " ".join(["w"] * 5)
    rows = [(1, text, "en", "a")] * 20 + [(k, " ".join(["v"] * 5), "en", "a") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for seed in ("p", "q", "r"):
        want = {(r["doc_id"]): 0 for r in mixing.mix_sizes(docs, seed=seed).collect()}
        for r in mixing.mix_sizes(docs, seed=seed, share=0.77).collect():
            want[r["doc_id"]] += r["copies"]
        got = dict.fromkeys(want, 0)
        for r in mixing.mix(docs, seed=seed, share=0.77).collect():
            got[r["doc_id"]] += 1
        assert got == want


def test_mixing_gives_long_documents_their_odds(spark):
    """One document longer than all that its source is to give is still taken as often as its ratio says."""
    docs = [(0, " ".join(["w"] * 400), "a")] + [(k, "one two three four five", "a") for k in range(1, 101)]
    rows = [(1000 * run + k, t, f"{s}{run}") for run in range(150) for k, t, s in docs]  # as many sources as runs
    out = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), weights=(1.0,), share=0.4).collect()
    long = [r["copies"] for r in out if r["size"] == 400]
    error = (0.4 * 0.6 / len(long)) ** 0.5
    assert abs(sum(long) / len(long) - 0.4) < 2 * error
    for s in {r["source"] for r in out}:
        taken = sum(r["copies"] * r["size"] for r in out if r["source"] == s)
        assert taken == 400 or 355 <= taken <= 365


def test_pareto_odds_follow_relative_weights(spark):
    """Documents of twice the weight are taken twice as often, and the words come out as wanted."""
    rows = [(100 * run + k, "one two three", f"s{run}", 1.0 + k % 2) for run in range(60) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").repartition(4)
    weight = F.when(F.col("_id") % 2 == 1, 2.0).otherwise(1.0)
    out = mixing.mix_sizes(docs, weights=(1.0,), share=0.3, relative=weight).collect()
    odd, even = ([r["copies"] for r in out if r["doc_id"] % 2 == k] for k in (1, 0))
    assert abs(sum(odd) / len(odd) - 0.4) < 0.03 and abs(sum(even) / len(even) - 0.2) < 0.03
    assert abs(sum(r["copies"] * r["size"] for r in out) - 0.3 * sum(r["size"] for r in out)) < 0.02 * sum(r["size"] for r in out)
    heavy = mixing.mix_sizes(docs, weights=(1.0,), share=0.9, relative=F.when(F.col("_id") % 2 == 1, 50.0).otherwise(1.0)).collect()
    assert all(r["copies"] == 1 for r in heavy if r["doc_id"] % 2 == 1)


def brute_verdict(text, lang, refs):
    """Kept or not, from the definitions."""
    from math import log, log2, sqrt

    words, code = WORD.findall(text), quality.CLASS_OF
    n, _, _, _, repeated = brute_quality(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False

    def apart(p, q):
        p, q = ([x / sum(z) for x in z] for z in (p, q))
        part = lambda a, b: sum(x * log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        return sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))

    def distances(ref):
        classes = [0] * 8
        for ch in text:
            classes[code[ch.encode()[0]]] += 1
        low = text.lower().encode().split()
        common = [low.count(w) for w in ref["words"]]
        rest = len(low) - sum(common)
        return apart(classes, list(ref["classes"])), apart([*common, rest], list(ref["counts"])), apart([sum(common), rest], [sum(ref["counts"][:-1]), ref["counts"][-1]])

    a, b, c = distances(refs[lang]) if lang in refs else min((distances(r) for r in refs.values()), key=sum)
    return not (a > 0.30 or b > 0.50 or c > 0.10 + 4 / sqrt(8 * log(2)) / sqrt(len(words)))


def test_quality_tells_foreign_and_invented_words(spark):
    """Clean letters, but the words of another language or of none; a rare language keeps its own reference."""
    rnd = random.Random(14)
    docs, rows = sample_docs(spark, 200)
    word = lambda: "".join(rnd.choice("bcdfgaeioulmnrst") for _ in range(rnd.randint(3, 9)))
    nonsense = [(6000 + i, " ".join(word() for _ in range(n)), "en", "s") for i, n in enumerate([60, 120, 300, 300])]
    foreign = [(6100 + i, r[1], "en", "s") for i, r in enumerate(r for r in rows if r[2] == "de")]
    rare = [(6200 + i, " ".join(rnd.choice(["il", "che", "non", "per", "una"]) if rnd.random() < 0.4 else word() for _ in range(150)), "it", "s") for i in range(2)]
    every = [*rows, *nonsense, *foreign[:10], *rare, (6300, rows[0][1], None, "s"), (6301, nonsense[3][1] + " zz", "xx", "s")]
    df = spark.createDataFrame(every, docs.schema).withColumn("q", F.lit("mine"))
    refs = quality.references(df)
    out = quality.with_quality(df, refs).collect()
    got = {r["doc_id"]: r["q_rules"]["kept"] for r in out}
    assert all(r["q"] == "mine" for r in out) and {"it", "xx"} <= set(refs)
    assert not any(got[r[0]] for r in [*nonsense, *foreign[:10]])
    assert all(got[r[0]] for r in [*rows, *rare]) and got[6300]
    assert got == {r[0]: brute_verdict(r[1], r[2], refs) for r in every}


def test_language_posteriors_equal_brute_force(spark):
    """The fused posterior, from the counts of all documents and each document's likelihoods."""
    from math import exp, log

    langs = ["de", "en", "es", "fr"]
    docs, rows = sample_docs(spark, 80)
    model = langid.fit(docs, id_col="doc_id", text="text", label="lang", languages=langs, sample=20)
    urls = [f"http://h{i % 3}.example.{['de', 'com', 'fr'][i % 3]}/{['en/', 'x/', ''][i % 3]}p" for i in range(len(rows))]
    texts = [(" ".join(r[1].split()[: 1 + i % 6]) if i % 9 else "") for i, r in enumerate(rows)]
    said = [[None, "EN-us", "de", "xx"][i % 4] for i in range(len(rows))]
    df = spark.createDataFrame(list(zip(range(len(rows)), texts, said, urls, strict=True)), "doc_id long, text string, lang string, url string")
    got = {r["doc_id"]: r for r in langid.identify(df, url="url", host=None, model=model).collect()}
    logs = [[float(model[0][langid.trigram_buckets(t), k].sum()) for k in range(4)] for t in texts]
    seen = [len(langid.trigram_buckets(t)) for t in texts]
    vote = [max(range(4), key=lambda k, i=i: (logs[i][k], -k)) if seen[i] else None for i in range(len(rows))]
    hosts, ends = ([u.split("/")[2] for u in urls], [u.split("/")[2].rsplit(".", 1)[1] for u in urls])
    for i in range(len(rows)):
        others = [j for j in range(len(rows)) if j != i]
        scores = []
        for k, x in enumerate(langs):
            count = lambda group, i=i, k=k, others=others: (sum(vote[j] == k for j in others if group[j] == group[i]), sum(vote[j] is not None for j in others if group[j] == group[i]))
            corpus = (sum(vote[j] == k for j in others) + 1) / (sum(vote[j] is not None for j in others) + 4)
            a, b = count(ends)
            region = (a + 20 * corpus) / (b + 20)
            a, b = count(hosts)
            score = 0.5 * logs[i][k] + log((a + 20 * region) / (b + 20))
            segment = urls[i].split("/")[3] if urls[i].count("/") > 3 else None
            for word, trust in ((said[i] and said[i][:2].lower(), 0.9), (segment, 0.6), ({"de": "de", "fr": "fr"}.get(ends[i]), 0.6)):
                if word in langs:
                    score += log(trust if word == x else (1 - trust) / 3)
            scores.append(score)
        top = max(scores)
        assert abs(got[i]["li_posterior"] - 1 / sum(exp(s - top) for s in scores)) < 1e-9
        assert got[i]["li_lang"] == (langs[scores.index(top)] if seen[i] else None)
        assert got[i]["li_text_lang"] == (langs[vote[i]] if seen[i] else None)


def test_language_hosts_in_their_millions(spark):
    """The salted way for many hosts gives what the broadcast gives."""
    docs, _ = sample_docs(spark, 120)
    one, two = (langid.identify(docs, sample=20, host_rows=n).select("doc_id", "li_lang", "li_posterior", "li_kept").orderBy("doc_id").collect() for n in (200_000, 0))
    assert one == two


def test_language_sample_bears_ties(spark):
    """Null ids tie by id; the sample is the same every time."""
    docs, _ = sample_docs(spark, 120)
    docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    one, two = (langid.fit(d, id_col="doc_id", text="text", label="lang", languages=["de", "en"], sample=7) for d in (docs, docs.repartition(5)))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_relational_pieces(spark):
    """Explode, join, group and fold as Spark operators give the library's pieces of every word."""
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = pieces.piece_table(open(path, "rb").read())
    text = "The quick brown fox jumps   over the lazy dogs, internationalisation 12345 == ==== façade naïveté 漢字 tokenisers"
    words = table.split(text)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    cut = {r["word"]: r["pieces"] for r in pieces.relational_pieces(df, path).collect()}
    got = [p for w in words for p in cut[w]]
    want = sp.encode(text, out_type=str)
    assert [p for p in got if p in table.ids] == [p for p in want if not p.startswith("<0x")]
    assert set(cut) == set(words)


def test_other_model_kinds_are_refused():
    path = tokenizer_file("piece_bpe_32k.model")
    model = open(path, "rb").read()
    assert pieces.model_kind(model) == 2
    assert pieces.model_kind(b"\x12\x02\x18\x01") == 1 and pieces.model_kind(b"\x12\x00") == 1
    with pytest.raises(ValueError):
        pieces.PieceTable(b"\x12\x02\x18\x01")


def test_nearest_counts_every_row(spark):
    """Repeated rows are candidates as often as they stand there; vectors meet those of their own length; scores are stable."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.2, 0.0]), (50, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, query="id % 50 = 0", k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert got == {0: [(1, 1), (2, 1), (3, 2)], 50: [(1, 3)]}
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    one, two = ({(r[0], r[2]): r[3] for r in ann.nearest(df, query="id % 50 = 0", block=b, per_task=p).collect()} for b, p in ((16, 50), (512, 10_000)))
    assert one == two
