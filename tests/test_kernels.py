"""Kernels against brute force, file formats by round trip, list and lattice operators, streaming."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.kernels import align as A
from textloom.kernels import decode as K
from textloom.kernels.lattice import Lattice
from textloom.kernels.lm import TableModel
from textloom.kernels.trellis import ZERO, Trellis, total
from textloom.operators import counts as C
from textloom.operators import decode as X
from textloom.operators import estimate as E
from textloom.operators import nbest as N
from textloom.operators import score as R
from textloom.operators.generate import sample_sentences
from textloom.sources import arpa, lattices, tables
from textloom.sources.text import read_classes, read_counts, read_lines, read_map, write_counts


@pytest.fixture(scope="module")
def model(spark):
    sents = spark.createDataFrame([(i, w.split()) for i, w in enumerate(["a b c", "a c", "b c a", "c a b", "a b"])], "doc_id int, words array<string>")
    return E.train(C.count_ngrams(sents, 2), 2, "wb").persist()


@pytest.fixture(scope="module")
def table(model):
    return X.table_model(model)


def test_trellis_agrees_with_enumeration():
    rnd = random.Random(1)
    w = {(t, a, b): math.log10(rnd.random()) for t in range(4) for a in range(3) for b in range(3)}
    t = Trellis({0: 0.0, 1: -1.0}, 4, lambda t, s: [(b, w[(t, s, b)]) for b in range(3)])
    paths = []
    for p in itertools.product(range(3), repeat=5):
        if p[0] < 2:
            paths.append((sum(w[(k, p[k], p[k + 1])] for k in range(4)) - p[0], list(p)))
    paths.sort(reverse=True)
    assert math.isclose(t.log_total(), total(v for v, _ in paths))
    got = t.viterbi(5)
    assert [p for _, p in got] == [p for _, p in paths[:5]]
    post = t.posteriors()
    assert all(math.isclose(sum(c.values()), 1) for c in post)
    z = sum(10**v for v, _ in paths)
    assert math.isclose(post[2].get(1), sum(10**v for v, p in paths if p[2] == 1) / z)


def test_edit_distance():
    assert A.errors("a b c d".split(), "a x c d e".split()) == (1, 0, 1)
    assert A.errors([], ["a"]) == (0, 0, 1) and A.errors(["a"], []) == (0, 1, 0)
    assert A.distance("a b c".split(), "a c".split()) == 1
    assert A.oracle_errors(["a", "b"], []) == 2
    hyps = [["a", "b"], ["a", "c"], ["a", "b", "c"]]
    best, risk = A.minimum_risk(hyps, [0.4, 0.35, 0.25])
    risks = [sum(p * A.distance(h, g) for g, p in zip(hyps, [0.4, 0.35, 0.25], strict=True)) for h in hyps]
    assert best == risks.index(min(risks)) and math.isclose(risk, min(risks))


def test_mesh():
    mesh = A.Mesh()
    for words, p in ((["a", "b", "c"], 0.5), (["a", "c"], 0.3), (["a", "x", "c", "d"], 0.2)):
        mesh.add(words, p)
    assert all(math.isclose(sum(c.values()), 1.0) for c in mesh.columns)
    assert mesh.consensus()[0] == ["a", "b", "c"]
    assert mesh.error(["a", "x", "c"]) == 0 and mesh.error(["q", "x", "c"]) == 1
    again = lattices.parse_mesh(lattices.format_mesh(mesh))
    assert [set(c) for c in again.columns] == [set(c) for c in mesh.columns]
    mesh.merge(A.Mesh([{"a": 1.0}, {"c": 1.0}], 1.0))
    assert mesh.consensus()[0][0] == "a"


def random_lattice(seed):
    rnd = random.Random(seed)
    lat = Lattice(0, 1)
    for n in range(2, 8):
        lat.node(n, rnd.choice(["a", "b", "c", None]))
    order = [0, *range(2, 8), 1]
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if rnd.random() < 0.5 or b == order[i + 1]:
                lat.edge(a, b, math.log10(rnd.random()))
    return lat


def all_paths(lat, n=None, score=0.0, words=()):
    n = lat.start if n is None else n
    if n == lat.end:
        yield score, words
        return
    for b, w in lat.out.get(n, {}).items():
        word = lat.words[b]
        yield from all_paths(lat, b, score + w, words if word is None else (*words, word))


@pytest.mark.parametrize("seed", range(8))
def test_lattice_measures(seed, table):
    lat = random_lattice(seed).useful()
    paths = list(all_paths(lat))
    z = total(v for v, _ in paths)
    assert math.isclose(lat.backward()[0], z)
    best = {}
    for v, w in paths:
        best[w] = max(v, best.get(w, ZERO))
    ranked = sorted(best.values(), reverse=True)
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip([s for s, _ in lat.nbest(5)], ranked, strict=False))
    grams = lat.expected_ngrams(2)
    want = sum(10 ** (v - z) * sum(w[i : i + 2] == ("a", "b") for i in range(len(w) - 1)) for v, w in paths)
    assert math.isclose(grams.get(("a", "b"), 0.0), want, abs_tol=1e-9)
    ref = ["a", "b", "c"]
    assert lat.error(ref) == min(A.distance(ref, w) for _, w in paths)
    plain = lat.copy().without_nulls()
    assert math.isclose(plain.backward()[0], z, abs_tol=1e-9) or len(set(plain.edges())) < len(set(lat.edges()))
    score = {}
    for v, w in paths:
        history, lm = ["<s>"], 0.0
        for x in [*w, "</s>"]:
            lm += table.log_prob(x, history)
            history.append(x)
        score[w] = max(score.get(w, ZERO), v + lm)
    got = lat.decode(table)[0]
    assert math.isclose(got[0], max(score.values()), abs_tol=1e-9)
    packed = lat.copy().pack().useful()
    assert {w for _, w in all_paths(packed)} == set(best)
    for text in (lattices.format_slf(lat),):
        again = lattices.parse_slf(text)
        assert math.isclose(again.backward()[again.start], z, abs_tol=1e-6)
    grammar = lattices.parse_pfsg(lattices.format_pfsg(lat))
    assert {w for _, w in all_paths(grammar)} == set(best)


def test_decoders(table):
    cands = {"x": [("a", 0.6), ("b", 0.4)], "y": [("b", 0.5), ("c", 0.5)]}
    got = K.disambiguate(["x", "y"], cands, table)[0]
    best = max((sum(table.log_prob(w, [p]) for p, w in zip(["<s>", *t], [*t, "</s>"], strict=True)) + sum(math.log10(dict(cands[o])[h]) for o, h in zip("xy", t, strict=True)), t) for t in itertools.product("ab", "bc"))
    assert math.isclose(got[0], best[0]) and tuple(got[1]) == best[1]
    post = K.disambiguate(["x", "y"], cands, table, posteriors=True)
    assert all(math.isclose(sum(c.values()), 1) for c in post)
    assert len(K.segment("a b c a b".split(), table)) == 5 and K.segment([], table) == []
    assert K.hidden_events(["a", "b"], [], table)[0][1] == [K.NO_EVENT] * 2
    plain = K.class_probs(["a", "b"], table, {})
    assert math.isclose(sum(plain), table.sentence(["a", "b"]))
    one = {"A": table}
    assert math.isclose(sum(K.hmm_probs(["a", "b"], one, {"A": {"A": 1.0}}, "A")), table.sentence(["a", "b"]))
    assert math.isclose(sum(K.hidden_event_probs(["a", "b"], table, {})), table.sentence(["a", "b"]))
    assert math.isclose(sum(K.adaptive_mixture(["a", "b"], [table, table], [0.5, 0.5])), table.sentence(["a", "b"]))


def test_model_files(spark, model, tmp_path):
    arpa.write(model, str(tmp_path / "m.arpa"))
    back = arpa.read(spark, str(tmp_path / "m.arpa"))
    key = lambda m: {(r["ord"], r["ctx"], r["w"]): r["logp"] for r in m.probs.collect()}
    a, b = key(model), key(back)
    assert a.keys() == b.keys() and all(x == b[k] or abs(x - b[k]) < 1e-5 for k, x in a.items())
    assert {(r["ctx"], round(r["bow"], 4)) for r in model.bows.collect()} == {(r["ctx"], round(r["bow"], 4)) for r in back.bows.collect()}


def test_tables(spark, model, tmp_path):
    """Models and counts come back whole, by range of first words and by vocabulary; a unigram model has no weights."""
    key = lambda df: sorted(map(repr, df.collect()))
    for i, m in enumerate((model, R.Model(1, model.probs.where("ord = 1"), model.bows.limit(0)))):
        tables.write_model_table(m, str(tmp_path / f"m{i}"))
        back = tables.read_model_table(spark, str(tmp_path / f"m{i}"))
        assert (back.order, key(back.probs.select("ord", "ctx", "w", "logp"))) == (m.order, key(m.probs.select("ord", "ctx", "w", "logp")))
        assert key(back.bows) == key(m.bows.select("len", "ctx", "bow"))
    counts = C.count_ngrams(spark.createDataFrame([(["b", "a", "c"],), (["c", "c", "é"],)], "words array<string>"), 2)
    tables.write_counts_table(counts, str(tmp_path / "c"))
    rows = {(r["ord"], r["ctx"], r["w"], r["cnt"]) for r in counts.collect()}
    got = lambda **k: {tuple(r) for r in tables.read_counts_table(spark, str(tmp_path / "c"), **k).collect()}
    first = lambda r: (r[1] or r[2]).split(" ")[0]
    assert got() == rows and got(order=1) == {r for r in rows if r[0] == 1}
    assert got(first=("b", "c")) == {r for r in rows if "b" <= first(r) <= "c"}
    words = spark.createDataFrame([("a",), ("b",)], "w string")
    known = {"a", "b", "<s>", "</s>"}
    assert got(vocabulary=words) == {r for r in rows if set(f"{r[1]} {r[2]}".split()) <= known}
    assert got(vocabulary=words.limit(0)) == {r for r in rows if set(f"{r[1]} {r[2]}".split()) <= {"<s>", "</s>"}}


def test_list_set(spark, tmp_path):
    (tmp_path / "u 1.txt").write_text("-1 -2 2 a b\n\n-1.5 -1 1 c\n")
    (tmp_path / "v.score").write_text("")
    got = N.parse_text_format(N.read_list_set(spark, str(tmp_path)))
    assert [(r["utt"], r["rank"], r["ascore"], r["words"]) for r in got.orderBy("rank").collect()] == [("u 1", 0, -1.0, ["a", "b"]), ("u 1", 1, -1.5, ["c"])]


def test_kneser_ney_timing(spark):
    """Constants of raw or of modified counts, and counts that come modified."""
    sents = spark.createDataFrame([([f"w{i % 7}", f"w{i * i % 11}", f"w{i % 5}"],) for i in range(40)] + [(["x", "y"],), (["y", "z", "x"],)] + [(["x", "q"],)] * 2, "words array<string>")
    raw = C.count_ngrams(sents, 3)
    shown = lambda m: sorted((r["ord"], r["ctx"], r["w"], round(r["logp"], 9)) for r in m.probs.collect())
    same = shown(E.train(raw, 3, "kn"))
    assert same == shown(E.train(C.kn_counts(raw, 3).where("cnt > 0"), 3, "kn", kn_counts_are="modified"))
    late = shown(E.train(raw, 3, "kn", kn_counts_are="raw_for_constants"))
    assert [r[:3] for r in late] == [r[:3] for r in same] and late != same


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\n\n c \t d\n")
    assert [r["words"] for r in read_lines(spark, str(tmp_path / "t.txt")).collect()] == [["a", "b"], ["c", "d"]]
    counts = C.count_ngrams(read_lines(spark, str(tmp_path / "t.txt")), 2)
    write_counts(counts, str(tmp_path / "c"), ordered=True)
    assert {tuple(r) for r in read_counts(spark, str(tmp_path / "c")).collect()} == {tuple(r) for r in counts.collect()}
    (tmp_path / "cl").write_text("C 0.5 x y\nC 0.5 z\nD w\n")
    assert {(r["class"], r["p"], tuple(r["expansion"])) for r in read_classes(spark, str(tmp_path / "cl")).collect()} == {("C", 0.5, ("x", "y")), ("C", 0.5, ("z",)), ("D", 1.0, ("w",))}
    (tmp_path / "mp").write_text("x A 0.3 B 0.7\ny C\n")
    assert {tuple(r) for r in read_map(spark, str(tmp_path / "mp")).collect()} == {("x", "A", 0.3), ("x", "B", 0.7), ("y", "C", 1.0)}


def test_lists(spark):
    rows = [("u", 0, "a b".split(), -1.0, -2.0, 2), ("u", 1, "a c".split(), -1.5, -1.0, 2), ("v", 0, [], -1.0, -1.0, 0)]
    h = spark.createDataFrame(rows, "utt string, rank int, words array<string>, ascore double, lscore double, nwords int")
    p = N.with_posteriors(h, 1.0, 1.0)
    sums = {r["utt"]: r["s"] for r in p.groupBy("utt").agg(F.sum("posterior").alias("s")).collect()}
    assert all(math.isclose(v, 1) for v in sums.values())
    assert {(r["utt"], r["rank"]): r["new_rank"] for r in N.rerank(N.reweight(h)).collect()}[("u", 1)] == 1
    back = N.denormalise_acoustic(N.normalise_acoustic(h))
    assert {tuple(r) for r in back.select("utt", "rank", "ascore").collect()} == {(r[0], r[1], r[3]) for r in rows}
    refs = spark.createDataFrame([("u", "a b".split()), ("w", "x y".split())], "utt string, words array<string>")
    assert {tuple(r) for r in N.oracle_errors(h, refs).collect()} == {("u", 0), ("w", 2)}
    mesh = N.confusion_network(p)
    assert {r["utt"]: r["words"] for r in N.consensus(mesh).collect()}["u"] == "a c"
    w, value = N.nelder_mead(lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2, [0.0, 0.0], 200)
    assert value < 1e-4 and abs(w[0] - 1) < 0.05


def test_generation_follows_the_model(spark, table):
    out = sample_sentences(spark, table, 300, seed=1).collect()
    assert len(out) == 300
    first = sum(r["sentence"].startswith("a") for r in out) / 300
    assert abs(first - 10 ** table.log_prob("a", ["<s>"])) < 0.1
    assert {(r["id"], r["sentence"]) for r in sample_sentences(spark, table, 300, seed=1).repartition(3).collect()} == {(r["id"], r["sentence"]) for r in out}


def test_table_model_is_the_lookup(table):
    assert isinstance(table, TableModel)
    assert math.isclose(10 ** table.log_prob("b", ["a"]), sum(10 ** table.log_prob("b", ["zz", "a"]) for _ in range(1)))


def test_streams(spark, tmp_path):
    from textloom.streaming import cache_stream, running_counts

    src = tmp_path / "in"
    docs = spark.createDataFrame([(1, "a b\na c"), (2, "a b")], "doc_id int, text string")
    docs.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(docs.schema).parquet(str(src))
    q = running_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("counts_so_far").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["ctx"], r["w"]): r["cnt"] for r in spark.table("counts_so_far").collect()}
    assert got[("a", "b")] == 2 and got[("", "a")] == 3
    words = spark.createDataFrame([("k", i, w) for i, w in enumerate("a b a a c a".split())], "k string, at long, w string")
    words.coalesce(1).write.parquet(str(tmp_path / "w"))
    q = cache_stream(spark.readStream.schema(words.schema).parquet(str(tmp_path / "w")), "k", 3).writeStream.format("memory").queryName("cached").start()
    q.processAllAvailable()
    q.stop()
    assert [round(r["cache"], 4) for r in spark.table("cached").orderBy("at").collect()] == [0.0, 0.0, 0.5, 0.6667, 0.0, 0.6667]


def test_unit_distance():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 90))] for _ in range(2))
        assert A.distance(a, b) == A.distance(a, b, lambda x, y: float(x != y))


def test_turns_are_judged_whole(spark, tmp_path):
    from textloom.plans.hypotheses import q_turns

    head = [f"h{k}" for k in range(12)]
    turns = [[*head, *tail] for tail in (["x"] * 30, ["y"] * 20, ["y"] * 20 + ["z"])]
    rows = [(1, k, "user", " ".join(t)) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in q_turns(spark, str(tmp_path)).collect()] == [("1", 1, " ".join(turns[1]), 0.25 * 30 + 0.25)]
