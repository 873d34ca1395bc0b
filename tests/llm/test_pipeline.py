"""The stages against brute-force versions, on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("textloom.llm")

import corpus_pipeline as P  # noqa: E402
from tests.llm.test_operators import odd_docs, sample_docs  # noqa: E402
from textloom.llm.queries import tokenizer_file  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "simhash_dedup", "source_mix", "sentencepiece"]


def test_run(spark, tmp_path):
    import sentencepiece

    docs, rows = sample_docs(spark, 200)
    rnd = random.Random(1)
    copies = [(1000 + i, r[1], r[2], r[3]) for i, r in enumerate(rnd.sample(rows, 20))]
    short = [(3000 + i, "too short", "en", "s0") for i in range(5)]
    blank = [(4000 + i, "12345 678", "en", "s0") for i in range(5)]
    planted = [(r[0], r[1], r[2], r[3], len(r[1])) for r in [*rows, *copies, *short, *blank]]
    spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:3]:
        before = kept
        kept = stage(spark, before, str(tmp_path))
        assert kept.columns == before.columns, name
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [r[0] for r in rows]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows}
    out = P.run(spark, str(tmp_path)).collect()
    words = {s: sum(len(texts[i].split()) for i, *_ in [r for r in rows if r[3] == s]) for s in {r[3] for r in rows}}
    taken = {s: 0 for s in words}
    for r in out:
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["n_pieces"] == len(r["ids"])
        taken[r["source"]] += len(texts[r["doc_id"]].split())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())


def test_stages_bear_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    for name, stage in P.STAGES:
        assert stage(spark, docs, "").count() >= 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
