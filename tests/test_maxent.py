"""Maximum entropy models against the definition, summed word by word."""

import math
import random

from textloom.operators import counts as C
from textloom.operators import maxent as X
from textloom.operators import score as R
from textloom.plans.session import cut


def sentences(seed, n=30):
    rnd = random.Random(seed)
    return [(i, [rnd.choice("abbcd") for _ in range(rnd.randint(1, 6))]) for i in range(n)]


def events(sents, order):
    out = []
    for _, ws in sents:
        seq = ["<s>", *ws, "</s>"]
        out += [(tuple(seq[max(0, j - order + 1) : j]), seq[j]) for j in range(1, len(seq))]
    return out


def total_weight(lam, ctx, w):
    return sum(lam.get((" ".join(ctx[k:]), w), 0.0) for k in range(len(ctx) + 1))


def objective(lam, data, vocab, prior=None, sigma2=6.0):
    value = sum(math.log(sum(math.exp(total_weight(lam, c, v)) for v in vocab)) - total_weight(lam, c, w) for c, w in data) / len(data)
    return value + 0.5 * sum((x - (prior or {}).get(k, 0.0)) ** 2 for k, x in lam.items()) / (sigma2 * len(data))


def slopes(lam, data, vocab, keys, **more):
    out = {}
    for k in keys:
        up, down = dict(lam), dict(lam)
        up[k] += 1e-5
        down[k] -= 1e-5
        out[k] = (objective(up, data, vocab, **more) - objective(down, data, vocab, **more)) / 2e-5
    return out


def test_fit_is_optimal_sparse_and_sums_to_one(spark):
    sents = sentences(1)
    counts = cut(C.count_ngrams(spark.createDataFrame(sents, "sent_id int, words array<string>"), 3))
    rows = cut(X.fit(counts, 3))
    lam = {(r.ctx, r.w): r.lam for r in rows.collect()}
    data, vocab = events(sents, 3), sorted({w for c, w in lam if c == ""})
    c1 = X.ALPHA / len(data)
    assert 0 < sum(x == 0 for x in lam.values()) < len(lam)
    for k, g in slopes(lam, data, vocab, list(lam)[::4]).items():
        slack = abs(g + math.copysign(c1, lam[k])) if lam[k] else max(0.0, abs(g) - c1)
        assert slack < 2e-3
    start = objective(dict.fromkeys(lam, 0.0), data, vocab)
    assert objective(lam, data, vocab) + c1 * sum(map(abs, lam.values())) < 0.97 * start
    m = X.to_backoff(rows, 3)
    asked = [(c, w) for c in ("", "a", "a b", "<s>", "<s> a", "zz", "zz a") for w in vocab]
    got = {(r.ctx, r.w): 10**r.logp for r in R.lookup(spark.createDataFrame(asked, "ctx string, w string"), m).collect()}
    for c, w in asked:
        near = tuple(c.split())
        z = sum(math.exp(total_weight(lam, near, v)) for v in vocab)
        assert abs(got[c, w] - math.exp(total_weight(lam, near, w)) / z) < 1e-12


def test_gradient_with_prior_and_new_words(spark):
    sents = sentences(2, 12)
    counts = cut(C.count_ngrams(spark.createDataFrame(sents, "sent_id int, words array<string>"), 2))
    own = {(r.ctx, r.w): 0.1 * len(r.ctx + r.w) for r in counts.where("w <> '<s>'").collect() if r.ctx in ("", "a", "<s>")}
    prior = spark.createDataFrame([(1 + (c != ""), c, w, x) for (c, w), x in own.items()], "ord int, ctx string, w string, lam double")
    words = spark.createDataFrame([("new",), ("a",)], "w string")
    rows, contexts, total = X.structure(counts, 2, prior, words)
    # events in contexts that the prior's features do not have are left out
    data = [(c, w) for c, w in events(sents, 2) if c[0] in ("a", "<s>")]
    assert total == len(data)
    from pyspark.sql import functions as F

    rows = rows.withColumn("x", F.col("prior") * 0.5 + 0.1)
    found, _ = X.evaluate(rows, X.shape_of(rows, contexts), X.SIGMA2 * total)
    lam = {(r.ctx, r.w): r.x for r in found.collect()}
    vocab = sorted({w for c, w in lam if c == ""})
    assert "new" in vocab
    want = slopes(lam, data, vocab, list(lam), prior=own)
    for r in found.collect():
        assert abs(r.g - want[r.ctx, r.w]) < 1e-8
