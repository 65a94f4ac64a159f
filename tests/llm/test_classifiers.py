import itertools
import random

import numpy as np
import pytest

from taxloom.llm import quality, toxicity
from taxloom.llm.fit import labelled_sample


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"wört{i}" for i in range(400)]
    rows = []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 90))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(["vile", "scorn", "grubby", "grubber"])
        if not good:
            w = [x.upper() + "##" for x in w]
        rows.append((k, " ".join(w), int(good), int(toxic)))
    return rows


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 4, 4, 9, 10])
    s, trans = rng.normal(size=10) * 2, rng.normal(size=(2, 2))
    got = toxicity.marginals(s, first, trans)
    for a, b in itertools.pairwise(first):
        total, hot = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=int(b - a)):
            e = sum(s[a + i] for i, y in enumerate(path) if y) + sum(trans[x, y] for x, y in itertools.pairwise(path))
            total += np.exp(e)
            hot += np.exp(e) * np.array(path)
        if b > a:
            assert np.allclose(got[a:b], hot / total)


@pytest.mark.parametrize("module,label,column", [(toxicity, "toxic", 3), (quality, "quality", 2)])
def test_held_out_accuracy(spark, module, label, column):
    rows = corpus(4, 900)
    docs = spark.createDataFrame([(r[0], r[1], 0.5) for r in rows] + [(900, None, 0.5), (901, "", 0.5), (None, "x", 0.5), (3, rows[3][1], 0.5), (902, "a b " * 60000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:600]] + [(None, 1, 1), (5, None, None), (rows[0][0], rows[0][2], rows[0][3])], "doc_id long, quality int, toxic int")
    out = module.score(docs, module.fit(docs, labels, None)).collect()
    assert len(out) == 905 and all(0 <= r.score <= 1 for r in out)
    by_id = {r.row.doc_id: r for r in out}
    right = [(by_id[r[0]].score >= 0.5) == bool(r[column]) for r in rows[600:]]
    assert np.mean(right) > 0.95
    if module is toxicity:
        bad = next(r for r in rows[600:] if r[3])
        found = " ".join(bad[1][s.start : s.end] for s in by_id[bad[0]].spans).lower().split()
        assert found and {w.strip("#") for w in found} <= {"vile", "scorn", "grubby", "grubber"}


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_nothing_to_learn_from(spark, module, label):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.score(docs, module.fit(docs, none, None)).first().score < 0.5
    one = spark.createDataFrame([(1, 1, 1)], none.schema)
    assert module.score(docs, module.fit(docs, one, None)).first().score > 0.5
    assert module.score(docs.limit(0), module.fit(docs, one, None)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "t" * (k + 1)) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    sample, totals = labelled_sample(docs, labels, "toxic", None, 5, 1000)
    assert len(sample) == 10 and totals == {0: 25, 1: 25}
    some = labelled_sample(docs, labels, "toxic", None, 50, 100)[0]
    assert {len(t) for t, _ in some} <= set(range(1, 26)) and all(0 < sum(len(t) for t, c in some if c == y) <= 100 for y in (0, 1))  # whole ones, each a quarter at most


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_long_texts_are_learned_from(spark, module, label):
    rng = random.Random(8)
    clean = lambda n: [f"wort{rng.randrange(300)}" for _ in range(n)]
    mark = lambda w: [x if i % 12 else "vile" for i, x in enumerate(w)]
    rows = [(k, " ".join(mark(clean(4000)) if k % 3 == 0 else clean(40)), int(k % 3 == 0)) for k in range(120)]
    assert all(len(t) > 20_000 for _, t, y in rows if y)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, y) for k, _, y in rows if k < 90], "doc_id long, toxic int, quality int")
    got = {r.row.doc_id: r.score for r in module.score(docs, module.fit(docs, labels, None)).collect()}
    assert all((got[k] >= 0.5) == bool(y) for k, _, y in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_one_class_scores_its_share(spark, module):
    model = module.train([("only one class", 0)], {0: 300, 1: 100})
    scores = module.score_texts(model, [b"any text"])
    assert abs(float((scores[0] if module is toxicity else scores)[0]) - 0.25) < 0.01


def test_margins_of_many_texts_are_plain_sums(monkeypatch):
    rows = corpus(2, 300)
    model = quality.train([(r[1], r[2]) for r in rows], {0: 1, 1: 1})
    monkeypatch.setattr(quality, "TEXTS_AT_ONCE", 7)
    texts = [r[1].encode() for r in rows[:40]] + [b"", b" ", rows[0][1].encode()]
    feats, words = quality.token_features(texts)
    for d, got in enumerate(quality.margins(model, texts)):
        held = {k for h in feats for k in h[words.first[d] : words.first[d + 1]].tolist()}
        want = model.bias + sum(w for k, w in zip(model.keys.tolist(), model.weight, strict=True) if k in held and quality.index_of(model.slots, model.keys, np.array([k], dtype=np.uint64))[0] >= 0)
        assert abs(want - got) < 1e-9


def test_hinge_against_plain_descent():
    """The dual solution minimises |w|^2 / 2 + sum of cost * hinge^2."""
    rng = np.random.default_rng(0)
    n, f = 40, 6
    x = (rng.random((n, f)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=n) * 0.3 > 0.8).astype(np.int64)
    ratio, cost = rng.normal(size=f), np.full(n, 0.3)
    w = quality.hinge([np.flatnonzero(r) for r in x], ratio, y, cost, epochs=4000)
    v, sign = np.column_stack([x * ratio, np.ones(n)]), 2 * y - 1
    plain = np.zeros(f + 1)
    for _ in range(40000):
        slack = np.maximum(0, 1 - sign * (v @ plain))
        plain -= 0.01 * (plain - 2 * (cost * slack * sign) @ v)
    assert np.allclose(w, plain, atol=2e-2)


def test_rows_of_one_id_count_once(spark):
    docs = spark.createDataFrame([(1, "b")] * 30 + [(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", None, 5, 100)[0] == [("a", 1), ("c", 0)]


def test_chain_gradient_reaches_the_likelihoods_top():
    """Weights fitted by forward-backward gradients have no better neighbours."""
    rng = np.random.default_rng(4)
    first = np.array([0, 5, 12, 30])
    index = [rng.integers(-1, 3, 30).astype(np.int32)]
    label = (rng.random(30) < 0.4).astype(np.int64)
    crf = toxicity.Crf(np.empty(0), np.empty(3), np.zeros(3), 0.0, np.zeros((2, 2)), np.zeros(5))
    toxicity.train_chain(index, first, label, crf, steps=600, rate=0.05, ridge=0.0)

    def likelihood(theta, bias, trans):
        s = bias + np.append(theta, 0.0)[index[0]]
        total = 0.0
        for a, b in itertools.pairwise(first):
            paths = [sum(s[a + i] for i, y in enumerate(p) if y) + sum(trans[x, y] for x, y in itertools.pairwise(p)) for p in (label[a:b],)]
            z = np.array([0.0, s[a]])
            for i in range(a + 1, b):
                z = np.array([np.logaddexp(z[0] + trans[0, y], z[1] + trans[1, y]) + (s[i] if y else 0) for y in (0, 1)])
            total += paths[0] - np.logaddexp(*z)
        return total

    best = likelihood(crf.theta, crf.bias, crf.trans)
    for _ in range(60):
        assert likelihood(crf.theta + rng.normal(size=3) * 0.1, crf.bias + rng.normal() * 0.1, crf.trans + rng.normal(size=(2, 2)) * 0.1) <= best + 1e-2


def plain_messages(s, trans):
    """Ratios of the forward and the backward messages of one text, token by token."""
    t, e = np.exp(trans), np.exp(np.clip(s, -30, 30))
    clip = lambda r: min(1e12, max(1e-12, r))
    a, b = [], []
    for k in range(len(s)):
        r = e[k] if k == 0 else e[k] * (t[0, 1] + t[1, 1] * a[-1]) / (t[0, 0] + t[1, 0] * a[-1])
        a.append(clip(r))
    q = 1.0
    for k in range(len(s) - 1, -1, -1):
        if k < len(s) - 1:
            q = clip((t[1, 0] + t[1, 1] * e[k + 1] * q) / (t[0, 0] + t[0, 1] * e[k + 1] * q))
        b.append(q)
    return np.array(a), np.array(b[::-1])


@pytest.mark.parametrize("block", [1, 2, 7, 512])
def test_blocks_of_long_texts_change_nothing(monkeypatch, block):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    for trans in (np.array([[1.5, -2.0], [-1.0, 2.5]]), np.zeros((2, 2)), np.array([[-3.0, 4.0], [3.5, -2.0]])):
        sizes = [0, 1, 5, 0, 40, 7, 14, 3, 130, 1]
        s = rng.normal(-1, 4, sum(sizes))
        first = np.concatenate([[0], np.cumsum(sizes)])
        a, b = toxicity.forward_backward(s, first, trans)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            x, y = plain_messages(s[lo:hi], trans)
            assert np.allclose(a[lo:hi], x, rtol=1e-9) and np.allclose(b[lo:hi], y, rtol=1e-9)


def test_one_very_long_text_takes_seconds():
    import time

    rng = np.random.default_rng(1)
    n = 1_500_000  # about 10 MB of text
    began = time.time()
    p = toxicity.marginals(rng.normal(-2, 2, n), np.array([0, n]), np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert len(p) == n and time.time() - began < 20
